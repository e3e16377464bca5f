"""Common table expressions the SQL checks are put together from."""

from __future__ import annotations

from kerbline import constants as K
from kerbline import schema
from kerbline.plans.fixture import RAW_SQL, SCORED_SQL

RAW_TEXT = [c for c in schema.RAW_COLUMNS if c not in schema.COORDINATES
            and c not in ("direction", "reason_breakdown")]


def r6(expression: str) -> str:
    return (f"(CASE WHEN abs({expression}) < 5e-7 THEN CAST(0 AS DOUBLE) "
            f"ELSE round(CAST({expression} AS DOUBLE), 6) END)")


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(2 * 6371.0::DOUBLE * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) "
            f"+ cos(radians({lat1})) * cos(radians({lat2})) "
            f"* pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))")


def stamp(column: str) -> str:
    return f"try_cast(substr({column}, 1, 19) AS TIMESTAMP)"


_CAUSE = "lower(trim(coalesce(event_cause, 'unknown')))"
CAUSE = (f"CASE WHEN {_CAUSE} = 'fog / low visibility' THEN 'fog' "
         f"WHEN {_CAUSE} = 'test_demo' THEN 'others' ELSE {_CAUSE} END")
_MINUTES = "((epoch_us(end_any) - epoch_us(start_datetime)) / 6e7)"

CTE: dict[str, tuple[list[str], str]] = {
    "raw_incidents": ([], RAW_SQL),
    "nulled": (["raw_incidents"], "SELECT " + ", ".join(
        [f"nullif({c}, 'NULL') AS {c}" for c in RAW_TEXT] + schema.COORDINATES) + " FROM raw_incidents"),
    "parsed": (["nulled"], "SELECT * REPLACE (" + ", ".join(
        f"{stamp(c)} AS {c}" for c in schema.TIMESTAMP_COLUMNS) + ") FROM nulled"),
    "timed": (["parsed"], "SELECT *, coalesce(end_datetime, resolved_datetime, closed_datetime) AS end_any "
                          "FROM parsed"),
    "clean": (["timed"], f"""
        SELECT id, lower(trim(coalesce(event_type, 'unknown'))) AS event_type, {CAUSE} AS event_cause,
          trim(coalesce(corridor, 'Non-corridor')) AS corridor,
          lower(trim(coalesce(veh_type, 'unknown'))) AS veh_type,
          trim(coalesce(zone, 'unknown')) AS zone, trim(coalesce(priority, 'Low')) AS priority,
          latitude, longitude, start_datetime, end_datetime, resolved_datetime, closed_datetime,
          created_date, status, authenticated, junction, police_station, address, description,
          start_datetime + INTERVAL '330' MINUTE AS start,
          CASE WHEN upper(requires_road_closure) = 'TRUE' THEN 1 ELSE 0 END AS road_closure,
          CASE WHEN trim(coalesce(priority, 'Low')) = 'High' THEN 1 ELSE 0 END AS high_priority,
          CASE WHEN {CAUSE} IN ({listed(K.GATHERING_CAUSES)}) THEN 1 ELSE 0 END AS is_gathering,
          CASE WHEN {_MINUTES} > 0 AND {_MINUTES} <= 1440 THEN {_MINUTES} END AS duration_min,
          {_MINUTES} AS raw_min
        FROM timed WHERE start_datetime IS NOT NULL"""),
    "scored": (["raw_incidents"], SCORED_SQL),
    "outcome": (["scored", "clean"], """
        SELECT s.*, c.start, c.start_datetime, c.duration_min, c.status, c.corridor
        FROM scored s JOIN clean c USING (id)"""),
    "counts": (["clean"], """
        SELECT corridor, date_trunc('hour', start) AS bin, count(*) AS n_events,
          CAST(sum(road_closure) AS BIGINT) AS n_impact FROM clean GROUP BY ALL"""),
    "panel": (["counts"], """
        SELECT c.corridor, h.bin, coalesce(n.n_events, 0) AS n_events, coalesce(n.n_impact, 0) AS n_impact
        FROM (SELECT DISTINCT corridor FROM counts) c
        CROSS JOIN (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM counts) h
        LEFT JOIN counts n ON n.corridor = c.corridor AND n.bin = h.bin"""),
    "centroids": (["clean"], """
        SELECT corridor, avg(latitude) AS latitude, avg(longitude) AS longitude FROM clean GROUP BY corridor"""),
    "near": (["centroids"], f"""
        SELECT a.corridor AS src, b.corridor AS dst,
          {haversine('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS d
        FROM centroids a JOIN centroids b ON a.corridor <> b.corridor
        QUALIFY row_number() OVER (PARTITION BY a.corridor ORDER BY d, b.corridor) <= 5"""),
    "edges": (["near"], """
        SELECT src, dst, (1 / greatest(d, 0.1)) / sum(1 / greatest(d, 0.1)) OVER (PARTITION BY src) AS w
        FROM near"""),
    "lagged": (["panel"], """
        SELECT *, hour(bin) AS hour, isodow(bin) - 1 AS dow,
          """ + ", ".join(f"CAST(lag(n_events, {n}) OVER w AS DOUBLE) AS lag_{n}" for n in K.PANEL_LAGS) + """,
          """ + ", ".join(
              f"avg(n_events) OVER (PARTITION BY corridor ORDER BY bin ROWS BETWEEN {n} PRECEDING "
              f"AND 1 PRECEDING) AS roll_{n}" for n in K.PANEL_ROLLS) + """
        FROM panel WINDOW w AS (PARTITION BY corridor ORDER BY bin)"""),
    "spread": (["lagged", "edges"], """
        SELECT e.src AS corridor, l.bin, sum(e.w * l.lag_1) AS slag_1, sum(e.w * l.lag_24) AS slag_24
        FROM edges e JOIN lagged l ON e.dst = l.corridor GROUP BY ALL"""),
    "features": (["lagged", "spread"], """
        SELECT l.*, s.slag_1, s.slag_24 FROM lagged l LEFT JOIN spread s USING (corridor, bin)
        WHERE l.lag_168 IS NOT NULL"""),
    "neighbourhood": (["clean"], f"""
        SELECT id, count(*) FILTER (d <= 1) AS hist_density_1km, count(*) FILTER (d <= 3) AS hist_density_3km,
          coalesce(sum(exp(-d * d / 2)) FILTER (d <= 4), 0) AS kde_intensity,
          coalesce(sum(exp(-d * d / 4.5)) FILTER (d <= 4 AND is_gathering = 1), 0) AS kde_gathering,
          coalesce(sum(exp(-d * d / 2)) FILTER (d <= 4 AND event_cause = 'accident'), 0) AS kde_accident,
          coalesce(sum(exp(-d * d / 4.5)) FILTER (d <= 4 AND road_closure = 1), 0) AS kde_closure,
          least(coalesce((epoch_us(any_value(start)) - max(epoch_us(prior_start)) FILTER (d <= 1)) / 3.6e9, 72), 72)
            AS hrs_since_nearby
        FROM (SELECT a.id, a.start, b.start AS prior_start, b.is_gathering, b.event_cause, b.road_closure,
                {haversine('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS d
              FROM clean a LEFT JOIN clean b ON b.start < a.start
                AND b.latitude BETWEEN a.latitude - 0.0361 AND a.latitude + 0.0361
                AND b.longitude BETWEEN a.longitude - 0.0375 AND a.longitude + 0.0375)
        GROUP BY id"""),
    "rates": (["clean"], "SELECT corridor, avg(road_closure) AS rate FROM clean GROUP BY corridor"),
    "cut": (["clean"], "SELECT quantile_cont(CAST(epoch_us(start) AS DOUBLE), 0.8) AS cut FROM clean"),
    "classes": (["scored"], """
        SELECT p_road_closure AS p, sum(road_closure) AS pos, sum(1 - road_closure) AS neg
        FROM scored GROUP BY 1"""),
    "falling": (["classes"], """
        SELECT p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
          sum(pos) OVER () AS P_all, sum(neg) OVER () AS N_all
        FROM classes WINDOW w AS (ORDER BY p DESC)"""),
    "ruled_score": (["scored"], f"""
        SELECT *, 0.55::DOUBLE * p_road_closure
            + 0.35::DOUBLE * least(coalesce(nullif(exp_duration_min, 0), 60) / 240.0::DOUBLE, 1)
            + 0.10::DOUBLE * CASE WHEN event_cause IN ({listed(K.BARRICADE_CAUSES)}) THEN 1 ELSE 0 END AS score,
          CASE WHEN event_cause IN ({listed(K.BARRICADE_CAUSES)}) THEN 1 ELSE 0 END AS hard_cause
        FROM scored"""),
    "ruled": (["ruled_score"], """
        SELECT *, CASE WHEN p_road_closure >= 0.80 OR score >= 0.46 THEN 'Critical'
                       WHEN p_road_closure >= 0.60 OR score >= 0.20 THEN 'High'
                       WHEN score >= 0.10 THEN 'Moderate' ELSE 'Low' END AS tier FROM ruled_score"""),
}


def with_ctes(needs: list[str], select: str) -> str:
    """The select with every table expression it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in CTE[name][0]:
                visit(other)
            order.append(name)

    for name in needs:
        visit(name)
    head = ",\n".join(f"{name} AS ({CTE[name][1].strip()})" for name in order)
    return f"WITH {head}\n{select.strip()}"
