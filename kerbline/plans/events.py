"""Queries on cleaning, features and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline import constants as K
from kerbline import schema
from kerbline.functions import clock, geo
from kerbline.operators import cleaning, features, profile, surface
from kerbline.plans.fixture import Tables, tidy
from kerbline.plans.sql import CAUSE, RAW_TEXT, haversine, listed, r6, with_ctes
from kerbline.sources.incidents import align, null_literals

CENTRE_DISTANCE = haversine("latitude", "longitude", "12.9716::DOUBLE", "77.5946::DOUBLE")
TEMPORAL_SQL = f"""
    {r6("sin(2 * pi() * (hour(start) + minute(start) / 60.0::DOUBLE) / 24)")} AS hour_sin,
    {r6("cos(2 * pi() * (hour(start) + minute(start) / 60.0::DOUBLE) / 24)")} AS hour_cos,
    {r6("sin(2 * pi() * (isodow(start) - 1) / 7.0::DOUBLE)")} AS dow_sin,
    {r6("cos(2 * pi() * (isodow(start) - 1) / 7.0::DOUBLE)")} AS dow_cos,
    CAST(isodow(start) - 1 AS INTEGER) AS dow, CASE WHEN isodow(start) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    CAST(month(start) AS INTEGER) AS month"""
_MINUTE_OF_DAY = "(hour(start) * 60 + minute(start))"
PEAK_SQL = (f"CASE WHEN {_MINUTE_OF_DAY} BETWEEN 480 AND 660 OR {_MINUTE_OF_DAY} BETWEEN 1020 AND 1200 "
            "THEN 1 ELSE 0 END")
DAYPART_SQL = (f"CASE WHEN {_MINUTE_OF_DAY} <= 360 THEN 'night' WHEN {_MINUTE_OF_DAY} <= 660 THEN 'morning' "
               f"WHEN {_MINUTE_OF_DAY} <= 960 THEN 'afternoon' WHEN {_MINUTE_OF_DAY} <= 1260 THEN 'evening' "
               "ELSE 'latenight' END")
PIN_SQL = r"coalesce(nullif(regexp_extract(address, 'Pin-?\s?(\d{6})', 1), ''), 'none')"
CATEGORICAL_SQL = """event_type, event_cause, corridor, veh_type, zone,
    coalesce(authenticated, 'unknown') AS authenticated, is_gathering,
    CASE WHEN corridor <> 'Non-corridor' THEN 1 ELSE 0 END AS is_corridor,
    coalesce(junction, 'none') AS junction, coalesce(police_station, 'none') AS police_station"""
TEXT_SQL = r"""CASE WHEN length(coalesce(description, '')) > 0 THEN 1 ELSE 0 END AS has_desc,
    CAST(least(length(coalesce(description, '')), 200) AS INTEGER) AS desc_len,
    CASE WHEN regexp_matches(coalesce(description, ''), '[^\x00-\x7F]') THEN 1 ELSE 0 END AS desc_nonascii"""
CLEAN_COLUMNS = ["id", "event_type", "event_cause", "corridor", "veh_type", "zone", "priority", "latitude",
                 "longitude", "start", "road_closure", "high_priority", "is_gathering", "duration_min"]


def _features(t: Tables, *names: str):
    return tidy(features.feature_frame(t.clean, keep=["id"], features=names))


def _multi_pass_features(t: Tables, *names: str):
    return tidy(features.feature_frame(t.clean_table, keep=["id"], features=names))


def scan_incidents(spark, sf_dir):
    return Tables(spark, sf_dir).raw


def align_schema(spark, sf_dir):
    """Minimal reports, padded to the raw schema."""
    minimal = Tables(spark, sf_dir).raw.select("start_datetime", "id", "event_cause", "longitude", "latitude")
    return align(minimal)


def null_literal(spark, sf_dir):
    return null_literals(Tables(spark, sf_dir).raw)


def parse_timestamps(spark, sf_dir):
    times = cleaning.parse_times(null_literals(align(Tables(spark, sf_dir).raw)))
    return tidy(times.select("id", *schema.TIMESTAMP_COLUMNS))


def to_local_time(spark, sf_dir):
    return tidy(Tables(spark, sf_dir).clean.select("id", "start_datetime", "start"))


def local_to_utc(spark, sf_dir):
    """A local date and hour as the export's UTC text."""
    t = Tables(spark, sf_dir)
    hour = F.date_trunc("hour", "start").cast("timestamp_ntz")
    return t.clean.select("id", clock.utc_text(clock.local_to_utc(hour)).alias("start_text"))


def normalise_cause(spark, sf_dir):
    return Tables(spark, sf_dir).clean.select("id", "event_cause")


def normalise_categories(spark, sf_dir):
    return Tables(spark, sf_dir).clean.select("id", "event_type", "corridor", "veh_type", "zone", "priority")


def closure_flag(spark, sf_dir):
    return Tables(spark, sf_dir).clean.select("id", "road_closure")


def priority_flag(spark, sf_dir):
    return Tables(spark, sf_dir).clean.select("id", "high_priority")


def gathering_flag(spark, sf_dir):
    return Tables(spark, sf_dir).clean.select("id", "is_gathering")


def clearance_duration(spark, sf_dir):
    return tidy(Tables(spark, sf_dir).clean.select("id", "duration_min"))


def clean_incidents(spark, sf_dir):
    return tidy(Tables(spark, sf_dir).clean.select(CLEAN_COLUMNS))


def clean_summary(spark, sf_dir):
    return tidy(cleaning.clean_summary(Tables(spark, sf_dir).clean))


def temporal_features(spark, sf_dir):
    return _features(Tables(spark, sf_dir), "hour_sin", "hour_cos", "dow_sin", "dow_cos", "dow", "is_weekend",
                     "month")


def peak_flag(spark, sf_dir):
    return _features(Tables(spark, sf_dir), "is_peak")


def daypart(spark, sf_dir):
    return _features(Tables(spark, sf_dir), "daypart")


def haversine_step(spark, sf_dir):
    """Distance of every event from its corridor's centroid."""
    t = Tables(spark, sf_dir)
    from kerbline.operators.weights import corridor_centroids
    centroids = corridor_centroids(t.clean).toDF("corridor", "c_lat", "c_lon")
    return tidy(t.clean.join(centroids, "corridor").select("id", geo.haversine_km(
        F.col("latitude"), F.col("longitude"), F.col("c_lat"), F.col("c_lon")).alias("km")))


def dist_center(spark, sf_dir):
    return _features(Tables(spark, sf_dir), "lat", "lon", "dist_center_km")


def categorical_features(spark, sf_dir):
    return _features(Tables(spark, sf_dir), *K.FEATURE_GROUPS["cat_core"], "junction", "police_station")


def pin_extract(spark, sf_dir):
    return _features(Tables(spark, sf_dir), "pin")


def cause_corridor(spark, sf_dir):
    return _features(Tables(spark, sf_dir), "cause_corridor")


def text_features(spark, sf_dir):
    return _features(Tables(spark, sf_dir), *K.FEATURE_GROUPS["text"])


def feature_groups(spark, sf_dir):
    """The classifiers' 14 columns: no neighbourhood join in the plan."""
    return _features(Tables(spark, sf_dir), *K.CLASSIFIER_FEATURES)


def feature_frame(spark, sf_dir):
    return _multi_pass_features(Tables(spark, sf_dir), *K.FEATURES)


def target_encoding(spark, sf_dir):
    return _multi_pass_features(Tables(spark, sf_dir), "corridor_event_rate")


def cap_categories(spark, sf_dir):
    frame = features.feature_frame(Tables(spark, sf_dir).clean_table, keep=["id"],
                                   features=["event_cause", "junction", "police_station", "pin", "cause_corridor"])
    return features.cap_categories(frame)


def lead_time(spark, sf_dir):
    return tidy(cleaning.lead_hours(Tables(spark, sf_dir).clean).select("id", "event_type", "lead_hours"))


def filter_by_cause(spark, sf_dir):
    chosen = profile.filter_by_cause(Tables(spark, sf_dir).clean, ["accident", "tree_fall"])
    return chosen.select("id", "event_cause")


def impute_location(spark, sf_dir):
    """Every third event loses its coordinates first."""
    t = Tables(spark, sf_dir)
    from kerbline.operators.weights import corridor_centroids
    lost = F.substring("id", 2, 20).cast("bigint") % 3 == 0
    holed = t.clean.withColumns({c: F.when(~lost, F.col(c)) for c in schema.COORDINATES})
    filled = cleaning.impute_location(holed, corridor_centroids(t.clean), K.CITY_CENTRE)
    return tidy(filled.select("id", "latitude", "longitude"))


def events_sample(spark, sf_dir):
    return tidy(profile.events_sample(Tables(spark, sf_dir).clean))


def daily_volume(spark, sf_dir):
    return tidy(profile.daily_volume(Tables(spark, sf_dir).clean, ["planned", "unplanned"]))


def daily_rolling3(spark, sf_dir):
    daily = profile.daily_volume(Tables(spark, sf_dir).clean, ["planned", "unplanned"])
    return tidy(profile.rolling_means(daily, ["planned", "unplanned"]))


def hour_dow_heatmap(spark, sf_dir):
    return profile.hour_dow_counts(Tables(spark, sf_dir).clean)


def hour_dow_matrix(spark, sf_dir):
    """One row per weekday, one column per hour."""
    wide = profile.hour_dow_matrix(Tables(spark, sf_dir).clean)
    return wide.select("dow", *[F.col(f"`{h}`").alias(f"h{h}") for h in range(24)])


def cause_top12(spark, sf_dir):
    return profile.frequency(Tables(spark, sf_dir).clean, "event_cause", 12)


def closure_rate_by_cause(spark, sf_dir):
    return tidy(profile.closure_rate_by_cause(Tables(spark, sf_dir).clean))


def closure_rate_by_type(spark, sf_dir):
    return tidy(profile.rate_by(Tables(spark, sf_dir).clean, "event_type", "road_closure", "closure_rate"))


def priority_rate_by_cause(spark, sf_dir):
    return tidy(profile.rate_by(Tables(spark, sf_dir).clean, "event_cause", "high_priority", "priority_rate"))


def corridor_load(spark, sf_dir):
    return profile.frequency(Tables(spark, sf_dir).clean, "corridor", 14)


def corridor_closure_top8(spark, sf_dir):
    rates = profile.rate_by(Tables(spark, sf_dir).clean, "corridor", "road_closure", "closure_rate")
    return tidy(rates.orderBy(F.desc("n_events"), "corridor").limit(8))


def monthly_cause_trend(spark, sf_dir):
    return profile.monthly_cause_trend(Tables(spark, sf_dir).clean_table)


def null_profile(spark, sf_dir):
    return tidy(profile.null_profile(null_literals(Tables(spark, sf_dir).raw)))


_PROFILED = [c for c in schema.PROFILED if c in RAW_TEXT] + ["junction"]


def value_profile(spark, sf_dir):
    return profile.value_profile(null_literals(Tables(spark, sf_dir).raw), _PROFILED)


def duration_describe(spark, sf_dir):
    ungated = Tables(spark, sf_dir).clean_table.select(cleaning.raw_minutes(
        F.col("start_datetime"), F.col("end_datetime"), F.col("resolved_datetime"),
        F.col("closed_datetime")).alias("minutes"))
    return tidy(profile.describe(ungated, ["minutes"], profile.DURATION_PERCENTILES))


def coord_describe(spark, sf_dir):
    return tidy(profile.describe(Tables(spark, sf_dir).clean_table, schema.COORDINATES, profile.QUARTILES))


def lead_time_describe(spark, sf_dir):
    led = cleaning.lead_hours(Tables(spark, sf_dir).clean_table)
    return tidy(profile.describe(led, ["lead_hours"], profile.LEAD_PERCENTILES, by=["event_type"]))


def hour_counts(spark, sf_dir):
    return Tables(spark, sf_dir).clean.groupBy(F.hour("start").alias("hour")).agg(F.count("*").alias("n_events"))


def dow_counts(spark, sf_dir):
    return Tables(spark, sf_dir).clean.groupBy(F.weekday("start").alias("dow")).agg(F.count("*").alias("n_events"))


def dataset_meta(spark, sf_dir):
    return tidy(profile.dataset_meta(Tables(spark, sf_dir).clean))


_OPTIONS = ["event_cause", "event_type", "corridor", "veh_type"]


def option_lists(spark, sf_dir):
    return profile.option_lists(Tables(spark, sf_dir).clean, _OPTIONS)


def duration_hist(spark, sf_dir):
    return tidy(surface.histogram(Tables(spark, sf_dir).clean_table, "duration_min"))


def kde_surface(spark, sf_dir):
    """Smoothed surface of all events and of the closures."""
    clean = Tables(spark, sf_dir).clean_table
    both = [surface.kde_surface(points).withColumn("layer", F.lit(layer)) for layer, points in
            [("all", clean), ("closures", clean.where(F.col("road_closure") == 1))]]
    return tidy(both[0].unionByName(both[1]))


def closure_points(spark, sf_dir):
    return tidy(profile.closure_points(Tables(spark, sf_dir).clean))


def most_recent(spark, sf_dir):
    return tidy(profile.most_recent(Tables(spark, sf_dir).clean).select("id", "start", "event_cause", "corridor"))


def recency_weight(spark, sf_dir):
    weighted = profile.recency_weight(Tables(spark, sf_dir).clean_table)
    return tidy(weighted.where(F.col("duration_min").isNotNull()).select("id", "recency_weight"))


QUERIES = {
    "haversine": haversine_step,
    **{f.__name__: f for f in [
        scan_incidents, align_schema, null_literal, parse_timestamps, to_local_time, local_to_utc,
        normalise_cause, normalise_categories, closure_flag, priority_flag, gathering_flag,
        clearance_duration, clean_incidents, clean_summary, temporal_features, peak_flag, daypart,
        dist_center, categorical_features, pin_extract, cause_corridor, text_features, feature_groups,
        feature_frame, target_encoding, cap_categories, lead_time, filter_by_cause, impute_location,
        events_sample, daily_volume, daily_rolling3, hour_dow_heatmap, hour_dow_matrix, cause_top12,
        closure_rate_by_cause,
        closure_rate_by_type, priority_rate_by_cause, corridor_load, corridor_closure_top8,
        monthly_cause_trend, null_profile, value_profile, duration_describe, coord_describe,
        lead_time_describe, hour_counts, dow_counts, dataset_meta, option_lists, duration_hist,
        kde_surface, closure_points, most_recent, recency_weight]},
}


def _from_clean(select: str) -> str:
    return with_ctes(["clean"], select)


def _stats(value: str, source: str, probs: list[float], keys: str = "", label: str = "") -> str:
    """Describe statistics of one column as (statistic, value) rows."""
    parts = [("count", f"CAST(count({value}) AS DOUBLE)"), ("mean", f"avg({value})"),
             ("std", f"stddev_samp({value})"), ("min", f"min({value})"), ("max", f"max({value})")]
    parts += [(f"p{round(p * 100)}", f"quantile_cont(CAST({value} AS DOUBLE), {p})") for p in probs]
    lead = f"{keys}, " if keys else ""
    tail = f" GROUP BY {keys}" if keys else ""
    return "\nUNION ALL\n".join(
        f"SELECT {lead}'{label or value}' AS \"column\", '{name}' AS statistic, {r6(e)} AS value FROM {source}{tail}"
        for name, e in parts)


def _capped(columns: list[str], most: int) -> str:
    source = with_ctes(["clean"], f"""
        , frame AS (SELECT id, event_cause, coalesce(junction, 'none') AS junction,
            coalesce(police_station, 'none') AS police_station, {PIN_SQL} AS pin,
            event_cause || '|' || corridor AS cause_corridor FROM clean)""")
    tops = ", ".join(
        f"top_{c} AS (SELECT {c} AS v FROM frame GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT {most})"
        for c in columns)
    picks = ", ".join(
        f"CASE WHEN {c} IN (SELECT v FROM top_{c}) THEN {c} ELSE '__other__' END AS {c}" for c in columns)
    return f"{source}, {tops} SELECT id, {picks} FROM frame"


def _smoothed(layer: str, where: str) -> str:
    return f"""
    SELECT '{layer}' AS layer, ix, iy, {r6('n')} AS intensity FROM (
      WITH pts AS (SELECT longitude AS x, latitude AS y FROM clean WHERE {where}),
      lim AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts),
      cells AS (SELECT CAST(least(floor((x - x0) / ((x1 - x0) / 160)), 159) AS INTEGER) AS ix,
                       CAST(least(floor((y - y0) / ((y1 - y0) / 160)), 159) AS INTEGER) AS iy,
                       count(*)::DOUBLE AS n FROM pts, lim GROUP BY ALL),
      raw_taps AS (SELECT CAST(k AS INTEGER) AS k, exp(-0.5 * pow(k / 3.0::DOUBLE, 2)) AS w
                   FROM range(-12, 13) r(k)),
      taps AS (SELECT k, w / sum(w) OVER () AS w FROM raw_taps),
      pass1 AS (SELECT ix, i - k AS iy, sum(n * w) AS n
                FROM (SELECT ix, n, unnest([iy, -1 - iy, 319 - iy]) AS i FROM cells), taps
                WHERE i - k BETWEEN 0 AND 159 GROUP BY ALL),
      pass2 AS (SELECT i - k AS ix, iy, sum(n * w) AS n
                FROM (SELECT iy, n, unnest([ix, -1 - ix, 319 - ix]) AS i FROM pass1), taps
                WHERE i - k BETWEEN 0 AND 159 GROUP BY ALL)
      SELECT CAST(a.i AS INTEGER) AS ix, CAST(b.i AS INTEGER) AS iy, coalesce(p.n, 0) AS n
      FROM range(160) a(i), range(160) b(i) LEFT JOIN pass2 p ON p.ix = a.i AND p.iy = b.i)"""


FEATURE_FRAME_SQL = with_ctes(["clean", "neighbourhood", "rates"], f"""
    SELECT id, {TEMPORAL_SQL}, {PEAK_SQL} AS is_peak, {DAYPART_SQL} AS daypart,
      {r6('latitude')} AS lat, {r6('longitude')} AS lon, {r6(CENTRE_DISTANCE)} AS dist_center_km,
      hist_density_1km, hist_density_3km, {r6('kde_intensity')} AS kde_intensity,
      {r6('kde_gathering')} AS kde_gathering, {r6('kde_accident')} AS kde_accident,
      {r6('kde_closure')} AS kde_closure, {r6('hrs_since_nearby')} AS hrs_since_nearby,
      {CATEGORICAL_SQL}, {PIN_SQL} AS pin, event_cause || '|' || corridor AS cause_corridor,
      {TEXT_SQL}, {r6('rate')} AS corridor_event_rate
    FROM clean JOIN neighbourhood USING (id) JOIN rates USING (corridor)""")

ORACLES = {
    "scan_incidents": with_ctes(["raw_incidents"], "SELECT * FROM raw_incidents"),
    "align_schema": with_ctes(["raw_incidents"], "SELECT " + ", ".join(
        c if c in ("start_datetime", "id", "event_cause", "longitude", "latitude")
        else f"CAST(NULL AS VARCHAR) AS {c}" for c in schema.RAW_COLUMNS) + " FROM raw_incidents"),
    "null_literal": with_ctes(["nulled"], "SELECT * FROM nulled"),
    "parse_timestamps": with_ctes(["parsed"], "SELECT id, " + ", ".join(
        f"CAST({c} AS VARCHAR) AS {c}" for c in schema.TIMESTAMP_COLUMNS) + " FROM parsed"),
    "to_local_time": _from_clean(
        "SELECT id, CAST(start_datetime AS VARCHAR) AS start_datetime, CAST(start AS VARCHAR) AS start FROM clean"),
    "local_to_utc": _from_clean("""SELECT id, strftime(date_trunc('hour', start) - INTERVAL '330' MINUTE,
        '%Y-%m-%d %H:%M:%S') || '+00' AS start_text FROM clean"""),
    "normalise_cause": with_ctes(["parsed"], f"SELECT id, {CAUSE} AS event_cause FROM parsed "
                                             "WHERE start_datetime IS NOT NULL"),
    "normalise_categories": _from_clean("SELECT id, event_type, corridor, veh_type, zone, priority FROM clean"),
    "closure_flag": _from_clean("SELECT id, road_closure FROM clean"),
    "priority_flag": _from_clean("SELECT id, high_priority FROM clean"),
    "gathering_flag": _from_clean("SELECT id, is_gathering FROM clean"),
    "clearance_duration": _from_clean(f"SELECT id, {r6('duration_min')} AS duration_min FROM clean"),
    "clean_incidents": _from_clean("SELECT " + ", ".join(
        f"{r6(c)} AS {c}" if c in ("latitude", "longitude", "duration_min")
        else f"CAST({c} AS VARCHAR) AS {c}" if c == "start" else c for c in CLEAN_COLUMNS) + " FROM clean"),
    "clean_summary": _from_clean(f"""SELECT count(*) AS n_events, {r6('avg(road_closure)')} AS closure_rate,
        {r6('avg(high_priority)')} AS priority_rate, {r6('count(duration_min) / count(*)::DOUBLE')} AS duration_coverage,
        CAST(min(start) AS VARCHAR) AS first_start, CAST(max(start) AS VARCHAR) AS last_start FROM clean"""),
    "temporal_features": _from_clean(f"SELECT id, {TEMPORAL_SQL} FROM clean"),
    "peak_flag": _from_clean(f"SELECT id, {PEAK_SQL} AS is_peak FROM clean"),
    "daypart": _from_clean(f"SELECT id, {DAYPART_SQL} AS daypart FROM clean"),
    "haversine": with_ctes(["clean", "centroids"], "SELECT c.id, " + r6(haversine(
        "c.latitude", "c.longitude", "m.latitude", "m.longitude"))
        + " AS km FROM clean c JOIN centroids m USING (corridor)"),
    "dist_center": _from_clean(f"SELECT id, {r6('latitude')} AS lat, {r6('longitude')} AS lon, "
                               f"{r6(CENTRE_DISTANCE)} AS dist_center_km FROM clean"),
    "categorical_features": _from_clean(f"SELECT id, {CATEGORICAL_SQL} FROM clean"),
    "pin_extract": _from_clean(f"SELECT id, {PIN_SQL} AS pin FROM clean"),
    "cause_corridor": _from_clean("SELECT id, event_cause || '|' || corridor AS cause_corridor FROM clean"),
    "text_features": _from_clean(f"SELECT id, {TEXT_SQL} FROM clean"),
    "feature_groups": _from_clean(f"""SELECT id, event_type, event_cause, corridor, veh_type, zone,
        coalesce(authenticated, 'unknown') AS authenticated, is_gathering,
        CASE WHEN corridor <> 'Non-corridor' THEN 1 ELSE 0 END AS is_corridor, {r6('latitude')} AS lat,
        {r6('longitude')} AS lon, {r6(CENTRE_DISTANCE)} AS dist_center_km, {TEXT_SQL} FROM clean"""),
    "feature_frame": FEATURE_FRAME_SQL,
    "target_encoding": with_ctes(["clean", "rates"], f"SELECT id, {r6('rate')} AS corridor_event_rate "
                                                     "FROM clean JOIN rates USING (corridor)"),
    "cap_categories": _capped(["event_cause", "junction", "police_station", "pin", "cause_corridor"], 250),
    "lead_time": _from_clean("SELECT id, event_type, "
                             + r6("(epoch_us(start_datetime) - epoch_us(created_date)) / 3.6e9")
                             + " AS lead_hours FROM clean"),
    "filter_by_cause": _from_clean(
        "SELECT id, event_cause FROM clean WHERE event_cause IN ('accident', 'tree_fall')"),
    "impute_location": with_ctes(["clean", "centroids"], f"""SELECT id,
        {r6("CASE WHEN CAST(substr(id, 2) AS BIGINT) % 3 = 0 THEN m.latitude ELSE c.latitude END")} AS latitude,
        {r6("CASE WHEN CAST(substr(id, 2) AS BIGINT) % 3 = 0 THEN m.longitude ELSE c.longitude END")} AS longitude
        FROM clean c JOIN centroids m USING (corridor)"""),
    "events_sample": _from_clean(f"""SELECT {r6('latitude')} AS latitude, {r6('longitude')} AS longitude,
        event_cause, corridor, road_closure, CAST(start AS VARCHAR) AS start FROM clean"""),
    "daily_volume": _from_clean("""SELECT CAST(CAST(start AS DATE) AS VARCHAR) AS day,
        count(*) FILTER (event_type = 'planned') AS planned,
        count(*) FILTER (event_type = 'unplanned') AS unplanned FROM clean GROUP BY 1"""),
    "daily_rolling3": with_ctes(["clean"], f"""
        , daily AS (SELECT CAST(CAST(start AS DATE) AS VARCHAR) AS day,
            count(*) FILTER (event_type = 'planned') AS planned,
            count(*) FILTER (event_type = 'unplanned') AS unplanned FROM clean GROUP BY 1)
        SELECT day, {r6('CASE WHEN count(*) OVER w = 3 THEN avg(planned) OVER w END')} AS planned_mean,
          {r6('CASE WHEN count(*) OVER w = 3 THEN avg(unplanned) OVER w END')} AS unplanned_mean
        FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""),
    "hour_dow_heatmap": _from_clean("""SELECT CAST(isodow(start) - 1 AS INTEGER) AS dow,
        CAST(hour(start) AS INTEGER) AS hour, count(id) AS n_events FROM clean GROUP BY ALL"""),
    "hour_dow_matrix": _from_clean("SELECT CAST(isodow(start) - 1 AS INTEGER) AS dow, " + ", ".join(
        f"count(id) FILTER (hour(start) = {h}) AS h{h}" for h in range(24)) + " FROM clean GROUP BY 1"),
    "cause_top12": _from_clean("""SELECT event_cause, count(*) AS n_events FROM clean GROUP BY 1
        ORDER BY n_events DESC, event_cause LIMIT 12"""),
    "closure_rate_by_cause": _from_clean(f"""SELECT event_cause, {r6('avg(road_closure)')} AS closure_rate,
        count(*) AS n_events FROM clean GROUP BY 1 HAVING count(*) >= 30
        ORDER BY avg(road_closure) DESC, event_cause LIMIT 12"""),
    "closure_rate_by_type": _from_clean(f"""SELECT event_type, {r6('avg(road_closure)')} AS closure_rate,
        count(*) AS n_events FROM clean GROUP BY 1"""),
    "priority_rate_by_cause": _from_clean(f"""SELECT event_cause, {r6('avg(high_priority)')} AS priority_rate,
        count(*) AS n_events FROM clean GROUP BY 1"""),
    "corridor_load": _from_clean("""SELECT corridor, count(*) AS n_events FROM clean GROUP BY 1
        ORDER BY n_events DESC, corridor LIMIT 14"""),
    "corridor_closure_top8": _from_clean(f"""SELECT corridor, {r6('avg(road_closure)')} AS closure_rate,
        count(*) AS n_events FROM clean GROUP BY 1 ORDER BY n_events DESC, corridor LIMIT 8"""),
    "monthly_cause_trend": with_ctes(["clean"], """
        , top AS (SELECT event_cause FROM clean GROUP BY 1 ORDER BY count(*) DESC, event_cause LIMIT 6)
        SELECT m.month, t.event_cause, count(c.id) AS n_events
        FROM (SELECT DISTINCT strftime(start, '%Y-%m') AS month FROM clean) m CROSS JOIN top t
        LEFT JOIN clean c ON c.event_cause = t.event_cause AND strftime(c.start, '%Y-%m') = m.month
        GROUP BY ALL"""),
    "null_profile": with_ctes(["nulled"], "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", {r6(f'1 - count({c}) / count(*)::DOUBLE')} AS null_fraction FROM nulled"
        for c in RAW_TEXT + schema.COORDINATES)),
    "value_profile": with_ctes(["nulled"], "\nUNION ALL\n".join(
        f"(SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, "
        f"(SELECT count(DISTINCT {c}) FROM nulled) AS n_distinct FROM nulled GROUP BY {c} "
        f"ORDER BY n DESC, {c} NULLS LAST LIMIT 12)" for c in _PROFILED)),
    "duration_describe": with_ctes(["clean"], _stats("raw_min", "clean", profile.DURATION_PERCENTILES,
                                                     label="minutes")),
    "coord_describe": with_ctes(["clean"], _stats("latitude", "clean", profile.QUARTILES) + "\nUNION ALL\n"
                                + _stats("longitude", "clean", profile.QUARTILES)),
    "lead_time_describe": with_ctes(["clean"], """
        , led AS (SELECT event_type,
            (epoch_us(start_datetime) - epoch_us(created_date)) / 3.6e9 AS lead_hours FROM clean) """
        + _stats("lead_hours", "led", profile.LEAD_PERCENTILES, keys="event_type")),
    "hour_counts": _from_clean("SELECT CAST(hour(start) AS INTEGER) AS hour, count(*) AS n_events FROM clean GROUP BY 1"),
    "dow_counts": _from_clean(
        "SELECT CAST(isodow(start) - 1 AS INTEGER) AS dow, count(*) AS n_events FROM clean GROUP BY 1"),
    "dataset_meta": _from_clean(f"""SELECT count(*) AS n_events, CAST(CAST(min(start) AS DATE) AS VARCHAR) AS date_min,
        CAST(CAST(max(start) AS DATE) AS VARCHAR) AS date_max,
        {r6("count(*) / floor((epoch_us(max(start)) - epoch_us(min(start))) / 86.4e9)")} AS events_per_day
        FROM clean"""),
    "option_lists": _from_clean("\nUNION ALL\n".join(
        f"SELECT DISTINCT '{c}' AS option, {c} AS value FROM clean" for c in _OPTIONS)),
    "duration_hist": with_ctes(["clean"], f"""
        , known AS (SELECT duration_min AS x FROM clean WHERE duration_min IS NOT NULL),
        lim AS (SELECT min(x) AS a, (max(x) - min(x)) / 60.0::DOUBLE AS w FROM known)
        SELECT CAST(least(floor((x - a) / w), 59) AS INTEGER) AS bin, {r6('any_value(a + least(floor((x - a) / w), 59) * w)')} AS low,
          {r6('any_value(a + (least(floor((x - a) / w), 59) + 1) * w)')} AS high, count(*) AS n
        FROM known, lim GROUP BY 1"""),
    "kde_surface": with_ctes(["clean"], _smoothed("all", "true") + "\nUNION ALL\n"
                             + _smoothed("closures", "road_closure = 1")),
    "closure_points": _from_clean(f"""SELECT id, {r6('longitude')} AS longitude, {r6('latitude')} AS latitude,
        road_closure = 1 AS is_closure FROM clean"""),
    "most_recent": _from_clean("""SELECT id, CAST(start AS VARCHAR) AS start, event_cause, corridor FROM clean
        ORDER BY clean.start DESC, id DESC LIMIT 6"""),
    "recency_weight": _from_clean("SELECT id, " + r6(
        "exp(-((SELECT max(epoch_us(start)) FROM clean) - epoch_us(start)) / 86.4e9 / 60)")
        + " AS recency_weight FROM clean WHERE duration_min IS NOT NULL"),
}
