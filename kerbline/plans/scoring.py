"""Queries on evaluation metrics, rules, severity, survival and the metrics log.

They start from the deterministic predictions of the fixture, so that every value has a SQL check.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline import constants as K
from kerbline.operators import metrics, ordered, rules, severity, splits
from kerbline.operators.survival import COVARIATES, survival_frame
from kerbline.plans.fixture import Tables, tidy
from kerbline.plans.sql import listed, r6, with_ctes
from kerbline.session import fresh_path, join_grown
from kerbline.sources import metrics as metric_store

_Y, _P = "road_closure", "p_road_closure"


def roc_auc(spark, sf_dir):
    return tidy(metrics.roc_auc(Tables(spark, sf_dir).scored_table, _Y, _P))


def average_precision(spark, sf_dir):
    return tidy(metrics.average_precision(Tables(spark, sf_dir).scored_table, _Y, _P))


def brier(spark, sf_dir):
    return tidy(metrics.brier(Tables(spark, sf_dir).scored, _Y, _P))


def best_threshold(spark, sf_dir):
    return tidy(metrics.best_threshold(Tables(spark, sf_dir).scored_table, _Y, _P))


def confusion(spark, sf_dir):
    return tidy(metrics.confusion(Tables(spark, sf_dir).scored, _Y, _P, 0.5))


def classifier_report(spark, sf_dir):
    """Threshold from the earlier 80 %, metrics on the later 20 %."""
    train, test = splits.train_test(Tables(spark, sf_dir).outcome)
    return tidy(metrics.classifier_report(train, test, _Y, _P))


def duration_error(spark, sf_dir):
    """Errors on the later 20 % against the earlier part's median."""
    train, test = splits.train_test(Tables(spark, sf_dir).outcome)
    naive = metrics.median(train, "duration_min")
    return tidy(metrics.duration_error(test, "duration_min", "exp_duration_min", naive))


def roc_curve(spark, sf_dir):
    return tidy(metrics.roc_curve(Tables(spark, sf_dir).scored_table, _Y, _P))


def pr_curve(spark, sf_dir):
    return tidy(metrics.pr_curve(Tables(spark, sf_dir).scored_table, _Y, _P))


def pr_area(spark, sf_dir):
    return tidy(metrics.pr_area(Tables(spark, sf_dir).scored_table, _Y, _P))


def calibration(spark, sf_dir):
    return tidy(metrics.calibration(Tables(spark, sf_dir).scored_table, _Y, _P))


def spearman(spark, sf_dir):
    return tidy(metrics.spearman(Tables(spark, sf_dir).outcome, _P, "duration_min"))


def concordance(spark, sf_dir):
    t = Tables(spark, sf_dir)
    framed = join_grown(survival_frame(t.clean_table).select("id", "T", "E"),
                        t.scored_table.select("id", "exp_duration_min"), "id", "left")
    return tidy(metrics.concordance(framed, "T", "E", "exp_duration_min"))


def survival_table(spark, sf_dir):
    return tidy(survival_frame(Tables(spark, sf_dir).clean_table))


def _recommended(spark, sf_dir):
    return rules.recommend(Tables(spark, sf_dir).scored)


def severity_score(spark, sf_dir):
    score = rules.severity_score(F.col(_P), F.col("exp_duration_min"), F.col("event_cause"))
    return tidy(Tables(spark, sf_dir).scored.select("id", score.alias("severity_score")))


def severity_tier(spark, sf_dir):
    return _recommended(spark, sf_dir).select("id", "severity_tier")


def rec_officers(spark, sf_dir):
    return _recommended(spark, sf_dir).select("id", "rec_officers")


def rec_barricades(spark, sf_dir):
    return _recommended(spark, sf_dir).select("id", "rec_barricades")


def rec_diversion(spark, sf_dir):
    return _recommended(spark, sf_dir).select("id", "rec_diversion")


def rec_tow_eta(spark, sf_dir):
    return _recommended(spark, sf_dir).select("id", "rec_tow_crane", "rec_eta_minutes")


def recommend(spark, sf_dir):
    return _recommended(spark, sf_dir).select(
        "id", "event_cause", "severity_score", "severity_tier", "rec_officers", "rec_barricades", "rec_diversion",
        "rec_tow_crane", "rec_eta_minutes")


def incident_report(spark, sf_dir):
    return rules.incident_report(_recommended(spark, sf_dir)).select(
        "id", "event_cause", "closure_risk", "duration", "severity_tier", "severity_colour", "rec_officers",
        "rec_barricades", "rec_diversion", "major_road", "tow_crane", "summary")


def severity_weight_search(spark, sf_dir):
    return tidy(severity.weight_search(Tables(spark, sf_dir).outcome))


def best_severity_weights(spark, sf_dir):
    return tidy(severity.best_weights(severity.weight_search(Tables(spark, sf_dir).outcome)))


def former_severity(spark, sf_dir):
    """The search objective of the former formula."""
    return tidy(severity.former_objective(Tables(spark, sf_dir).outcome).drop("blend"))


def _raw_scores(spark, sf_dir):
    return Tables(spark, sf_dir).scored_table.withColumn("score", F.round(rules.severity_score(
        F.col(_P), F.col("exp_duration_min"), F.col("event_cause")), 9))


def severity_thresholds(spark, sf_dir):
    found = ordered.quantiles(_raw_scores(spark, sf_dir), "score", K.TIER_QUANTILES)
    names = F.create_map(*[F.lit(x) for q, t in zip(K.TIER_QUANTILES, K.TIERS[1:]) for x in (q, t)])
    return tidy(found.select(names[F.col("prob")].alias("tier"), F.col("quantile").alias("least_score")))


def tier_summary(spark, sf_dir):
    scores = _raw_scores(spark, sf_dir)
    return tidy(severity.tier_summary(severity.tiers(scores, severity.tier_thresholds(scores))))


def _table_metrics(t: Tables):
    """A few metrics per cause: one section per cause."""
    rates = t.scored.groupBy(F.col("event_cause").alias("section")).agg(
        F.count("*").cast("double").alias("n_events"), F.avg(_Y).alias("closure_rate"), F.avg(_P).alias("mean_risk"))
    return rates.unpivot(["section"], ["n_events", "closure_rate", "mean_risk"], "metric", "value")


def metrics_log(spark, sf_dir):
    """Two runs appended as JSON lines, read back."""
    t = Tables(spark, sf_dir)
    path = fresh_path(t.spark, "metrics-log")
    rows = _table_metrics(t)
    for run in ("2024-01-01T00:00:00", "2024-01-02T00:00:00"):
        metric_store.append_metrics(rows, path, run)
    return tidy(metric_store.read_metrics(t.spark, path).withColumn("value", F.col("value").cast("double")))


def metrics_snapshot(spark, sf_dir):
    """The latest results replaced twice and read back."""
    t = Tables(spark, sf_dir)
    path = fresh_path(t.spark, "snapshot")
    for _ in range(2):
        metric_store.write_snapshot(_table_metrics(t), path)
    return tidy(metric_store.read_snapshot(t.spark, path).withColumn("value", F.col("value").cast("double")))


def metrics_results(spark, sf_dir):
    """One nested results document in a file, with a `_meta` section, flattened."""
    t = Tables(spark, sf_dir)
    path = fresh_path(t.spark, "results")
    sections = _table_metrics(t).groupBy("section").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", F.col("value").cast("string")))).alias("m"))
    meta = F.create_map(F.lit("_meta"), F.create_map(F.lit("n"), F.lit("1")))
    document = sections.agg(F.to_json(F.map_concat(F.map_from_entries(F.collect_list(F.struct("section", "m"))), meta)))
    document.write.text(path)
    found = metric_store.read_results(t.spark, path)
    return tidy(found.withColumn("value", F.col("value").cast("double")))


def metrics_flatten(spark, sf_dir):
    """One nested document per cause and a `_meta` section, flattened."""
    t = Tables(spark, sf_dir)
    sections = _table_metrics(t).where(F.col("metric") == "n_events")
    documents = sections.select(F.format_string(
        '{"%s": {"n_events": %s, "half": %s}, "_meta": {"n_events": 1}}', "section",
        F.col("value").cast("bigint").cast("string"), (F.col("value") / 2).cast("string")).alias("value"))
    return tidy(metric_store.flatten_metrics(documents).withColumn("value", F.col("value").cast("double")))


QUERIES = {
    "survival_frame": survival_table,
    **{f.__name__: f for f in [
        roc_auc, average_precision, brier, best_threshold, confusion, classifier_report, duration_error,
        roc_curve, pr_curve, pr_area, calibration, spearman, concordance, severity_score, severity_tier,
        rec_officers, rec_barricades, rec_diversion, rec_tow_eta, recommend, incident_report,
        severity_weight_search, best_severity_weights, former_severity, severity_thresholds, tier_summary, metrics_log, metrics_snapshot,
        metrics_results,
        metrics_flatten]},
}

# ---------------------------------------------------------------- SQL checks

_THRESHOLDS = "[" + ", ".join(repr(p) for p in metrics.THRESHOLD_PROBS) + "]"
_F1 = "coalesce(2.0::DOUBLE * tp / nullif(flagged + pos, 0), 0)"


def _threshold(table: str) -> str:
    """The chosen threshold of a table with p_road_closure and road_closure."""
    return f"""
    cand AS (SELECT unnest(quantile_cont(p_road_closure, {_THRESHOLDS})) AS threshold FROM {table}),
    tried AS (SELECT threshold, count(*) FILTER (p_road_closure >= threshold) AS flagged,
        count(*) FILTER (p_road_closure >= threshold AND road_closure = 1) AS tp,
        count(*) FILTER (road_closure = 1) AS pos FROM {table}, cand GROUP BY 1),
    best AS (SELECT threshold, {_F1} AS f1 FROM tried ORDER BY f1 DESC, threshold LIMIT 1)"""


_COUNTS = """count(*) FILTER (p_road_closure < t AND road_closure = 0) AS tn,
    count(*) FILTER (p_road_closure >= t AND road_closure = 0) AS fp,
    count(*) FILTER (p_road_closure < t AND road_closure = 1) AS fn,
    count(*) FILTER (p_road_closure >= t AND road_closure = 1) AS tp"""
_RATES = f"""tn, fp, fn, tp, {r6('coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)')} AS precision,
    {r6('coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)')} AS recall,
    {r6('coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1,
    {r6('(tp + fn) / (tp + fp + fn + tn)::DOUBLE')} AS positive_rate"""
_BARRICADE = f"event_cause IN ({listed(K.BARRICADE_CAUSES)})"
_OFFICERS = ("CAST(CASE tier WHEN 'Low' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'High' THEN 4 ELSE 7 END "
             "+ CASE WHEN p_road_closure > 0.4 THEN 2 ELSE 0 END "
             "+ CASE WHEN exp_duration_min > 180 THEN 2 ELSE 0 END AS INTEGER)")
_BARRICADES = ("CASE WHEN p_road_closure > 0.35 OR (tier IN ('High', 'Critical') AND hard_cause = 1) "
               "THEN CASE tier WHEN 'Moderate' THEN 2 WHEN 'High' THEN 4 WHEN 'Critical' THEN 8 ELSE 2 END ELSE 0 END")
_DIVERSION = (f"CASE WHEN p_road_closure > 0.6 THEN '{K.DIVERSION_FULL}' "
              f"WHEN p_road_closure > 0.35 THEN '{K.DIVERSION_PARTIAL}' "
              f"WHEN tier IN ('High', 'Critical') THEN '{K.DIVERSION_ADVISORY}' ELSE '{K.DIVERSION_NONE}' END")
_TOW = "(p_road_closure > 0.4 OR coalesce(exp_duration_min > 180, false))"
_ETA = "CAST(floor(exp_duration_min) AS INTEGER)"
_RISK = "CAST(CAST(round_even(p_road_closure * 100, 0) AS INTEGER) AS VARCHAR) || '%'"
_TIME = "CAST(CAST(round_even(exp_duration_min, 0) AS INTEGER) AS VARCHAR) || ' mins'"
_COLOUR = "CASE tier " + " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in K.TIER_COLOURS.items()) + " END"
_SCORE9 = "round(score, 9)"


def _objective(score: str, more: str = "") -> str:
    """Spearman of a score against closure and known duration over table `parts`, per weighting."""
    return f"""
    SELECT {more} corr(ra, rc) AS closure_corr,
      corr(rk, rd) FILTER (known) AS duration_corr FROM (
      SELECT {more} real_duration IS NOT NULL AS known,
        rank() OVER (PARTITION BY {more or ''} 1 ORDER BY s) + (count(*) OVER (PARTITION BY {more or ''} s) - 1) / 2.0::DOUBLE AS ra,
        rank() OVER (PARTITION BY {more or ''} 1 ORDER BY real_closure)
          + (count(*) OVER (PARTITION BY {more or ''} real_closure) - 1) / 2.0::DOUBLE AS rc,
        rank() OVER (PARTITION BY {more or ''} real_duration IS NOT NULL ORDER BY s)
          + (count(*) OVER (PARTITION BY {more or ''} real_duration IS NOT NULL, s) - 1) / 2.0::DOUBLE AS rk,
        rank() OVER (PARTITION BY {more or ''} real_duration IS NOT NULL ORDER BY real_duration)
          + (count(*) OVER (PARTITION BY {more or ''} real_duration) - 1) / 2.0::DOUBLE AS rd
      FROM (SELECT {more} real_closure, real_duration, round({score}, 12) AS s FROM parts))
    {'GROUP BY ALL' if more else ''}"""


_PARTS = f"""parts AS (SELECT p_road_closure AS closure, p_high_priority AS priority,
    greatest(least(coalesce(exp_duration_min, 60) / 240.0::DOUBLE, 1), 0) AS duration,
    CAST(CASE WHEN {_BARRICADE} THEN 1 ELSE 0 END AS DOUBLE) AS cause, road_closure AS real_closure,
    greatest(least(duration_min / 240.0::DOUBLE, 1), 0) AS real_duration FROM outcome)"""
_GRID = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)"
                  for i, (a, b, c) in enumerate(severity.weight_grid()))
_METRIC_ROWS = """
    , per AS (SELECT event_cause AS section, count(*)::DOUBLE AS n_events, avg(road_closure) AS closure_rate,
        avg(p_road_closure) AS mean_risk FROM scored GROUP BY 1),
    long AS (SELECT section, 'n_events' AS metric, n_events AS value FROM per
        UNION ALL SELECT section, 'closure_rate', closure_rate FROM per
        UNION ALL SELECT section, 'mean_risk', mean_risk FROM per)"""

ORACLES = {
    "roc_auc": with_ctes(["falling"], f"""SELECT {r6('sum(pos * (N_all - fp + neg / 2.0::DOUBLE))'
        ' / (any_value(P_all) * any_value(N_all))')} AS roc_auc FROM falling"""),
    "average_precision": with_ctes(["falling"], f"""SELECT {r6('sum(pos / P_all::DOUBLE * tp / (tp + fp))')}
        AS average_precision FROM falling"""),
    "brier": with_ctes(["scored"], f"SELECT {r6('avg(pow(p_road_closure - road_closure, 2))')} AS brier FROM scored"),
    "best_threshold": with_ctes(["scored"], f""", {_threshold('scored')}
        SELECT {r6('threshold')} AS threshold, {r6('f1')} AS f1 FROM best"""),
    "confusion": with_ctes(["scored"], f"""
        , c AS (SELECT {_COUNTS} FROM scored, (SELECT 0.5::DOUBLE AS t)) SELECT {_RATES} FROM c"""),
    "classifier_report": with_ctes(["outcome", "cut"], f"""
        , train AS (SELECT o.* FROM outcome o, cut WHERE epoch_us(start) <= cut),
        test AS (SELECT o.* FROM outcome o, cut WHERE epoch_us(start) > cut), {_threshold('train')},
        c AS (SELECT {_COUNTS} FROM test, (SELECT threshold AS t FROM best)),
        k AS (SELECT p_road_closure AS p, sum(road_closure) AS pos, sum(1 - road_closure) AS neg FROM test GROUP BY 1),
        f AS (SELECT *, sum(pos) OVER w AS ctp, sum(neg) OVER w AS cfp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an
            FROM k WINDOW w AS (ORDER BY p DESC))
        SELECT {_RATES}, {r6('(SELECT threshold FROM best)')} AS threshold,
          {r6('(SELECT sum(pos * (an - cfp + neg / 2.0::DOUBLE)) / (any_value(ap) * any_value(an)) FROM f)')} AS auc,
          {r6('(SELECT sum(pos / ap::DOUBLE * ctp / (ctp + cfp)) FROM f)')} AS pr_auc,
          {r6('(SELECT avg(pow(p_road_closure - road_closure, 2)) FROM test)')} AS brier FROM c"""),
    "duration_error": with_ctes(["outcome", "cut"], f"""
        , naive AS (SELECT median(duration_min) AS m FROM outcome, cut WHERE epoch_us(start) <= cut)
        SELECT {r6('avg(abs(duration_min - exp_duration_min))')} AS mae, {r6('avg(abs(duration_min - m))')} AS naive_mae,
          count(*) AS n_test, {r6('quantile_cont(abs(duration_min - exp_duration_min), 0.5)')} AS median_ae
        FROM outcome, cut, naive
        WHERE epoch_us(start) > cut AND duration_min IS NOT NULL AND exp_duration_min IS NOT NULL"""),
    "roc_curve": with_ctes(["falling"], f"""SELECT {r6('p')} AS threshold, {r6('fp / N_all::DOUBLE')} AS fpr,
        {r6('tp / P_all::DOUBLE')} AS tpr FROM falling"""),
    "pr_curve": with_ctes(["falling"], f"""SELECT {r6('p')} AS threshold,
        {r6('tp / (tp + fp)::DOUBLE')} AS precision, {r6('tp / P_all::DOUBLE')} AS recall FROM falling"""),
    "pr_area": with_ctes(["falling"], f"""
        , points AS (SELECT p, tp / P_all::DOUBLE AS r, tp / (tp + fp)::DOUBLE AS q, P_all, N_all FROM falling),
        strips AS (SELECT *, r - lag(r, 1, 0::DOUBLE) OVER w AS dr, q + lag(q, 1, 1::DOUBLE) OVER w AS qq FROM points
            WINDOW w AS (ORDER BY p DESC))
        SELECT {r6('sum(dr * qq / 2)')} AS pr_area, {r6('any_value(P_all) / (any_value(P_all) + any_value(N_all))::DOUBLE')}
          AS base_rate FROM strips"""),
    "calibration": with_ctes(["scored"], f"""
        , e AS (SELECT quantile_cont(p_road_closure, [{', '.join(repr(i / 8) for i in range(1, 8))}]) AS edges FROM scored)
        SELECT CAST(len(list_filter(edges, lambda x: x < p_road_closure)) AS INTEGER) AS bin,
          {r6('avg(p_road_closure)')} AS mean_predicted, {r6('avg(road_closure)')} AS observed_rate, count(*) AS n
        FROM scored, e GROUP BY 1"""),
    "spearman": with_ctes(["outcome"], f"""
        , k AS (SELECT p_road_closure AS a, duration_min AS b FROM outcome WHERE duration_min IS NOT NULL),
        r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra,
            rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM k)
        SELECT {r6('corr(ra, rb)')} AS spearman FROM r"""),
    "survival_frame": with_ctes(["clean"], f"""
        , s AS (SELECT *, ((SELECT max(epoch_us(start_datetime)) FROM clean) - epoch_us(start_datetime)) / 6e7 AS elapsed
            FROM clean)
        SELECT id, {r6('coalesce(duration_min, least(elapsed, 1440))')} AS "T",
          CASE WHEN duration_min IS NOT NULL THEN 1 ELSE 0 END AS "E",
          CASE WHEN corridor <> 'Non-corridor' THEN 1 ELSE 0 END AS is_corridor,
          CASE WHEN event_type = 'planned' THEN 1 ELSE 0 END AS is_planned, CAST(hour(start) AS INTEGER) AS hour,
          CASE WHEN isodow(start) >= 6 THEN 1 ELSE 0 END AS is_weekend, """ + ", ".join(
              f"CASE WHEN event_cause = '{c[6:]}' THEN 1 ELSE 0 END AS {c}" for c in COVARIATES if c.startswith("cause_"))
        + " FROM s WHERE duration_min IS NOT NULL OR (status = 'active' AND elapsed > 0)"),
    "concordance": with_ctes(["clean", "scored"], f"""
        , s AS (SELECT id, duration_min, status,
            ((SELECT max(epoch_us(start_datetime)) FROM clean) - epoch_us(start_datetime)) / 6e7 AS elapsed FROM clean),
        f AS (SELECT coalesce(duration_min, least(elapsed, 1440)) AS t, duration_min IS NOT NULL AS e, exp_duration_min AS p
            FROM s JOIN scored USING (id) WHERE (duration_min IS NOT NULL OR (status = 'active' AND elapsed > 0))
              AND exp_duration_min IS NOT NULL)
        SELECT count(*)::DOUBLE AS pairs, count(*) FILTER (a.p < b.p)::DOUBLE AS concordant,
          count(*) FILTER (a.p = b.p)::DOUBLE AS tied,
          {r6('(count(*) FILTER (a.p < b.p) + count(*) FILTER (a.p = b.p) / 2.0::DOUBLE) / count(*)')} AS concordance
        FROM f a JOIN f b ON a.e AND (a.t < b.t OR (a.t = b.t AND NOT b.e))"""),
    "severity_score": with_ctes(["ruled"], f"SELECT id, {r6('score')} AS severity_score FROM ruled"),
    "severity_tier": with_ctes(["ruled"], "SELECT id, tier AS severity_tier FROM ruled"),
    "rec_officers": with_ctes(["ruled"], f"SELECT id, {_OFFICERS} AS rec_officers FROM ruled"),
    "rec_barricades": with_ctes(["ruled"], f"SELECT id, {_BARRICADES} AS rec_barricades FROM ruled"),
    "rec_diversion": with_ctes(["ruled"], f"SELECT id, {_DIVERSION} AS rec_diversion FROM ruled"),
    "rec_tow_eta": with_ctes(["ruled"], f"SELECT id, {_TOW} AS rec_tow_crane, {_ETA} AS rec_eta_minutes FROM ruled"),
    "recommend": with_ctes(["ruled"], f"""SELECT id, event_cause, round_even(score, 3) AS severity_score,
        tier AS severity_tier, {_OFFICERS} AS rec_officers, {_BARRICADES} AS rec_barricades, {_DIVERSION} AS rec_diversion, {_TOW} AS rec_tow_crane,
        {_ETA} AS rec_eta_minutes FROM ruled"""),
    "incident_report": with_ctes(["ruled"], f"""SELECT id, event_cause, {_RISK} AS closure_risk, {_TIME} AS duration,
        tier AS severity_tier, {_COLOUR} AS severity_colour, {_OFFICERS} AS rec_officers,
        {_BARRICADES} AS rec_barricades, {_DIVERSION} AS rec_diversion,
        CASE WHEN p_high_priority > 0.5 THEN 'Yes' ELSE 'No' END AS major_road,
        CASE WHEN {_TOW} THEN 'Yes' ELSE 'No' END AS tow_crane,
        'A ' || event_cause || ' event is expected to close the road with a risk of ' || {_RISK}
          || ' and to clear in ' || coalesce({_TIME}, 'an unknown time') || '. Its severity is ' || tier || '.'
          AS summary FROM ruled"""),
    "severity_weight_search": with_ctes(["outcome"], f"""
        , {_PARTS}, grid(g, wc, wd, wg) AS (VALUES {_GRID}),
        cells AS (SELECT closure, duration, cause, real_closure, real_duration FROM parts),
        blended AS (SELECT g, real_closure, real_duration,
            round(wc * closure + wd * duration + wg * cause, 12) AS s FROM cells, grid),
        ranked AS (SELECT g, real_duration IS NOT NULL AS known,
            rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2.0::DOUBLE AS ra,
            rank() OVER (PARTITION BY g ORDER BY real_closure)
              + (count(*) OVER (PARTITION BY g, real_closure) - 1) / 2.0::DOUBLE AS rc,
            rank() OVER (PARTITION BY g, real_duration IS NOT NULL ORDER BY s)
              + (count(*) OVER (PARTITION BY g, real_duration IS NOT NULL, s) - 1) / 2.0::DOUBLE AS rk,
            rank() OVER (PARTITION BY g, real_duration IS NOT NULL ORDER BY real_duration)
              + (count(*) OVER (PARTITION BY g, real_duration) - 1) / 2.0::DOUBLE AS rd FROM blended),
        rho AS (SELECT g, corr(ra, rc) AS c, corr(rk, rd) FILTER (known) AS d FROM ranked GROUP BY g)
        SELECT wc AS w_closure, wd AS w_duration, wg AS w_cause, {r6('c')} AS closure_corr, {r6('d')} AS duration_corr,
          {r6('0.5 * c + 0.5 * d')} AS objective FROM rho JOIN grid USING (g)"""),
    "former_severity": with_ctes(["outcome"], f"""
        , {_PARTS}, rho AS ({_objective("0.55::DOUBLE * closure + 0.30::DOUBLE * priority + 0.15::DOUBLE * duration")})
        SELECT {r6('closure_corr')} AS closure_corr, {r6('duration_corr')} AS duration_corr,
          {r6('0.5 * closure_corr + 0.5 * duration_corr')} AS objective FROM rho"""),
    "severity_thresholds": with_ctes(["ruled"], "\nUNION ALL\n".join(
        f"SELECT '{t}' AS tier, {r6(f'quantile_cont({_SCORE9}, {q})')} AS least_score FROM ruled"
        for q, t in zip(K.TIER_QUANTILES, K.TIERS[1:]))),
    "tier_summary": with_ctes(["ruled"], f"""
        , q AS (SELECT quantile_cont({_SCORE9}, 0.5) AS m, quantile_cont({_SCORE9}, 0.82) AS h,
            quantile_cont({_SCORE9}, 0.97) AS c FROM ruled)
        SELECT CASE WHEN {_SCORE9} >= c THEN 'Critical' WHEN {_SCORE9} >= h THEN 'High'
            WHEN {_SCORE9} >= m THEN 'Moderate' ELSE 'Low' END AS tier, count(*) AS n_events,
          {r6('avg(road_closure)')} AS closure_rate FROM ruled, q GROUP BY 1"""),
    "metrics_log": with_ctes(["scored"], _METRIC_ROWS + """
        SELECT ts, section, metric, round_even(value, 4) AS value
        FROM long, (VALUES ('2024-01-01T00:00:00'), ('2024-01-02T00:00:00')) r(ts)"""),
    "metrics_snapshot": with_ctes(["scored"], _METRIC_ROWS + """
        SELECT section, metric, round_even(value, 4) AS value FROM long"""),
    "metrics_results": with_ctes(["scored"], _METRIC_ROWS + f"""
        SELECT section, metric, {r6('value')} AS value FROM long"""),
    "metrics_flatten": with_ctes(["scored"], _METRIC_ROWS + """
        SELECT section, metric, value FROM long WHERE metric = 'n_events'
        UNION ALL SELECT section, 'half', value / 2 FROM long WHERE metric = 'n_events'"""),
}
# rounding to six places leaves the order of the weightings as it is but for ties, which go by the weights
ORACLES["best_severity_weights"] = f"""SELECT * FROM ({ORACLES['severity_weight_search']})
    WHERE objective IS NOT NULL ORDER BY objective DESC, w_closure, w_duration LIMIT 1"""
