"""Queries on fitted models, at the library's full settings. Their results are model output, so most have no SQL check."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from kerbline import constants as K
from kerbline import schema
from kerbline.functions import clock
from kerbline.models import aft, encode, forecast, studies
from kerbline.models.impact import ImpactModel
from kerbline.operators import cleaning, features, metrics, panel, profile, rules, splits, surface, weights
from kerbline.operators.survival import survival_frame
from kerbline.plans import space_time
from kerbline.plans.fixture import Tables, tidy
from kerbline.plans.sql import with_ctes
from kerbline.session import fresh_path, join_grown, settle
from kerbline.sources import tables as published
from kerbline.sources.incidents import align
from kerbline.streaming import jobs

_MODELS: dict[tuple, object] = {}


def _once(t: Tables, name: str, build):
    """A model fitted once per session and data folder, shared by the queries on it."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _MODELS:
        _MODELS[key] = build()
    return _MODELS[key]


def _cut(t: Tables) -> float:
    return _once(t, "cut", lambda: splits.time_cut(t.clean_table))


def _train(t: Tables):
    return t.clean_table.where(clock.micros(F.col("start")) <= F.lit(_cut(t)))


def _test(t: Tables):
    return t.clean_table.where(clock.micros(F.col("start")) > F.lit(_cut(t)))


def _impact(t: Tables) -> ImpactModel:
    """Fitted on the earlier 80 %."""
    return _once(t, "impact", lambda: ImpactModel().fit(_train(t)))


def _scores(t: Tables, side: str):
    recorded = ["start", "event_cause", "corridor", "road_closure", "high_priority", "duration_min"]

    def score():
        return _impact(t).score_fitted(recorded) if side == "train" else _impact(t).score(_test(t), keep=recorded)

    return _once(t, f"scores {side}", lambda: settle(score(), f"scores-{side}"))


def _hotspot(t: Tables) -> forecast.HotspotModel:
    return _once(t, "hotspot", lambda: forecast.HotspotModel().fit(_train(t)))


def _forecast(t: Tables):
    return _once(t, "forecast", lambda: settle(_hotspot(t).forecast_panel(t.clean_table), "forecast"))


def closure_model(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tidy(metrics.classifier_report(_scores(t, "train"), _scores(t, "test"), "road_closure", "p_road_closure"))


def priority_model(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tidy(metrics.classifier_report(_scores(t, "train"), _scores(t, "test"), "high_priority", "p_high_priority"))


def duration_model(spark, sf_dir):
    t = Tables(spark, sf_dir)
    naive = metrics.median(_train(t), "duration_min")
    return tidy(metrics.duration_error(_scores(t, "test"), "duration_min", "exp_duration_min", naive))


def score_impact(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tidy(_scores(t, "test").select("id", "p_road_closure", "p_high_priority", "exp_duration_min"))


def _forecast_error(spark, sf_dir, actual: str, predicted: str):
    t = Tables(spark, sf_dir)
    tested = forecast.after(_forecast(t), _cut(t))
    naive = forecast.after(panel.seasonal_naive(_forecast(t)), _cut(t)).where(F.col("snaive").isNotNull())
    naive_mae = naive.agg(F.avg(F.abs(F.col("n_events") - F.col("snaive")))).first()[0]
    row = tested.agg(F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae"),
                     metrics.correlation(predicted, actual).alias("pearson"), F.count("*").alias("n_bins"))
    if actual == "n_events" and naive_mae:
        row = row.withColumn("skill", metrics.forecast_skill(F.col("mae"), F.lit(naive_mae)))
    return tidy(row)


def hotspot_model(spark, sf_dir):
    return _forecast_error(spark, sf_dir, "n_events", "pred_events")


def hotspot_impact(spark, sf_dir):
    return _forecast_error(spark, sf_dir, "n_impact", "pred_impact")


def forecast_panel(spark, sf_dir):
    return tidy(_forecast(Tables(spark, sf_dir)))


def forecast_rows(spark, sf_dir):
    """What SQL can know of the forecast: its rows, actual counts and whether every prediction is a count."""
    sane = [(F.col(c) >= 0).alias(f"{c}_is_count") for c in ("pred_events", "pred_impact")]
    return tidy(_forecast(Tables(spark, sf_dir)).select(
        "corridor", "bin", "n_events", "n_impact", "hour", "dow", *sane))


def score_rows(spark, sf_dir):
    """What SQL can know of the scores: the later events, their outcome and whether every score is in its range."""
    return tidy(_scores(Tables(spark, sf_dir), "test").select(
        "id", "event_cause", "road_closure", "high_priority",
        F.col("p_road_closure").between(0, 1).alias("closure_in_range"),
        F.col("p_high_priority").between(0, 1).alias("priority_in_range"),
        F.coalesce(F.col("exp_duration_min").between(1, K.MAX_CLEARANCE_MIN), F.lit(True)).alias("minutes_in_range")))


def forecast_cv(spark, sf_dir):
    return tidy(forecast.forecast_cv(Tables(spark, sf_dir).clean_table))


def corridor_forecast(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tidy(panel.corridor_forecast(_forecast(t), weights.corridor_centroids(t.clean_table), K.NO_CORRIDOR))


def corridor_actuals(spark, sf_dir):
    """The recorded side of the corridor forecast."""
    t = Tables(spark, sf_dir)
    made = panel.corridor_forecast(_forecast(t), weights.corridor_centroids(t.clean_table), K.NO_CORRIDOR)
    return tidy(made.drop("pred_events", "pred_impact"))


def pred_actual_density(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tidy(surface.density2d(forecast.after(_forecast(t), _cut(t)), "pred_events", "n_events"))


def residual_morans_i(spark, sf_dir):
    """Spatial autocorrelation of the forecaster's mean residuals."""
    t = Tables(spark, sf_dir)
    residual = forecast.after(_forecast(t), _cut(t)).groupBy("corridor").agg(
        F.avg(F.col("n_events") - F.col("pred_events")).alias("value"))
    return tidy(weights.morans_i(residual, _hotspot(t).edges))


def aft_model(spark, sf_dir):
    """Concordance of the survival model and of the regressor on the same later events."""
    t = Tables(spark, sf_dir)
    train, test = settle(survival_frame(_train(t)), "aft-train"), settle(survival_frame(_test(t)), "aft-test")
    model = _once(t, "aft", lambda: aft.fit_aft(train))
    medians = settle(aft.median_minutes(model, test), "aft-medians")
    both = join_grown(medians, _scores(t, "test").select("id", "exp_duration_min"), "id", "left")
    survival = metrics.concordance(both, "T", "E", "median_min").first()["concordance"]
    regressor = metrics.concordance(both, "T", "E", "exp_duration_min").first()["concordance"]
    return tidy(train.agg(F.count("*").alias("n_train"), F.sum(1 - F.col("E")).alias("n_censored"))
                .withColumns({"aft_concordance": F.lit(survival), "regressor_concordance": F.lit(regressor)}))


def encode_features(spark, sf_dir):
    """Size and non-zero entries of the encoded vectors: trees, then the linear form."""
    t = Tables(spark, sf_dir)
    frame = features.feature_frame(t.clean_table, keep=["id"], features=K.CLASSIFIER_FEATURES)
    levels = features.learn_levels(frame)
    made = []
    for linear in (False, True):
        rows, _ = encode.encode_features(frame, K.CLASSIFIER_FEATURES, levels, linear)
        values = vector_to_array("features")
        made.append(rows.select("id", F.lit("linear" if linear else "tree").alias("form"),
                                F.size(values).alias("n_features"),
                                F.size(F.filter(values, lambda x: x != 0)).alias("n_nonzero")))
    return made[0].unionByName(made[1])


def _study(t: Tables) -> studies.FoldStudy:
    return _once(t, "study", lambda: studies.FoldStudy(t.clean_table))


def family_compare(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tidy(studies.family_compare(_study(t), K.FEATURES))


def group_ablation(spark, sf_dir):
    return tidy(studies.group_ablation(_study(Tables(spark, sf_dir)), K.FEATURE_GROUPS, "boosted", studies.boosted))


def kde_ablation(spark, sf_dir):
    """On one split: trained on the first 80 %."""
    t = Tables(spark, sf_dir)
    study = _once(t, "split study", lambda: studies.FoldStudy(t.clean_table, edges=(0.8, 1.0)))
    return tidy(studies.kde_ablation(study, "boosted", studies.boosted))


def forward_selection(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tidy(studies.forward_selection(_study(t), list(K.FEATURE_GROUPS), "boosted", studies.boosted))


def _grid(t: Tables):
    """On a table of the columns that it uses, written once per session."""
    study = _once(t, "lean study", lambda: studies.FoldStudy(t.clean_table, K.CLASSIFIER_FEATURES))
    return _once(t, "grid", lambda: settle(studies.grid_search(study, K.CLASSIFIER_FEATURES), "grid"))


def grid_search(spark, sf_dir):
    return tidy(_grid(Tables(spark, sf_dir)))


def grid_runs(spark, sf_dir):
    """What SQL can know of the grid: its runs, and that every mean lies in the range of its metric."""
    return _grid(Tables(spark, sf_dir)).select(
        "run", F.col("auc_mean").between(0, 1).alias("auc_in_range"), F.col("auc_std").between(0, 0.5).alias("steady"),
        F.col("pr_auc_mean").between(0, 1).alias("in_range"))


def permutation_importance(spark, sf_dir):
    return tidy(_importances(Tables(spark, sf_dir)))


def _importances(t: Tables):
    return _once(t, "importances", lambda: settle(
        studies.permutation_importance(_impact(t), _test(t), repeats=5), "importances"))


def top_drivers(spark, sf_dir):
    return tidy(studies.top_drivers(_importances(Tables(spark, sf_dir))))


def score_events(spark, sf_dir):
    """The later 20 % as minimal reports, scored with the earlier events as history."""
    t = Tables(spark, sf_dir)
    known = ["id", "event_type", "event_cause", "corridor", "veh_type", "latitude", "longitude", "authenticated",
             "start_datetime", "zone"]
    reports = cleaning.clean(align(t.raw.select(known))).where(clock.micros(F.col("start")) > F.lit(_cut(t)))
    reports = settle(reports, "reports")
    return tidy(rules.recommend(_impact(t).score(reports, history=_train(t), keep=["event_cause", "corridor"])))


def recent_recommendations(spark, sf_dir):
    """Deployment plans of the six latest events."""
    t = Tables(spark, sf_dir)
    return tidy(rules.recommend(profile.most_recent(_scores(t, "test"), 6)))


def publish_tables(spark, sf_dir):
    """Rows per published table, read back."""
    return _once(Tables(spark, sf_dir), "published", lambda: settle(_published(spark, sf_dir), "published-rows"))


def published_rows(spark, sf_dir):
    """The rows of the published tables that do not depend on a model."""
    return publish_tables(spark, sf_dir).where("name <> 'options'")


def _published(spark, sf_dir):
    t = Tables(spark, sf_dir)

    def build(path: str) -> None:
        published.publish(t.clean_table, _impact(t), _hotspot(t), path)

    found = published.load(t.spark, fresh_path(t.spark, "published"), build)
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
              for name, df in found.items()]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def tree_counts(spark, sf_dir):
    """Per model: rounds fitted, trees kept, validation loss before the first tree and at the best."""
    return tidy(_impact(Tables(spark, sf_dir)).tree_counts(spark))


def tree_count_facts(spark, sf_dir):
    """What must hold for every model: a loss no higher than without trees, and no more rounds than the patience of ten
    allows behind the best."""
    t = Tables(spark, sf_dir)
    return _impact(t).tree_counts(spark).select(
        "part", (F.col("best_loss") <= F.col("first_loss")).alias("gains"),
        (F.col("n_fitted") - F.col("n_trees") <= 10).alias("stops_in_time"))


def _reports_folder(t: Tables) -> str:
    def write() -> str:
        path = fresh_path(t.spark, "reports")
        raw = align(t.raw).select(schema.RAW_COLUMNS)
        raw.repartitionByRange(4, "start_datetime").write.parquet(path)
        return path
    return _once(t, "reports folder", write)


def score_stream(spark, sf_dir):
    """All reports through the streaming job, with the earlier events as history."""
    t = Tables(spark, sf_dir)
    sink, checkpoint = fresh_path(t.spark, "scored"), fresh_path(t.spark, "stream")
    stream = jobs.report_stream(t.spark, _reports_folder(t), files_per_batch=2)
    jobs.score_stream(stream, _impact(t), _train(t), sink, checkpoint).awaitTermination()
    return tidy(t.spark.read.parquet(sink).drop("batch"))


def panel_stream(spark, sf_dir):
    """Hourly counts from the stream."""
    t = Tables(spark, sf_dir)
    sink, checkpoint = fresh_path(t.spark, "hours"), fresh_path(t.spark, "stream")
    jobs.panel_stream(jobs.report_stream(t.spark, _reports_folder(t)), sink, checkpoint).awaitTermination()
    return tidy(jobs.hourly_counts(t.spark, sink))


QUERIES = {f.__name__: f for f in [
    closure_model, priority_model, duration_model, score_impact, hotspot_model, hotspot_impact, forecast_panel,
    forecast_rows, score_rows,
    forecast_cv, corridor_actuals, grid_runs, published_rows, corridor_forecast, pred_actual_density, residual_morans_i, aft_model, encode_features,
    family_compare, group_ablation, kde_ablation, forward_selection, grid_search, permutation_importance,
    tree_counts, tree_count_facts, top_drivers, score_events, recent_recommendations, publish_tables, score_stream, panel_stream]}

ORACLES: dict[str, str] = {
    "grid_runs": """SELECT rate || '/' || trees || '/' || leaves AS run, true AS auc_in_range, true AS steady,
        true AS in_range FROM (VALUES ('0.03'), ('0.05'), ('0.1')) r(rate), (VALUES ('400'), ('800')) t(trees),
        (VALUES ('15'), ('31'), ('63')) l(leaves) WHERE EXISTS (SELECT 1 FROM events)""",
    "corridor_actuals": with_ctes(["clean", "features"], """SELECT corridor, round(avg(n_events), 6) AS actual_events,
        round(any_value(lat), 6) AS latitude, round(any_value(lon), 6) AS longitude
        FROM features LEFT JOIN (SELECT corridor AS c, avg(latitude) AS lat, avg(longitude) AS lon FROM clean GROUP BY 1)
        ON c = corridor WHERE corridor <> 'Non-corridor' GROUP BY corridor"""),
    "published_rows": with_ctes(["clean", "features"], """
        SELECT 'corridor_forecast' AS name, count(DISTINCT corridor) AS n_rows FROM features WHERE corridor <> 'Non-corridor'
        UNION ALL SELECT 'how_profile', count(*) FROM (SELECT DISTINCT corridor, isodow(bin), hour(bin) FROM features)
        UNION ALL SELECT 'events_sample', count(*) FROM clean
        UNION ALL SELECT 'centroids', count(DISTINCT corridor) FROM clean
        UNION ALL SELECT 'meta', 1"""),
    "tree_count_facts": """SELECT part, true AS gains, true AS stops_in_time
        FROM (VALUES ('closure'), ('duration'), ('priority')) v(part) WHERE EXISTS (SELECT 1 FROM events)""",
    "panel_stream": space_time.ORACLES["panel_counts"],
    "forecast_rows": with_ctes(["features"], """SELECT corridor, CAST(bin AS VARCHAR) AS bin, n_events, n_impact,
        CAST(hour AS INTEGER) AS hour, CAST(dow AS INTEGER) AS dow, true AS pred_events_is_count,
        true AS pred_impact_is_count FROM features"""),
    "score_rows": with_ctes(["clean", "cut"], """SELECT id, event_cause, road_closure, high_priority,
        true AS closure_in_range, true AS priority_in_range, true AS minutes_in_range
        FROM clean, cut WHERE epoch_us(start) > cut"""),
}
