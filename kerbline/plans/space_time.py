"""Queries on the neighbourhood join, corridor geometry, the panel and time splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline import constants as K
from kerbline.functions import clock
from kerbline.operators import metrics, panel, splits, weights
from kerbline.operators.features import feature_frame
from kerbline.plans.fixture import Tables, tidy
from kerbline.plans.sql import r6, with_ctes


def _near(*names: str):
    def query(spark, sf_dir):
        return tidy(feature_frame(Tables(spark, sf_dir).clean_table, keep=["id"], features=names))
    return query


def corridor_centroids(spark, sf_dir):
    return tidy(weights.corridor_centroids(Tables(spark, sf_dir).clean_table))


def spatial_weights(spark, sf_dir):
    return tidy(Tables(spark, sf_dir).edges)


def panel_counts(spark, sf_dir):
    return tidy(Tables(spark, sf_dir).counts)


def panel_dense(spark, sf_dir):
    return tidy(Tables(spark, sf_dir).panel)


def panel_calendar(spark, sf_dir):
    return tidy(panel.calendar(Tables(spark, sf_dir).panel)
                .select("corridor", "bin", "hour", "dow", "is_weekend", "hour_sin", "hour_cos"))


def panel_lags(spark, sf_dir):
    return tidy(panel.lags(Tables(spark, sf_dir).panel).drop("n_impact"))


def panel_rolls(spark, sf_dir):
    return tidy(panel.rolls(Tables(spark, sf_dir).panel).drop("n_impact"))


def spatial_lag(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tidy(panel.spatial_lags(t.panel, t.edges).select("corridor", "bin", "slag_1", "slag_24"))


def panel_features(spark, sf_dir):
    return tidy(Tables(spark, sf_dir).panel_features)


def seasonal_naive(spark, sf_dir):
    return tidy(panel.seasonal_naive(Tables(spark, sf_dir).panel).drop("n_impact"))


def how_profile(spark, sf_dir):
    return tidy(panel.how_profile(Tables(spark, sf_dir).panel))


def how_matrix(spark, sf_dir):
    """One row per corridor, one column per hour of the week."""
    wide = panel.how_matrix(panel.how_profile(Tables(spark, sf_dir).panel))
    return tidy(wide.select("corridor", *[F.col(f"`{h}`").alias(f"h{h}") for h in range(168)]))


def top_corridors(spark, sf_dir):
    return tidy(panel.top_by_load(Tables(spark, sf_dir).panel))


def top_corridors_how(spark, sf_dir):
    return tidy(panel.top_by_profile(panel.how_profile(Tables(spark, sf_dir).panel)))


def map_columns(spark, sf_dir):
    t = Tables(spark, sf_dir)
    forecast = panel.corridor_forecast(t.panel, weights.corridor_centroids(t.clean_table), K.NO_CORRIDOR)
    return tidy(panel.map_columns(forecast, "actual_events"))


def corridor_mean_baseline(spark, sf_dir):
    """MAE of each corridor's own mean over the test hours."""
    t = Tables(spark, sf_dir)
    cut = splits.time_cut(t.clean_table)
    tested = t.panel.where(clock.micros(F.col("bin")) > cut)
    return tidy(metrics.mae(panel.corridor_means(tested), "n_events", "corridor_mean"))


def forecast_skill(spark, sf_dir):
    """Seasonal-naive MAE after the warm-up and cut, and the skill of the trailing day's mean."""
    t = Tables(spark, sf_dir)
    warm = panel.rolls(panel.lags(t.panel)).where(F.col("lag_168").isNotNull())
    tested = panel.seasonal_naive(warm).where(clock.micros(F.col("bin")) > splits.time_cut(t.clean_table))
    errors = tested.agg(F.avg(F.abs(F.col("n_events") - F.col("roll_24"))).alias("model_mae"),
                        F.avg(F.abs(F.col("n_events") - F.col("snaive"))).alias("naive_mae"))
    return tidy(errors.withColumn("skill", metrics.forecast_skill(F.col("model_mae"), F.col("naive_mae"))))


def pred_actual_corr(spark, sf_dir):
    return tidy(metrics.pearson(Tables(spark, sf_dir).panel_features, "roll_24", "n_events"))


def morans_i(spark, sf_dir):
    """Spatial autocorrelation of the mean residual of the trailing day's mean."""
    t = Tables(spark, sf_dir)
    residual = (t.panel_features.groupBy("corridor")
                .agg(F.avg(F.col("n_events") - F.col("roll_24")).alias("value")))
    return tidy(weights.morans_i(residual, t.edges))


def time_split(spark, sf_dir):
    return splits.time_split(Tables(spark, sf_dir).clean_table).select("id", "part")


def rolling_folds(spark, sf_dir):
    return splits.rolling_folds(Tables(spark, sf_dir).clean_table).select("id", "fold")


def quantile_folds(spark, sf_dir):
    return splits.quantile_folds(Tables(spark, sf_dir).clean_table).select("id", "fold")


def fold_sizes(spark, sf_dir):
    """What each count-based fold tests and trains on."""
    return splits.fold_sizes(splits.quantile_folds(Tables(spark, sf_dir).clean_table), "road_closure")


def union_history(spark, sf_dir):
    """Train and test rows put together again, with the side they came from."""
    train, test = splits.train_test(Tables(spark, sf_dir).clean_table)
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.select("id", "side", "event_cause")


def cv_summary(spark, sf_dir):
    """Mean and spread over time folds of the seasonal-naive MAE of each fold's hours."""
    t = Tables(spark, sf_dir)
    marked = splits.rolling_folds(panel.seasonal_naive(t.panel).withColumnRenamed("bin", "start"))
    per_fold = metrics.mae(marked.where(F.col("fold") >= 0), "n_events", "snaive", by=["fold"])
    return tidy(metrics.fold_summary(per_fold, "mae"))


QUERIES = {
    "hist_density": _near("hist_density_1km", "hist_density_3km"),
    "kde_intensity": _near("kde_intensity"),
    "kde_gathering": _near("kde_gathering"),
    "kde_accident": _near("kde_accident"),
    "kde_closure": _near("kde_closure"),
    "hrs_since_nearby": _near("hrs_since_nearby"),
    **{f.__name__: f for f in [
        corridor_centroids, spatial_weights, panel_counts, panel_dense, panel_calendar, panel_lags, panel_rolls,
        spatial_lag, panel_features, seasonal_naive, how_profile, how_matrix, top_corridors, top_corridors_how, map_columns,
        corridor_mean_baseline, forecast_skill, pred_actual_corr, morans_i, time_split, rolling_folds,
        quantile_folds, fold_sizes, union_history, cv_summary]},
}


def _near_sql(*names: str) -> str:
    picks = ", ".join(n if n.startswith("hist") else f"{r6(n)} AS {n}" for n in names)
    return with_ctes(["neighbourhood"], f"SELECT id, {picks} FROM neighbourhood")


_HOUR = "(isodow(bin) - 1) * 24 + hour(bin)"
_FOLD = """
    , edges_at AS ({edges}),
    folds AS (SELECT *, (epoch_us(start) > e0)::INTEGER + (epoch_us(start) > e1)::INTEGER
        + (epoch_us(start) > e2)::INTEGER + (epoch_us(start) > e3)::INTEGER
        + (epoch_us(start) > e4)::INTEGER - 1 AS fold FROM {table}, edges_at)"""
_TIME_EDGES = """SELECT a + (b - a) * 0.5::DOUBLE AS e0, a + (b - a) * 0.625::DOUBLE AS e1,
    a + (b - a) * 0.75::DOUBLE AS e2, a + (b - a) * 0.875::DOUBLE AS e3, b AS e4
    FROM (SELECT CAST(min(epoch_us(start)) AS DOUBLE) AS a, CAST(max(epoch_us(start)) AS DOUBLE) AS b FROM {table})"""
_COUNT_EDGES = "SELECT " + ", ".join(
    f"quantile_cont(CAST(epoch_us(start) AS DOUBLE), {p}) AS e{i}" for i, p in enumerate(splits.COUNT_EDGES)
) + " FROM {table}"


def _folds(edges: str, table: str = "clean") -> str:
    return _FOLD.format(edges=edges.format(table=table), table=table)


ORACLES = {
    "hist_density": _near_sql("hist_density_1km", "hist_density_3km"),
    "kde_intensity": _near_sql("kde_intensity"),
    "kde_gathering": _near_sql("kde_gathering"),
    "kde_accident": _near_sql("kde_accident"),
    "kde_closure": _near_sql("kde_closure"),
    "hrs_since_nearby": _near_sql("hrs_since_nearby"),
    "corridor_centroids": with_ctes(["centroids"], f"""SELECT corridor, {r6('latitude')} AS latitude,
        {r6('longitude')} AS longitude FROM centroids"""),
    "spatial_weights": with_ctes(["edges"], f"SELECT src, dst, {r6('w')} AS w FROM edges"),
    "panel_counts": with_ctes(["counts"], "SELECT * REPLACE (CAST(bin AS VARCHAR) AS bin) FROM counts"),
    "panel_dense": with_ctes(["panel"], "SELECT * REPLACE (CAST(bin AS VARCHAR) AS bin) FROM panel"),
    "panel_calendar": with_ctes(["lagged"], f"""SELECT corridor, CAST(bin AS VARCHAR) AS bin,
        CAST(hour AS INTEGER) AS hour, CAST(dow AS INTEGER) AS dow, CASE WHEN dow >= 5 THEN 1 ELSE 0 END AS is_weekend,
        {r6('sin(2 * pi() * hour / 24)')} AS hour_sin, {r6('cos(2 * pi() * hour / 24)')} AS hour_cos FROM lagged"""),
    "panel_lags": with_ctes(["lagged"], "SELECT corridor, CAST(bin AS VARCHAR) AS bin, n_events, "
                            + ", ".join(f"lag_{n}" for n in K.PANEL_LAGS) + " FROM lagged"),
    "panel_rolls": with_ctes(["lagged"], "SELECT corridor, CAST(bin AS VARCHAR) AS bin, n_events, "
                             + ", ".join(f"{r6(f'roll_{n}')} AS roll_{n}" for n in K.PANEL_ROLLS) + " FROM lagged"),
    "spatial_lag": with_ctes(["panel", "spread"], f"""SELECT p.corridor, CAST(p.bin AS VARCHAR) AS bin,
        {r6('slag_1')} AS slag_1, {r6('slag_24')} AS slag_24 FROM panel p LEFT JOIN spread s USING (corridor, bin)"""),
    "panel_features": with_ctes(["features"], f"""SELECT corridor, CAST(bin AS VARCHAR) AS bin, n_events, n_impact,
        CAST(hour AS INTEGER) AS hour, CAST(dow AS INTEGER) AS dow, CASE WHEN dow >= 5 THEN 1 ELSE 0 END AS is_weekend,
        {r6('sin(2 * pi() * hour / 24)')} AS hour_sin, {r6('cos(2 * pi() * hour / 24)')} AS hour_cos,
        lag_1, lag_2, lag_3, lag_24, lag_168, {r6('roll_24')} AS roll_24, {r6('roll_168')} AS roll_168,
        {r6('slag_1')} AS slag_1, {r6('slag_24')} AS slag_24 FROM features"""),
    "seasonal_naive": with_ctes(["panel"], """SELECT corridor, CAST(bin AS VARCHAR) AS bin, n_events,
        lag(n_events, 168) OVER (PARTITION BY corridor ORDER BY panel.bin) AS snaive FROM panel"""),
    "how_profile": with_ctes(["panel"], f"""SELECT corridor, CAST({_HOUR} AS INTEGER) AS how,
        {r6('avg(n_events)')} AS mean_value FROM panel GROUP BY 1, 2"""),
    "how_matrix": with_ctes(["panel"], "SELECT corridor, " + ", ".join(
        r6(f"coalesce(avg(n_events) FILTER ({_HOUR} = {h}), 0)") + f" AS h{h}" for h in range(168))
        + " FROM panel GROUP BY 1"),
    "top_corridors": with_ctes(["panel"], f"""SELECT corridor, {r6('avg(n_events)')} AS mean_value FROM panel
        GROUP BY 1 ORDER BY avg(n_events) DESC, corridor LIMIT 8"""),
    "top_corridors_how": with_ctes(["panel"], f"""
        , profile AS (SELECT corridor, {_HOUR} AS how, avg(n_events) AS m FROM panel GROUP BY 1, 2)
        SELECT corridor, {r6('sum(m) / 168')} AS mean_value FROM profile GROUP BY 1
        ORDER BY sum(m) DESC, corridor LIMIT 12"""),
    "map_columns": with_ctes(["panel", "centroids"], f"""
        , load AS (SELECT p.corridor, avg(n_events) AS a, any_value(c.latitude) AS latitude,
            any_value(c.longitude) AS longitude
            FROM panel p JOIN centroids c USING (corridor) WHERE p.corridor <> 'Non-corridor' GROUP BY 1)
        SELECT corridor, {r6('a')} AS actual_events, {r6('latitude')} AS latitude, {r6('longitude')} AS longitude,
          {r6('a / max(a) OVER ()')} AS norm, CAST(floor(40 + 200 * (a / max(a) OVER ())) AS INTEGER) AS r,
          CAST(floor(180 * (1 - a / max(a) OVER ())) AS INTEGER) AS g FROM load"""),
    "corridor_mean_baseline": with_ctes(["panel", "cut"], f"""
        , tested AS (SELECT n_events, avg(n_events) OVER (PARTITION BY corridor) AS m FROM panel, cut
            WHERE epoch_us(bin) > cut)
        SELECT {r6('avg(abs(n_events - m))')} AS mae, count(*) AS n FROM tested"""),
    "forecast_skill": with_ctes(["lagged", "cut"], f"""
        , warm AS (SELECT *, lag(n_events, 168) OVER (PARTITION BY corridor ORDER BY bin) AS snaive
            FROM lagged WHERE lag_168 IS NOT NULL)
        SELECT {r6('avg(abs(n_events - roll_24))')} AS model_mae, {r6('avg(abs(n_events - snaive))')} AS naive_mae,
          {r6('1 - avg(abs(n_events - roll_24)) / avg(abs(n_events - snaive))')} AS skill
        FROM warm, cut WHERE epoch_us(bin) > cut"""),
    "pred_actual_corr": with_ctes(["features"], f"SELECT {r6('corr(roll_24, n_events)')} AS pearson FROM features"),
    "morans_i": with_ctes(["features", "edges"], f"""
        , res AS (SELECT corridor, avg(n_events - roll_24) AS x FROM features GROUP BY 1),
        dev AS (SELECT corridor, x - avg(x) OVER () AS x FROM res)
        SELECT {r6('(SELECT count(*) FROM dev) / (SELECT sum(w) FROM edges) * sum(e.w * a.x * b.x) / (SELECT sum(x * x) FROM dev)')}
          AS morans_i FROM edges e JOIN dev a ON e.src = a.corridor JOIN dev b ON e.dst = b.corridor"""),
    "time_split": with_ctes(["clean", "cut"], """SELECT id,
        CASE WHEN epoch_us(start) <= cut THEN 'train' ELSE 'test' END AS part FROM clean, cut"""),
    "rolling_folds": with_ctes(["clean"], _folds(_TIME_EDGES) + " SELECT id, fold FROM folds"),
    "quantile_folds": with_ctes(["clean"], _folds(_COUNT_EDGES) + " SELECT id, fold FROM folds"),
    "fold_sizes": with_ctes(["clean"], _folds(_COUNT_EDGES) + """
        SELECT t.fold, count(*) AS n_test, any_value((SELECT count(*) FROM folds f WHERE f.fold < t.fold)) AS n_train,
          any_value((SELECT CAST(sum(road_closure) AS BIGINT) FROM folds f WHERE f.fold < t.fold)) AS pos_train
        FROM folds t WHERE t.fold >= 0 GROUP BY 1"""),
    "union_history": with_ctes(["clean", "cut"], """SELECT id,
        CASE WHEN epoch_us(start) <= cut THEN 'train' ELSE 'test' END AS side, event_cause FROM clean, cut"""),
    "cv_summary": with_ctes(["panel"], """
        , naive AS (SELECT n_events, bin AS start, lag(n_events, 168) OVER (PARTITION BY corridor ORDER BY bin) AS s
            FROM panel)""" + _folds(_TIME_EDGES, "naive") + f"""
        , per_fold AS (SELECT fold, avg(abs(n_events - s)) AS mae FROM folds WHERE fold >= 0 GROUP BY 1)
        SELECT {r6('avg(mae)')} AS cv_mean, {r6('stddev_pop(mae)')} AS cv_std, count(mae) AS n_folds FROM per_fold"""),
}
