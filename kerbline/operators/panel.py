"""The corridor by hour panel and its features.

Hours are local wall-clock hours. A corridor's window holds at most one row per hour of the
covered time, however many events the corridor has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.constants import PANEL_LAGS, PANEL_ROLLS, SEASON, SPATIAL_LAGS
from kerbline.functions import clock


def _by_hour():
    return W.partitionBy("corridor").orderBy("bin")


def panel_counts(clean_events: DataFrame) -> DataFrame:
    """(corridor, bin, n_events, n_impact) for hours with events."""
    return clean_events.groupBy(
        "corridor", F.date_trunc("hour", "start").cast("timestamp_ntz").alias("bin")
    ).agg(F.count("*").alias("n_events"), F.sum(F.col("road_closure").cast("bigint")).alias("n_impact"))


def panel_dense(counts: DataFrame) -> DataFrame:
    """Every corridor at every hour between the first and the last, absent counts as 0."""
    first, last = counts.agg(F.min("bin")).scalar(), counts.agg(F.max("bin")).scalar()
    grid = (counts.select("corridor").distinct()
            .select("corridor", F.explode(F.sequence(first, last, F.expr("interval 1 hour"))).alias("bin")))
    return grid.join(counts, ["corridor", "bin"], "left").fillna(0, ["n_events", "n_impact"])


def calendar(panel: DataFrame) -> DataFrame:
    hour, dow = F.hour("bin"), F.weekday("bin")
    hour_sin, hour_cos = clock.cycle(hour, 24)
    return panel.withColumns({"hour": hour, "dow": dow, "is_weekend": clock.is_weekend(dow),
                              "hour_sin": hour_sin, "hour_cos": hour_cos})


def lags(panel: DataFrame, hours: list[int] = PANEL_LAGS) -> DataFrame:
    return panel.withColumns({f"lag_{n}": F.lag("n_events", n).over(_by_hour()).cast("double") for n in hours})


def rolls(panel: DataFrame, widths: list[int] = PANEL_ROLLS) -> DataFrame:
    """Trailing means over the hours before the current one."""
    return panel.withColumns({
        f"roll_{n}": F.avg("n_events").over(_by_hour().rowsBetween(-n, -1)) for n in widths})


def spatial_lags(panel: DataFrame, edges: DataFrame, hours: list[int] = SPATIAL_LAGS) -> DataFrame:
    """Weighted counts of the neighbouring corridors some hours earlier.

    Null for the first hours and for corridors outside the edge list; neighbours without a
    panel add nothing. The edge list has k rows per corridor.
    """
    lagged = lags(panel.select("corridor", "bin", "n_events"), hours)
    spread = (edges.join(lagged, edges.dst == lagged.corridor)
              .groupBy(F.col("src").alias("corridor"), "bin")
              .agg(*[F.sum(F.col("w") * F.col(f"lag_{n}")).alias(f"slag_{n}") for n in hours]))
    return panel.join(spread, ["corridor", "bin"], "left")


def panel_features(clean_events: DataFrame, edges: DataFrame, warm: bool = True) -> DataFrame:
    """The full panel feature table; `warm` drops the hours without a same-hour-last-week count."""
    panel = panel_dense(panel_counts(clean_events))
    made = spatial_lags(rolls(lags(calendar(panel))), edges)
    return made.where(F.col(f"lag_{SEASON}").isNotNull()) if warm else made


def seasonal_naive(panel: DataFrame, season: int = SEASON) -> DataFrame:
    """Each hour's forecast is the corridor's count `season` hours earlier."""
    return panel.withColumn("snaive", F.lag("n_events", season).over(_by_hour()))


def corridor_means(panel: DataFrame, value: str = "n_events", name: str = "corridor_mean") -> DataFrame:
    return panel.withColumn(name, F.avg(value).over(W.partitionBy("corridor")))


def corridor_forecast(panel: DataFrame, centroids: DataFrame, no_corridor: str) -> DataFrame:
    """Mean load per named corridor with its centroid; predicted columns if there are any."""
    means = {"actual_events": "n_events", "pred_events": "pred_events", "pred_impact": "pred_impact"}
    return (panel.where(F.col("corridor") != no_corridor).groupBy("corridor")
            .agg(*[F.avg(c).alias(name) for name, c in means.items() if c in panel.columns])
            .join(centroids, "corridor", "left"))


def how_profile(panel: DataFrame, value: str = "n_events") -> DataFrame:
    """Mean per corridor and hour of the week, in long form."""
    return (panel.groupBy("corridor", clock.hour_of_week(F.col("bin")).alias("how"))
            .agg(F.avg(value).alias("mean_value")))


def how_matrix(profile: DataFrame) -> DataFrame:
    """The profile as one row per corridor and 168 columns, absent hours as 0."""
    return (profile.groupBy("corridor").pivot("how", list(range(168)))
            .agg(F.first("mean_value")).na.fill(0.0))


def top_by_load(panel: DataFrame, value: str = "n_events", most: int = 8) -> DataFrame:
    return (panel.groupBy("corridor").agg(F.avg(value).alias("mean_value"))
            .orderBy(F.desc("mean_value"), "corridor").limit(most))


def top_by_profile(profile: DataFrame, most: int = 12) -> DataFrame:
    """Corridors by the mean of their 168 hour-of-week values, absent hours as 0."""
    return (profile.groupBy("corridor").agg((F.sum("mean_value") / F.lit(168.0)).alias("mean_value"))
            .orderBy(F.desc("mean_value"), "corridor").limit(most))


def map_columns(forecast: DataFrame, value: str = "pred_events") -> DataFrame:
    """Bar height share and colour parts of the corridor map."""
    peak = forecast.agg(F.coalesce(F.nullif(F.max(value), F.lit(0.0)), F.lit(1.0))).scalar()
    scaled = forecast.withColumn("norm", F.col(value) / peak)
    return scaled.withColumns({
        "r": (40 + 200 * F.col("norm")).cast("int"),
        "g": (180 * (1 - F.col("norm"))).cast("int")})
