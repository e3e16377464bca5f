"""Profiling and descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.functions import clock
from kerbline.operators import ordered

# Percentiles of the describe tables.
DURATION_PERCENTILES = [0.25, 0.5, 0.75, 0.9, 0.95]
QUARTILES = [0.25, 0.5, 0.75]
LEAD_PERCENTILES = [0.5, 0.9]


def frequency(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    counted = df.groupBy(column).agg(F.count("*").alias("n_events"))
    return counted.orderBy(F.desc("n_events"), column).limit(most) if most else counted


def rate_by(df: DataFrame, column: str, flag: str, name: str) -> DataFrame:
    return df.groupBy(column).agg(F.avg(flag).alias(name), F.count("*").alias("n_events"))


def closure_rate_by_cause(clean_events: DataFrame, least: int = 30, most: int = 12) -> DataFrame:
    """The causes with at least `least` events, top by rate."""
    rates = rate_by(clean_events, "event_cause", "road_closure", "closure_rate")
    return (rates.where(F.col("n_events") >= least)
            .orderBy(F.desc("closure_rate"), "event_cause").limit(most))


def daily_volume(clean_events: DataFrame, types: Sequence[str]) -> DataFrame:
    """Events per observed day, one column per event type."""
    return (clean_events.groupBy(F.to_date("start").alias("day"))
            .pivot("event_type", list(types)).agg(F.count("start")).na.fill(0))


def rolling_means(daily: DataFrame, columns: Sequence[str], width: int = 3) -> DataFrame:
    """Means over the last observed days; null until there are `width` of them.

    The table has one row per observed day, so a single ordered window is small.
    """
    recent = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(1 - width, 0)
    return daily.select("day", *[
        F.when(F.count(F.lit(1)).over(recent) == width, F.avg(c).over(recent)).alias(f"{c}_mean")
        for c in columns])


def hour_dow_counts(clean_events: DataFrame) -> DataFrame:
    return clean_events.groupBy(F.weekday("start").alias("dow"), F.hour("start").alias("hour")).agg(
        F.count("id").alias("n_events"))


def hour_dow_matrix(clean_events: DataFrame) -> DataFrame:
    """One row per weekday, 24 columns, absent hours as 0."""
    timed = clean_events.select(F.weekday("start").alias("dow"), F.hour("start").alias("hour"), "id")
    return timed.groupBy("dow").pivot("hour", list(range(24))).agg(F.count("id")).na.fill(0)


def monthly_cause_trend(clean_events: DataFrame, most: int = 6) -> DataFrame:
    """(month, event_cause, n_events) for the most frequent causes, absent months as 0."""
    top = frequency(clean_events, "event_cause", most).select("event_cause")
    month = F.date_format("start", "yyyy-MM").alias("month")
    counted = (clean_events.join(F.broadcast(top), "event_cause", "left_semi")
               .groupBy(month, "event_cause").agg(F.count("*").alias("n_events")))
    months = clean_events.select(month).distinct()
    names = top.agg(F.sort_array(F.collect_list("event_cause"))).scalar()  # `most` names
    grid = months.withColumn("_names", names).select("month", F.explode("_names").alias("event_cause"))
    return grid.join(counted, ["month", "event_cause"], "left").fillna(0, ["n_events"])


def null_profile(raw: DataFrame) -> DataFrame:
    """(column, null_fraction), all columns in one pass."""
    shares = raw.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in raw.columns])
    return shares.unpivot([], raw.columns, "column", "null_fraction")


def value_profile(raw: DataFrame, columns: Sequence[str], most: int = 12) -> DataFrame:
    """(column, value, n, n_distinct): top values incl. null and the number of non-null values."""
    long = raw.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value")
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    distinct = counted.groupBy("column").agg(F.count("value").alias("n_distinct"))
    order = W.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    top = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return top.join(F.broadcast(distinct), "column").select("column", "value", "n", "n_distinct")


def distinct_counts(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    long = raw.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value")
    return (long.distinct().groupBy("column").agg(F.count("value").alias("n_distinct")))


def describe(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
             by: Sequence[str] = ()) -> DataFrame:
    """(by, column, statistic, value): count, mean, std, min, exact percentiles, max."""
    by = list(by)
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        by, list(columns), "column", "x")
    keys = [*by, "column"]
    stats = long.groupBy(*keys).agg(
        F.count("x").cast("double").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    names = ["count", "mean", "std", "min", "max"]
    percentiles = ordered.quantiles(long, "x", probs, keys).select(
        *keys, F.concat(F.lit("p"), F.bround(F.col("prob") * 100, 0).cast("int").cast("string")).alias("statistic"),
        F.col("quantile").alias("value"))
    return stats.unpivot(keys, names, "statistic", "value").unionByName(percentiles)


def dataset_meta(clean_events: DataFrame) -> DataFrame:
    """Size, span and events per whole day."""
    row = clean_events.agg(F.count("*").alias("n_events"), F.min("start").alias("a"), F.max("start").alias("b"))
    days = F.floor((clock.micros(F.col("b")) - clock.micros(F.col("a"))) / F.lit(86.4e9))
    return row.select("n_events", F.to_date("a").alias("date_min"), F.to_date("b").alias("date_max"),
                      F.try_divide(F.col("n_events"), days).alias("events_per_day"))


def option_lists(clean_events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(option, value): the distinct values of each column."""
    return (clean_events.select(*columns).unpivot([], list(columns), "option", "value")
            .where(F.col("value").isNotNull()).distinct())


def most_recent(clean_events: DataFrame, most: int = 6) -> DataFrame:
    return clean_events.orderBy(F.desc("start"), F.desc("id")).limit(most)


def filter_by_cause(clean_events: DataFrame, causes: Sequence[str]) -> DataFrame:
    """Events of the chosen causes; no choice keeps all."""
    return clean_events.where(F.col("event_cause").isin(list(causes))) if causes else clean_events


def closure_points(clean_events: DataFrame) -> DataFrame:
    return clean_events.select("id", "longitude", "latitude", (F.col("road_closure") == 1).alias("is_closure"))


def events_sample(clean_events: DataFrame) -> DataFrame:
    return clean_events.select("latitude", "longitude", "event_cause", "corridor", "road_closure",
                               F.col("start").cast("string").alias("start"))


def recency_weight(clean_events: DataFrame, days: float = 60.0) -> DataFrame:
    """exp(-age / days), age counted back from the latest start."""
    latest = clean_events.agg(clock.micros(F.max("start"))).first()[0]
    age = (F.lit(latest) - clock.micros(F.col("start"))) / F.lit(86.4e9)
    return clean_events.withColumn("recency_weight", F.exp(-age / F.lit(days)))
