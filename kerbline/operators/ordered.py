"""Running totals, ranks and exact quantiles over an ordering without a partition key.

A window that orders a whole table runs in one task. Here equal keys are added up first, the
distinct keys are cut into slices at approximate quantiles of the rows, each slice is a window of
its own, and the totals of earlier slices are added. The quantiles only balance the work (a slice
holds about rows / slices rows, and a frequent key is one row by then); results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.session import lookup

_MOST_SLICES = 512


def _slice_count(df: DataFrame) -> int:
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, min(configured, _MOST_SLICES))


def slice_limits(key: str, slices: int) -> Column:
    """The limits between slices of about equal row counts, as an aggregate."""
    cuts = ", ".join(f"{i / slices!r}D" for i in range(1, slices))
    return F.expr(f"percentile_approx(CAST(`{key}` AS DOUBLE), array({cuts}), 10000)")


def bucketed(df: DataFrame, value: str, limits: Sequence[float], bucket: str) -> DataFrame:
    """The number of (distinct) limits at or below the value, by binary search."""
    splits = [float("-inf"), *sorted({float(x) for x in limits if x is not None}), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_value", outputCol=bucket).transform(
        df.withColumn("_value", F.col(value).cast("double")))
    return placed.withColumn(bucket, F.col(bucket).cast("int")).drop("_value")


def running_totals(df: DataFrame, key: str, sums: dict[str, Column],
                   by: Sequence[str] = (), few_groups: bool = False) -> DataFrame:
    """One row per (by, key): every sum, `<sum>_before`, its total over smaller keys, and
    `<sum>_total`, its total over all keys.

    `few_groups` keeps slice limits per group; they are counted, and broadcast only within the
    bound of lookups. Otherwise the slice limits are shared by all groups and are found by a
    small job of their own.
    """
    by = list(by)
    slices = _slice_count(df)
    known = df.where(F.col(key).isNotNull())
    tallied = known.groupBy(*by, key).agg(*[c.alias(name) for name, c in sums.items()])
    limits = slice_limits(key, slices).alias("_limits")
    if by and few_groups:
        per_group = lookup(known.groupBy(*by).agg(limits), "slice-limits")
        placed = tallied.join(per_group, by).withColumn(
            "_slice", F.size(F.filter("_limits", lambda limit: limit <= F.col(key)))).drop("_limits")
    else:
        found = known.agg(limits).first()["_limits"]
        placed = bucketed(tallied, key, found or [], "_slice")

    groups = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    earlier = groups.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = (placed.groupBy(*by, "_slice")
               .agg(*[F.sum(name).alias(f"_{name}") for name in sums]))
    carried = carried.select(
        *by, "_slice",
        *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums],
        *[F.sum(f"_{name}").over(groups).alias(f"{name}_total") for name in sums])
    if not by:
        carried = F.broadcast(carried)  # one row per slice

    within = W.partitionBy(*by, "_slice").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    local = placed.select("*", *[
        F.coalesce(F.sum(name).over(within), F.lit(0)).alias(f"{name}_before") for name in sums])
    return (local.join(carried, [*by, "_slice"])
            .select(*by, key, *sums,
                    *[(F.col(f"{name}_before") + F.col(f"_{name}")).alias(f"{name}_before") for name in sums],
                    *[f"{name}_total" for name in sums]))


def average_ranks(df: DataFrame, key: str, by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """(by, key, rank): 1-based ranks, equal keys sharing their mean."""
    totals = running_totals(df, key, {"n": F.count("*")}, by)
    return totals.select(*by, key, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(rank))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
              few_groups: bool = False) -> DataFrame:
    """Exact linear-interpolation quantiles: one row per (by, prob)."""
    by = list(by)
    totals = running_totals(df, value, {"n": F.count("*")}, by, few_groups)
    totals = totals.withColumn("_probs", F.array(*[F.lit(float(p)) for p in probs]))

    def rank(prob: Column) -> Column:
        return (F.col("n_total") - 1) * prob

    def covers(at: Column) -> Column:
        return (at >= F.col("n_before")) & (at < F.col("n_before") + F.col("n"))

    # Each order statistic lies in exactly one row, so this yields at most 2 x probs rows a group.
    found = (totals
             .withColumn("_probs", F.filter("_probs", lambda p: covers(F.floor(rank(p))) | covers(F.ceil(rank(p)))))
             .where(F.size("_probs") > 0)
             .select(*by, F.col(value).cast("double").alias("_value"), "n", "n_before", "n_total",
                     F.explode("_probs").alias("prob")))
    at = rank(F.col("prob"))
    ends = found.groupBy(*by, "prob").agg(
        F.max(F.when(covers(F.floor(at)), F.col("_value"))).alias("_low"),
        F.max(F.when(covers(F.ceil(at)), F.col("_value"))).alias("_high"),
        F.max(at - F.floor(at)).alias("_part"))
    return ends.select(*by, "prob", (
        F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("quantile"))


def quantile_values(df: DataFrame, value: str, probs: Sequence[float]) -> list[float | None]:
    """The quantiles as numbers, in the order of `probs`: one small result."""
    found = {row["prob"]: row["quantile"] for row in quantiles(df, value, sorted(set(probs))).collect()}
    return [found.get(float(p)) for p in probs]
