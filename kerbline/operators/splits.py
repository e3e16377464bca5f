"""Time splits. Folds are marks on rows, so every fold is a filter on one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import clock
from kerbline.operators import ordered

# Fold rules.
COUNT_EDGES = [0.5, 0.625, 0.75, 0.875, 1.0]


def _timed(events: DataFrame) -> DataFrame:
    return events.select(clock.micros(F.col("start")).alias("t"))


def time_cut(events: DataFrame, frac: float = 0.8) -> float:
    """The cut in microseconds."""
    return ordered.quantile_values(_timed(events), "t", [frac])[0]


def time_split(events: DataFrame, frac: float = 0.8) -> DataFrame:
    """`part`: train up to the cut, test after it."""
    return events.withColumn("part", F.when(
        clock.micros(F.col("start")) <= time_cut(events, frac), "train").otherwise("test"))


def train_test(events: DataFrame, frac: float = 0.8) -> tuple[DataFrame, DataFrame]:
    marked = time_split(events, frac)
    return (marked.where(F.col("part") == "train").drop("part"),
            marked.where(F.col("part") == "test").drop("part"))


def _mark(events: DataFrame, edges: list[float]) -> DataFrame:
    """-1 up to the first edge, then the number of the slice (left edge excluded)."""
    t = clock.micros(F.col("start"))
    passed = sum(((t > F.lit(e)).cast("int") for e in edges), F.lit(0))
    return events.withColumn("fold", passed - 1)


def time_edges(events: DataFrame, n_folds: int = 4, min_frac: float = 0.5) -> list[float]:
    """Equal-time edges from `min_frac` of the span to its end."""
    a, b = _timed(events).agg(F.min("t"), F.max("t")).first()
    first = a + (b - a) * min_frac
    return [first + (b - first) * k / n_folds for k in range(n_folds)] + [float(b)]


def rolling_folds(events: DataFrame, n_folds: int = 4, min_frac: float = 0.5) -> DataFrame:
    """`fold`: the slice a row is tested in; fold k trains on every row with a smaller mark."""
    return _mark(events, time_edges(events, n_folds, min_frac))


def quantile_folds(events: DataFrame, probs: list[float] = COUNT_EDGES) -> DataFrame:
    """As `rolling_folds`, with edges at quantiles of the start times."""
    return _mark(events, ordered.quantile_values(_timed(events), "t", probs))


def fold_sizes(marked: DataFrame, label: str | None = None) -> DataFrame:
    """Per fold: rows tested, rows trained on and (with a label) positives trained on."""
    positives = F.sum(F.col(label).cast("bigint")) if label else F.lit(None).cast("bigint")
    slices = marked.groupBy("fold").agg(F.count("*").alias("n"), positives.alias("pos"))
    tested = slices.where(F.col("fold") >= 0).select("fold", F.col("n").alias("n_test"))
    earlier = slices.select(F.col("fold").alias("before"), "n", "pos")
    # A handful of rows on either side: one per fold.
    return (tested.join(F.broadcast(earlier), F.col("before") < F.col("fold"))
            .groupBy("fold", "n_test")
            .agg(F.sum("n").alias("n_train"), F.sum("pos").alias("pos_train")))


def kept_folds(marked: DataFrame, min_test: int, label: str | None = None,
               min_positives: int = 0) -> list[int]:
    """The folds large enough to be evaluated."""
    sizes = fold_sizes(marked, label).where(F.col("n_test") >= min_test)
    if label:
        sizes = sizes.where(F.col("pos_train") >= min_positives)
    return sorted(r["fold"] for r in sizes.select("fold").collect())


def fold_frames(marked: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    return (marked.where(F.col("fold") < fold).drop("fold"),
            marked.where(F.col("fold") == fold).drop("fold"))
