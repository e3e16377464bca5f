"""Two-dimensional histograms and their smoothing. The grid bounds every table after the count."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin number over [low, high], the last bin closed."""
    width = F.lit((high - low) / bins)
    return F.least(F.floor((value - F.lit(low)) / width), F.lit(bins - 1)).cast("int")


def _range(row, column: str) -> tuple[float, float]:
    """The range of a column; an empty one is widened by one half, as numpy does."""
    low, high = row[f"low_{column}"] or 0.0, row[f"high_{column}"] or 0.0
    return (low, high) if high > low else (low - 0.5, high + 0.5)


def _ranges(df: DataFrame, *columns: str) -> list[tuple[float, float]]:
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns
                   for n, f in (("low", F.min), ("high", F.max))]).first()
    return [_range(row, c) for c in columns]


def grid_counts(points: DataFrame, x: str = "longitude", y: str = "latitude", bins: int = 160) -> DataFrame:
    """(ix, iy, n) of the non-empty cells."""
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    along_x, along_y = _ranges(known, x, y)
    return (known.select(equal_bin(F.col(x), *along_x, bins).alias("ix"),
                         equal_bin(F.col(y), *along_y, bins).alias("iy"))
            .groupBy("ix", "iy").agg(F.count("*").cast("double").alias("n")))


def gaussian_taps(sigma: float = 3.0, truncate: float = 4.0) -> list[tuple[int, float]]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [(k, w / sum(raw)) for k, w in zip(range(-radius, radius + 1), raw)]


def _smooth(cells: DataFrame, axis: str, other: str, bins: int, taps: list[tuple[int, float]]) -> DataFrame:
    """Spread every cell along one axis; the edge reflects (cell -1 mirrors cell 0)."""
    weights = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in taps])
    images = F.array(F.col(axis), -1 - F.col(axis), 2 * bins - 1 - F.col(axis))
    spread = (cells.select(other, "n", F.explode(images).alias("image"), F.lit(1).alias("one"))
              .select(other, "n", "image", F.explode(weights).alias("tap"))
              .select(other, (F.col("image") - F.col("tap.k")).alias(axis), (F.col("n") * F.col("tap.w")).alias("n")))
    return (spread.where(F.col(axis).between(0, bins - 1))
            .groupBy("ix", "iy").agg(F.sum("n").alias("n")))


def kde_surface(points: DataFrame, bins: int = 160, sigma: float = 3.0) -> DataFrame:
    """(ix, iy, intensity) of the smoothed histogram for every one of bins x bins cells; 0 beyond every kernel."""
    taps = gaussian_taps(sigma)
    counts = grid_counts(points, bins=bins)
    smooth = _smooth(_smooth(counts, "iy", "ix", bins, taps), "ix", "iy", bins, taps)
    cells = points.sparkSession.range(bins * bins).select(
        F.expr(f"CAST(id DIV {bins} AS INT)").alias("ix"), F.expr(f"CAST(id % {bins} AS INT)").alias("iy"))
    return cells.join(smooth, ["ix", "iy"], "left").select(
        "ix", "iy", F.coalesce("n", F.lit(0.0)).alias("intensity"))


def density2d(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """Square-binned counts with their decimal logarithm."""
    return (grid_counts(df, x, y, bins)
            .select("ix", "iy", F.col("n").cast("bigint").alias("n"), F.log10("n").alias("log_n")))


def histogram(df: DataFrame, value: str, bins: int = 60) -> DataFrame:
    """(bin, low, high, n) of the non-empty equal bins."""
    known = df.where(F.col(value).isNotNull()).select(value)
    (low, high), = _ranges(known, value)
    counted = (known.select(equal_bin(F.col(value), low, high, bins).alias("bin"))
               .groupBy("bin").agg(F.count("*").alias("n")))
    width = F.lit((high - low) / bins)
    return counted.select("bin", (F.lit(low) + F.col("bin") * width).alias("low"),
                          (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n")
