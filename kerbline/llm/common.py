"""What several text operators share: reading, text normal forms, running sums and a seeded permutation."""

from __future__ import annotations

import ctypes
import gc
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Words of the contracts: runs of anything but space and the five control characters after the tab.
WORD = r"[^\x20\x09-\x0D]+"

#: Small tables up to this many rows may be broadcast once they have been counted.
BROADCAST_ROWS = 100_000

_CHUNK_ROWS = 1024
_CHUNKS_AT_ONCE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns what a finished task has freed to the system: its worker lives on, and the next stage needs the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty. Pure ASCII takes the quicker built-in."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def bounded(small: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its count is within the bound; beyond it, Spark chooses the join."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def running(rows: DataFrame, by: list[str], order: list[str], weight: str, before: str) -> DataFrame:
    """Adds `before`: the sum of `weight` over the earlier rows of the same `by` values.

    The order is (hash of `order`, `order`): the same for every run and layout. No task holds a whole group: rows are
    dealt into chunks by hash prefix, summed inside their chunk, and the chunks' totals are summed in two levels.
    Rows equal in `order` are interchangeable. `rows` is read twice, so it should be a written table.
    """
    n = rows.count()
    chunks = 1 << max(0, math.ceil(math.log2(max(1, n / _CHUNK_ROWS))))
    rows = rows.withColumn("__h", F.xxhash64(*order)).withColumn("__chunk", F.pmod(F.col("__h"), F.lit(chunks)))
    inside = Window.partitionBy(*by, "__chunk").orderBy("__h", *order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "__chunk").agg(F.sum(weight).alias("__sum"))
    totals = totals.withColumn("__wide", F.expr(f"__chunk div {_CHUNKS_AT_ONCE}"))
    earlier = Window.partitionBy(*by, "__wide").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    wide = totals.groupBy(*by, "__wide").agg(F.sum("__sum").alias("__sum"))
    wide = wide.select(*by, "__wide", F.coalesce(F.sum("__sum").over(
        Window.partitionBy(*by).orderBy("__wide").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("__base"))
    same = [*by, "__wide"]
    totals = totals.withColumn("__in", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).alias("t").join(
        wide.alias("w"), [F.col(f"t.{c}").eqNullSafe(F.col(f"w.{c}")) for c in same])
    totals = totals.select(*[F.col(f"t.{c}").alias(f"__k{i}") for i, c in enumerate(by)],
                           F.col("t.__chunk").alias("__c"), (F.col("__in") + F.col("__base")).alias("__offset"))
    match = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)] + [F.col("__chunk") == F.col("__c")]
    done = rows.withColumn(before, F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(totals, match)
    return done.withColumn(before, F.col(before) + F.col("__offset")).drop(
        "__h", "__chunk", "__c", "__offset", *[f"__k{i}" for i in range(len(by))])


def permuted(index: str, size: str, seed: str, rounds: int = 4) -> Column:
    """A seeded permutation of 0 .. size-1, as SQL: a Feistel network on Z_a x Z_b with cycle walking.

    `index`, `size` and `seed` are SQL expressions of whole numbers, so the size may differ by row. a and b are the
    nearest to a square with a * b >= size, so about one index in a leaves the range; it is walked on until it is back.
    The walk cannot be longer than the a values outside, and only such rows pay for it.
    """
    a = f"greatest(1L, cast(ceil(sqrt(cast({size} as double))) as bigint))"
    b = f"greatest(1L, cast(({size} + {a} - 1L) div {a} as bigint))"
    once = (f"aggregate(sequence(1, {rounds}), named_struct('l', x div {b}, 'r', x % {b}), "
            f"(s, i) -> named_struct('l', (s.l + pmod(xxhash64(s.r, {seed}, i), {a})) % {a}, "
            f"'r', (s.r + pmod(xxhash64((s.l + pmod(xxhash64(s.r, {seed}, i), {a})) % {a}, {seed}, -i), {b})) % {b}), "
            f"s -> s.l * {b} + s.r)")
    first = f"transform(array(cast({index} as bigint)), x -> {once})[0]"
    walk = f"aggregate(sequence(1L, {a}), p, (x, k) -> if(x < {size}, x, {once}))"
    return F.expr(f"transform(array({first}), p -> if(p < {size}, p, {walk}))[0]")
