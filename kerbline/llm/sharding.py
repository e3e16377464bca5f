"""A reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import permuted, running
from kerbline.session import settle


def assign(rows: DataFrame, order: list[str], shards: int, seed: int) -> DataFrame:
    """Adds shard and slot to a written table: shards differ by one row at most, slots run from 0 without a gap.

    The global row number comes from the order of (hash, `order`); rows equal in all of `order` are interchangeable.
    Its permuted place p gives shard p mod shards and slot p div shards, so both can be computed from the number alone.
    """
    n = rows.count()
    numbered = running(rows.withColumn("__one", F.lit(1)), [], order, "__one", "__number")
    return numbered.withColumn("__place", permuted("__number", f"{n}L", f"{seed}L")).withColumn(
        "shard", F.pmod(F.col("__place"), F.lit(shards)).cast("int")).withColumn(
        "slot", F.expr(f"__place div {shards}")).drop("__one", "__number", "__place")


def shard_report(docs: DataFrame, shards: int = 24, seed: int = 11) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: counts at most one apart, so grown_shard is null. A null text has no bytes and the checksum of
    the empty text; null ids are ordinary values; repeated rows get slots of their own; an empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = settle(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                              F.crc32(text.cast("binary")).alias("text_crc32"),
                              F.xxhash64(text).alias("__text")), "shard-rows")
    return assign(rows, ["doc_id", "text_crc32", "__text", "size"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
