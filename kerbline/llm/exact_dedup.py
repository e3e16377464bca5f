"""Exact duplicates by two-pass Bloom filtering, in DataFrame operations only.

Pass one hits one bit per text in a sparse filter of 2^44 bits and keeps the bits hit more than once; these are folded
into a second filter of fixed size. Pass two tests every row against it: a row that misses has no equal and goes
straight to the result; only rows that hit are shuffled and compared by SHA-256. A full filter costs time, never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import ascii_lower
from kerbline.session import settle

RESULT = ["keep_id", "group_size", "kept", "text_sha256"]
_FIRST_BITS = 44


def _bit(text: str) -> Column:
    return F.xxhash64(ascii_lower(F.col(text))).bitwiseAND(F.lit((1 << _FIRST_BITS) - 1))


def _word(bit: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(bit, F.lit(1)), F.lit(words))


def _mask(bit: Column) -> Column:
    """Three bits of the 64 in one word, so that a test is one lookup."""
    h = F.xxhash64(bit, F.lit(2))
    three = [F.pmod(F.shiftrightunsigned(h, 20 * i), F.lit(64)).cast("int") for i in range(3)]
    one = [F.call_function("shiftleft", F.lit(1).cast("bigint"), x) for x in three]
    return one[0].bitwiseOR(one[1]).bitwiseOR(one[2])


def fold(bits: DataFrame, words: int) -> DataFrame:
    """A filter of fixed size for the column `bit`: at most `words` rows of (word, 64 bits), 16 bytes each."""
    return bits.groupBy(_word(F.col("bit"), words).alias("__word")).agg(
        F.bit_or(_mask(F.col("bit"))).alias("__mask"))


def repeated(bits: DataFrame) -> DataFrame:
    """The values of the column `bit` that come more than once."""
    return bits.groupBy("bit").agg(F.count("*").alias("n")).where("n > 1").select("bit")


def with_hits(rows: DataFrame, bit: str, folded: DataFrame, words: int) -> DataFrame:
    """Adds `__hit`: whether the filter may hold the value. Values that it holds always hit."""
    rows = rows.withColumn("__word", _word(F.col(bit), words)).join(F.broadcast(folded), "__word", "left")
    hit = F.col("__mask").bitwiseAND(_mask(F.col(bit))) == _mask(F.col(bit))
    return rows.withColumn("__hit", F.coalesce(hit, F.lit(False))).drop("__word", "__mask")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None,
                filter_words: int = 1 << 20) -> DataFrame:
    """Marks the row that stays of each group of texts equal after lower-casing A-Z.

    Returns the columns `carry` (default: `key`) and `RESULT`; a carried column with the name of a result is replaced.
    Null texts count as empty, so they equal each other and the empty text. The largest key stays; null keys are
    smallest; of rows equal in key and text exactly one stays. An empty table gives an empty result.
    `filter_words` bounds what is broadcast: 16 bytes a word.
    """
    carry = [c for c in (carry or [key]) if c not in RESULT]
    words = settle(fold(repeated(docs.select(_bit(text).alias("bit"))), filter_words), "repeated-bits")
    rows = docs.select(*carry, F.col(key).alias("__id"), F.col(text).alias("__text"), _bit(text).alias("__bit"))
    rows = with_hits(rows, "__bit", words, filter_words)
    sha = F.sha2(ascii_lower(F.col("__text")).cast("binary"), 256)
    through = rows.where("not __hit").select(
        *carry, F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        sha.alias("text_sha256"))
    maybe = settle(rows.where("__hit").select(*carry, "__id", sha.alias("text_sha256"),
                                              F.monotonically_increasing_id().alias("__row")), "maybe-repeated")
    groups = settle(maybe.groupBy("text_sha256").agg(
        F.count("*").alias("group_size"), F.max(F.struct("__id", "__row")).alias("__keep")), "equal-texts")
    compared = maybe.join(groups, "text_sha256").select(
        *carry, F.col("__keep.__id").alias("keep_id"), "group_size",
        (F.col("__row") == F.col("__keep.__row")).alias("kept"), "text_sha256")
    return through.unionByName(compared)
