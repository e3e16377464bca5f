"""The corpus pipeline: language, exact copies, near copies, source mix, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows of `docs`, and returns the columns of the documents; the last
returns token counts and digests. The tables in `sf_dir` are not read by the stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import byte_bpe, exact_dedup, language, mixing, ngram_join
from kerbline.llm.queries import multilingual
from kerbline.session import discard, free_shuffles, settle


def _names(docs: DataFrame) -> dict[str, str]:
    """Names for the columns that no operator gives to its own."""
    return {c: f"c{i}" for i, c in enumerate(docs.columns)}


def _select(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(c).alias(n) for c, n in names.items()])


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told stay; those without letters or without a likely language go."""
    return language.known_language(docs, public_tokenizers.path("piece_bpe_32k.model"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the largest id."""
    names = _names(docs)
    marked = exact_dedup.exact_dedup(_select(docs, names), text=names["text"], key=names["doc_id"],
                                     carry=list(names.values()))
    return _select(marked.where("kept"), {n: c for c, n in names.items()})


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 of five-word shingles stays: the one with the smallest id.

    Rows are linked and dropped by a row id of their own, so different texts of one id are documents apart; of rows
    with the smallest id in a group one stays. Rows with a null id are linked with nothing and stay.
    """
    rows = settle(docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    groups = ngram_join.join_groups(rows.where("doc_id is not null"), key="__row", width=5, percent=80)
    others = settle(groups.where("__row <> component_id").select("__row", "component_id"), "near-others")
    free_shuffles(spark)
    first = others.select("component_id").distinct().select(F.col("component_id").alias("__row"), "component_id")
    linked = settle(others.unionByName(first).join(rows.select("__row", F.col("doc_id").alias("__id")), "__row"),
                    "near-linked")
    stay = linked.groupBy("component_id").agg(F.min(F.struct("__id", "__row")).alias("__stay")).select("__stay.__row")
    gone = settle(linked.select("__row").join(stay, "__row", "left_anti"), "near-copies")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and with the words, that the mix of the sources takes."""
    names = {**_names(docs), **{c: c for c in docs.columns if c in ("doc_id", "source", "text", "n_chars")}}
    return _select(mixing.mixed_texts(_select(docs, names)), {n: c for c, n in names.items()})


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per mixed document: doc_id, n_tokens and digests of its ids and of what they decode to."""
    return byte_bpe.round_trip(docs, multilingual(), public_tokenizers.PATTERN)


STAGES = [("language", keep_languages), ("exact dedup", drop_copies), ("near copies", drop_near_copies),
          ("source mix", mix), ("tokens", tokens)]

#: The language and token stages are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
        free_shuffles(spark)
    return docs
