"""Mixes sources to target weights, in DataFrame operations only.

Each source's words form one sequence, cut into blocks of fixed length. A source fills as many slots as its target
needs. How many slots of every output shard are a source's is drawn: the multinomial draw given the sources' totals,
which makes the totals exact to one block instead of exact on average. The drawn counts are a written table; per source
they are added up to the numbers of its slots, and slot j takes block perm(j) of its pass over the source: per source and
pass a pseudorandom permutation of the full blocks, with the shorter last block at the end, so every block is used once
per pass. Words are taken by joining these slots with the blocks of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import WORD, bounded, permuted, running
from kerbline.session import settle

BLOCK_WORDS = 256
SHARD_SLOTS = 4096
_SLOTS_AT_ONCE = 4096
_SLOTS_A_TASK = 1 << 16


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...], total: float, most: float) -> DataFrame:
    """One row per source: sid (rank by code point, null last), source, source_size, target.

    The targets share total * (all sizes) by weight; none exceeds most * (its size). That is target =
    min(most * size, level * weight): sources are taken in the order of most * size / weight, and the level is the one
    behind the last source that stops. One row per source is ordered here, never the documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("sid", F.row_number().over(order)).withColumn("w", w)
    ranked = ranked.withColumn("top", F.col("source_size") * F.lit(float(most)))
    upto = Window.orderBy(F.col("top") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = ranked.withColumn("left_words", F.sum("source_size").over(whole) * F.lit(float(total))
                               - F.coalesce(F.sum("top").over(upto), F.lit(0.0)))
    ranked = ranked.withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    level = F.col("left_words") / F.col("left_w")
    ratio = F.col("top") / F.col("w")
    ranked = ranked.withColumn("level", F.min_by(level, F.when(level <= ratio, F.struct(ratio, "sid"))).over(whole))
    return ranked.select("sid", "source", "source_size",
                         F.least("top", F.coalesce(F.col("level") * F.col("w"), F.col("top"))).alias("target"))


def _plan(sources: DataFrame, block_words: int) -> DataFrame:
    """Per source with slots: sid, n (words), quota (words to take), blocks, count (slots), first and all."""
    plan = sources.where("source_size > 0").select(
        "sid", F.col("source_size").alias("n"), F.round("target").cast("long").alias("quota"))
    plan = plan.withColumn("blocks", F.expr(f"(n + {block_words - 1}) div {block_words}"))
    plan = plan.withColumn("count", F.expr(
        f"(quota div n) * blocks + ((quota % n) + {block_words - 1}) div {block_words}")).where("count > 0")
    plan = plan.withColumn("first", F.coalesce(F.sum("count").over(
        Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return plan.withColumn("all", F.sum("count").over(Window.partitionBy()))


def draw(plan: DataFrame, seed: int, shard_slots: int) -> DataFrame:
    """(shard, sid, n_blocks): the source counts drawn for each output shard of `shard_slots` slots.

    Dealing all slots to the shards by one pseudorandom permutation is this draw: the counts of a shard are multinomial
    given the sources' totals and what other shards have drawn.
    """
    parts = plan.withColumn("part", F.explode(F.expr(f"sequence(0L, (count - 1) div {_SLOTS_AT_ONCE})")))
    tasks = 1 + parts.count() * _SLOTS_AT_ONCE // _SLOTS_A_TASK
    parts = parts.repartition(tasks, F.col("sid"), F.col("part"))
    each = parts.withColumn("j", F.explode(F.expr(
        f"sequence(part * {_SLOTS_AT_ONCE}, least((part + 1) * {_SLOTS_AT_ONCE}, count) - 1)")))
    at = permuted("first + j", "all", f"{seed}L")
    return each.withColumn("at", at).groupBy(F.expr(f"at div {shard_slots}").alias("shard"), "sid").agg(
        F.count("*").alias("n_blocks"))


def slots(plan: DataFrame, drawn: DataFrame, block_words: int, seed: int) -> DataFrame:
    """Every slot of the mix: shard, slot, sid, block, length, take (all words of the block, but in a source's last slot).

    A source's slots are numbered through the shards by what was drawn for it; inside a shard the sources' slots are
    shuffled by one more permutation. The drawn rows are few and small, so tasks follow the slots that they stand for.
    """
    tasks = 1 + (drawn.agg(F.sum("n_blocks")).first()[0] or 0) // _SLOTS_A_TASK
    order = Window.partitionBy("shard").orderBy("sid")
    placed = running(drawn, ["sid"], ["shard"], "n_blocks", "start").withColumns({
        "lead": F.coalesce(F.sum("n_blocks").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "own": F.sum("n_blocks").over(Window.partitionBy("shard"))})
    placed = placed.repartition(tasks, "sid", "shard")
    each = placed.join(bounded(plan), "sid").withColumn("j", F.explode(F.expr("sequence(start, start + n_blocks - 1)")))
    each = each.withColumn("slot", permuted("lead + j - start", "own", f"xxhash64(shard, {seed}L)"))
    each = each.withColumn("pass", F.expr("j div blocks")).withColumn("i", F.expr("j % blocks"))
    each = each.withColumn("block", F.when(F.col("i") == F.col("blocks") - 1, F.col("i")).otherwise(
        permuted("i", "(blocks - 1)", f"xxhash64(sid, pass, {seed}L)")))
    each = each.withColumn("length", F.when(F.col("i") == F.col("blocks") - 1, F.col("n") - F.col("i") * block_words)
                           .otherwise(F.lit(block_words)))
    before = F.col("pass") * F.col("n") + F.col("i") * block_words
    each = each.withColumn("take", F.least(F.col("length"), F.col("quota") - before))
    return each.select("shard", "slot", "sid", "block", "length", "take")


class Mix:
    """The mix of a document table with the columns `key`, `source` and `text`.

    `drawn` are the source counts of every output shard, `slots` what fills them. `pieces` has one row for each block that
    a document touches: row, at (first word in the document), words, full (how often the whole block is taken), part (words
    of the piece taken once more by the source's last slot) and shard (the first one that the block is in).
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
                 weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0,
                 block_words: int = BLOCK_WORDS, seed: int = 7, row: str | None = None,
                 shard_slots: int = SHARD_SLOTS):
        ident = F.col(row) if row else F.monotonically_increasing_id()
        self.rows = settle(docs.select(
            ident.alias("row"), F.col(key).alias("doc_id"), F.col(source).alias("source"),
            word_count(text).alias("size"), F.xxhash64(F.col(text)).alias("hash")), "mix-rows")
        sizes = self.rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.sources = settle(targets(sizes, weights, total, most), "mix-sources")
        plan = settle(_plan(self.sources, block_words), "mix-plan")
        self.drawn = settle(draw(plan, seed, shard_slots), "mix-drawn")
        self.slots = slots(plan, self.drawn, block_words, seed)
        names = self.sources.select(F.col("source").alias("__source"), "sid")
        ranked = self.rows.join(bounded(names), F.col("source").eqNullSafe(F.col("__source")))
        ranked = ranked.drop("__source").where("size > 0")
        placed = running(ranked, ["sid"], ["doc_id", "hash", "size"], "size", "start")
        cut = placed.withColumn("block", F.explode(F.expr(
            f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
        cut = cut.withColumn("lo", F.greatest("start", F.col("block") * block_words))
        cut = cut.withColumn("hi", F.least(F.expr("start + size"), (F.col("block") + 1) * block_words))
        taken = self.slots.groupBy("sid", "block").agg(
            F.count_if(F.col("take") >= F.col("length")).alias("full"),
            F.max(F.when(F.col("take") < F.col("length"), F.col("take")).otherwise(0)).alias("extra"),
            F.min("shard").alias("shard"))
        part = F.least(F.col("hi"), F.col("block") * block_words + F.col("extra")) - F.col("lo")
        # Spark guesses the exploded slots to be as small as the table of sources; they grow with the words
        self.pieces = cut.join(taken.hint("merge"), ["sid", "block"]).select(
            "row", (F.col("lo") - F.col("start")).alias("at"), (F.col("hi") - F.col("lo")).alias("words"), "full",
            F.greatest(part, F.lit(0)).alias("part"), "shard")

    def taken(self) -> DataFrame:
        """Per document row: doc_id, size, source_size, target, taken, first_shard (null if nothing is taken)."""
        words = F.expr("words * full + part")
        sums = self.pieces.groupBy("row").agg(
            F.sum(words).alias("taken"), F.min(F.when(words > 0, F.col("shard"))).alias("first_shard"))
        rows = self.rows.join(sums, "row", "left").withColumnRenamed("source", "__source")
        return rows.join(bounded(self.sources), F.col("__source").eqNullSafe(F.col("source"))).select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
            "first_shard")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, first_shard (the first output shard with words of it).

    Null texts have size 0 and take nothing; a null source is a source of its own, last in order. Repeated rows are
    documents of their own. An empty table gives an empty result. Other columns are not read.
    """
    return Mix(docs, **options).taken()


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, with the columns of `docs`.

    A document comes once for each time that words of it are taken; copy c has the words taken at least c times, with
    the white space before each. A copy with all words has the unchanged text. `n_chars`, if there, follows the text.
    Documents of which nothing is taken go; those without words take no part and go as well.
    """
    kept = docs.columns
    docs = settle(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-texts")
    mix = Mix(docs, row="__row", **options)
    spans = mix.pieces.select("row", "at", F.explode(F.expr(
        "filter(transform(sequence(1L, full + 1), c -> named_struct('copy', c, 'n', if(c <= full, words, part))), "
        "s -> s.n > 0)")).alias("s"))
    spans = spans.groupBy("row", F.col("s.copy").alias("copy")).agg(
        F.sum("s.n").alias("__taken"), F.array_sort(F.collect_list(F.struct("at", F.col("s.n").alias("n")))).alias(
            "__spans"))
    out = docs.join(spans, docs["__row"] == spans["row"])
    whole = F.col("__taken") == word_count("text")
    words = F.regexp_extract_all(F.col("text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    some = F.expr("array_join(flatten(transform(__spans, s -> slice(__words, cast(s.at + 1 as int), "
                  "cast(s.n as int)))), '')")
    out = out.withColumn("__words", F.when(~whole, words)).withColumn("text", F.when(whole, F.col("text")).otherwise(some))
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*kept)
