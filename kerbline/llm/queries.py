"""The registered queries of the text operators and their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from kerbline.llm import (alignment, byte_bpe, common, exact_dedup, hard_negatives, language, mixing, ngram_join, page_text, secrets,
                          sharding, token_counts, toxicity, vantage)


def _exact(spark, sf_dir):
    return exact_dedup.exact_dedup(common.table(spark, sf_dir, "documents"))


def _mix(spark, sf_dir):
    return mixing.mix_report(common.table(spark, sf_dir, "documents"))


def _shards(spark, sf_dir):
    return sharding.shard_report(common.table(spark, sf_dir, "documents"))


def multilingual() -> str:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.from_ranks(ranks, public_tokenizers.PATTERN)


def _codec(spark, sf_dir):
    return byte_bpe.round_trip(common.table(spark, sf_dir, "documents"), multilingual(), public_tokenizers.PATTERN)


def _section_tokens(spark, sf_dir):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as definition:
        return token_counts.section_tokens(
            common.table(spark, sf_dir, "documents"), definition.read(), public_tokenizers.PATTERN)


def _language(spark, sf_dir):
    return language.language_report(
        common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _toxicity(spark, sf_dir):
    return toxicity.toxicity_report(
        common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def _secrets(spark, sf_dir):
    return secrets.scan(common.table(spark, sf_dir, "documents"))


def _ngrams(spark, sf_dir):
    return ngram_join.join_groups(common.table(spark, sf_dir, "documents"), width=3, percent=90)


def _neighbours(spark, sf_dir):
    return vantage.neighbour_report(common.table(spark, sf_dir, "embeddings"))


def two_vocabularies() -> tuple[str, str, bytes]:
    """The byte-level definition, its pattern, and the piece model whose tokens are aligned."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as definition:
        with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as model:
            return definition.read(), public_tokenizers.PATTERN, model.read()


def _alignment(spark, sf_dir):
    return alignment.alignment_report(common.table(spark, sf_dir, "documents"), *two_vocabularies())


def _hard_negatives(spark, sf_dir):
    return hard_negatives.hard_negatives(common.table(spark, sf_dir, "embeddings"))


def _page_text(spark, sf_dir):
    return page_text.page_text(common.table(spark, sf_dir, "pages"))


def _mix_targets(spark, sf_dir):
    """The part of the mix that SQL can know: sizes and targets."""
    return _mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def _shard_counts(spark, sf_dir):
    """The law of the shards: their counts, with the lowest and highest slot."""
    return _shards(spark, sf_dir).groupBy("law", "shard").agg(
        F.count("*").alias("n_rows"), F.min("slot").alias("low"), F.max("slot").alias("high"),
        F.countDistinct("slot").alias("n_slots"), F.sum("size").isNotNull().alias("sized"))


def _section_spans(spark, sf_dir):
    """Where the sections of the token counts begin and end."""
    return _section_tokens(spark, sf_dir).select("doc_id", "section", "start", "end")


QUERIES = {
    "op1_exact_dedup": _exact,
    "op2_source_mix": _mix,
    "op3_toxicity": _toxicity,
    "op4_secrets": _secrets,
    "op5_language": _language,
    "op6_vantage_trees": _neighbours,
    "op7_byte_bpe": _codec,
    "op8_ngram_join": _ngrams,
    "op9_feistel_shards": _shards,
    "op10_section_tokens": _section_tokens,
    "op11_token_alignment": _alignment,
    "op12_hard_negatives": _hard_negatives,
    "op13_page_text": _page_text,
    "mix_targets": _mix_targets,
    "shard_counts": _shard_counts,
    "section_spans": _section_spans,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Right as a search over all pairs; the trees reach these rows because they leave out nothing on such vectors.
_SEARCH = """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
        FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 20"""

_LINKED = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
          FROM w WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
          GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
          WHERE 100 * c >= 90 * (a.n + b.n - c)),
    both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
    FROM documents d LEFT JOIN n USING (doc_id)
    LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY 1) m ON m.x = d.doc_id"""

_NEGATIVES = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
        FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (
            PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
            AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
    SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

_TARGETS = r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
               FROM documents),
    s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS sid
          FROM d GROUP BY source),
    w AS (SELECT *, [3.0, 1.0, 2.0][(sid - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS top FROM s),
    r AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER o, 0))
                    / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
          FROM w WINDOW o AS (ORDER BY top / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT level FROM r WHERE level <= top / w ORDER BY top / w, sid LIMIT 1)
    SELECT doc_id, size, source_size::BIGINT AS source_size,
           round(least(top, coalesce((SELECT level FROM l) * w, top)), 6) AS target
    FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source"""

_SHARD_COUNTS = """
    WITH n AS (SELECT count(*) AS n FROM documents),
    c AS (SELECT i, (n - i + 23) // 24 AS c FROM n, range(24) t(i))
    SELECT 'rows' AS law, i::INT AS shard, c::BIGINT AS n_rows, 0::BIGINT AS low, (c - 1)::BIGINT AS high,
           c::BIGINT AS n_slots, true AS sized FROM c WHERE c > 0"""

_SPANS = """
    WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
    q AS (SELECT doc_id, CASE WHEN len(p) > 1 AND p[-1] = '' THEN list_transform(p[:-2], lambda x: len(x) + 1)
                 ELSE list_append(list_transform(p[:-2], lambda x: len(x) + 1), len(p[-1])) END AS n FROM p)
    SELECT doc_id, (i - 1)::BIGINT AS section, coalesce(list_sum(n[:i - 1]), 0)::BIGINT AS start,
           list_sum(n[:i])::BIGINT AS "end"
    FROM (SELECT doc_id, n, unnest(range(1, len(n) + 1)) AS i FROM q)"""

ORACLES = {
    "mix_targets": _TARGETS,
    "shard_counts": _SHARD_COUNTS,
    "section_spans": _SPANS,
    "op12_hard_negatives": _NEGATIVES,
    "op8_ngram_join": _LINKED,
    "op6_vantage_trees": _SEARCH,
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}
