"""Stages of the corpus pipeline, and the registration."""

import re
from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
from test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_registered():
    numbers = [int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in entry.queries()) if m]
    assert sorted(numbers) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language"](spark, docs, SF)
    assert known.columns == docs.columns and known.count() >= 0.98 * docs.count()
    once = stage["exact dedup"](spark, known, SF)
    rows = known.collect()
    keep = {}
    for r in rows:
        keep[r.text.lower()] = max(r.doc_id, keep.get(r.text.lower(), -1))
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == sorted(keep.values())
    alone = stage["near copies"](spark, once, SF)
    groups = brute([(r.doc_id, r.text) for r in once.collect()], 5, 80)
    assert alone.columns == docs.columns
    assert sorted(r.doc_id for r in alone.collect()) == sorted({c for _, c in groups.values()})
    mixed = stage["source mix"](spark, alone, SF)
    assert mixed.columns == docs.columns
    words = lambda df: Counter({r.source: r.n for r in df.selectExpr(
        "source", r"regexp_count(text, '[^\\x20\\x09-\\x0D]+') AS n").groupBy("source").agg({"n": "sum"})
        .withColumnRenamed("sum(n)", "n").collect()})
    before, after = words(alone), words(mixed)
    assert abs(sum(after.values()) - 1.5 * sum(before.values())) <= len(before)
    assert all(after[s] <= 2 * before[s] for s in before)
    done = stage["tokens"](spark, mixed, SF)
    assert done.count() == mixed.count() and done.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the same words here", None, None, 19),
            (3, "the same words here", None, None, 19), (None, "THE same words here", "en", "a", 19),
            (4, "12 34 !!", "en", "b", 8), (5, "long " * 40000, "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long"
    for table in ([(*r, 0.1, 9) for r in rows], []):
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = stage(spark, docs, SF)
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_near_copies_with_one_id_for_two_texts(spark):
    a, b = (" ".join(f"{w}{k}" for k in range(60)) for w in ("eins", "zwei"))
    rows = [(5, a), (1, a + " mehr"), (5, "ganz andere worte stehen hier als sonst"), (7, b), (5, b + " mehr"),
            (None, a + " noch"), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near copies"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter([rows[1], rows[2], rows[4], rows[5], rows[6]])


def test_columns_named_as_those_of_operators(spark):
    rows = [(1, "ein text hier", "a", "k1", 11, 12, "s1", 13, 14), (2, "noch ein text", "a", "k2", 21, 22, "s2", 23, 24),
            (3, "noch ein text", "a", "k3", 31, 32, "s3", 33, 34)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, keep_id long, "
                                 "group_size long, text_sha256 string, row long, copy long")
    stage = dict(corpus_pipeline.STAGES)
    once = stage["exact dedup"](spark, docs, SF)
    assert once.columns == docs.columns and sorted(map(tuple, once.collect())) == [rows[0], rows[2]]
    mixed = stage["source mix"](spark, once, SF)
    assert mixed.columns == docs.columns
    assert {r[3:] for r in map(tuple, mixed.collect())} <= {r[3:] for r in rows}
