"""Byte-level BPE and section counts, beside tiktoken and plain Python."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from kerbline.llm import byte_bpe, queries, token_counts

PATTERN = public_tokenizers.PATTERN
TEXTS = ["", None, "Hello  world\n\n  a", "éèß 日本語 한국어 🙂🙂", "x" * 5000, "aaaa aaaaa\t\taaa", "\x0b\x1f   b",
         "it's we'll 12345 ½²", "\U00016ebc ᲋ new letters", "a\r\nb\r\n", "word " * 20000]


@pytest.fixture(scope="module")
def definition():
    return queries.multilingual()


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_tiktoken(definition, library):
    rng = random.Random(4)
    letters = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x30000, 11)]]
    texts = [t or "" for t in TEXTS]
    texts += ["".join(rng.choices(letters, k=25)) for _ in range(2000)]
    texts += ["".join(rng.choices("aab  \n\t'sre.ééß日", k=rng.randint(0, 30))) for _ in range(2000)]
    codec = byte_bpe.codec(definition, PATTERN)
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_round_trip_query(spark, definition, library):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, "", 1), (None, "z", 1)],
                                 "doc_id long, text string, n_tokens int")
    rows = byte_bpe.round_trip(docs, definition, PATTERN).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "z" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.round_trip(docs.limit(0), definition, PATTERN).count() == 0


def test_offsets_and_decoding(spark, definition):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    encoded = byte_bpe.encode(docs, definition, PATTERN)
    codec = byte_bpe.codec(definition, PATTERN)
    for r in encoded.collect():
        text, done = TEXTS[r.doc_id] or "", b""
        for i, s, e in zip(r.ids, r.starts, r.ends):
            own = codec.bytes_of[i]
            assert own in text[s:e].encode() and len(text[:s].encode()) <= len(done)
            done += own
            assert len(text[:e].encode()) >= len(done)
    texts = {r.doc_id: (r.bytes, r.text) for r in byte_bpe.decode(encoded, definition, PATTERN).collect()}
    assert texts == {i: ((t or "").encode(), t or "") for i, t in enumerate(TEXTS)}


def _plain(text, spans, ends, rule):
    counts, crossing = [0] * len(ends), [0] * len(ends)
    section = [next(k for k, e in enumerate(ends) if c < e) for c in range(len(text))]
    for s, e in spans:
        own = section[s:e]
        share = [own.count(k) for k in range(len(ends))]
        k = {"first": own[0], "last": own[-1], "most": share.index(max(share))}[rule]
        counts[k] += 1
        crossing[k] += own[0] != own[-1]
    return counts, crossing


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections(spark, rule):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    texts = [t for t in TEXTS if len(t or "") < 6000] + ["a\n\n\n\nb", "x \n \n\n y\n", "\n", "日\n本\n\n"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, section int")
    got = {}
    for r in token_counts.section_tokens(docs, definition, PATTERN, rule=rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = r
    codec = byte_bpe.codec(definition, PATTERN)
    for i, t in enumerate(texts):
        t = t or ""
        ids = next(codec.encode([t]))
        ends = list(token_counts.line_ends(t))
        assert [t[a:b] for a, b in zip([0, *ends], ends)] == (t.split("\n") and [x for x in _lines(t)])
        counts, crossing = _plain(t, list(zip(*map(np.ndarray.tolist, codec.spans(t, ids)))), ends, rule)
        rows = [got[i][k] for k in range(len(ends))]
        assert [r.n_tokens for r in rows] == counts and [r.n_crossing for r in rows] == crossing
        assert [r.end for r in rows] == ends and sum(counts) == len(ids)
    assert token_counts.section_tokens(docs.limit(0), definition, PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(docs, definition, PATTERN, rule="none")


def _lines(text):
    lines = [x + "\n" for x in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    return lines if lines[-1] or len(lines) == 1 else lines[:-1]
