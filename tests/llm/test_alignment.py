"""Token alignment and corpus-wide pair counts, beside plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

import public_tokenizers
from kerbline.llm import alignment, queries

TEXTS = ["", None, "Hello  world", " lead and trail ", "éèß 日本語 한국어 🙂🙂", "x" * 3000, "\x0b\x1f   b\t\n\n", "▁ a▁b",
         "it's we'll 12345 ½² <s> <|endoftext|> <0x41>", "same text here", "same text here", "¨ ̈ ﬁ é x",
         "the of and the of and " * 300, "   ", " ", "word word　word", "\x00"]


def plain(texts):
    """Rows by the contract, token by token."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    rows, counts = [], Counter()
    for text in texts:
        text = text or ""
        a = tok.encode(" " + text, add_special_tokens=False).ids
        b = sp.encode(text)
        bytes_a = [bytes(back[c] for c in tok.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else
                   sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + text).encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            rows.append(([], [], [], [], ""))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        links = [(a[i], b[j]) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1])
                 if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for lo, hi in zip([0, *ends], ends):
            groups.append(tuple(",".join(str(i) for i, (s, e) in zip(ids, own) if lo <= s and e <= hi)
                                for ids, own in ((a, spans[0]), (b, spans[1]))))
        rows.append((a, b, links, groups, hashlib.sha256(";".join(f"{x}|{y}" for x, y in groups).encode()).hexdigest()))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    done = [(len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links),
             sum(counts[x] for x in links), sha) for a, b, links, groups, sha in rows]
    return done, counts, top, [r[3] for r in rows]


def _random_texts():
    rng = random.Random(11)
    letters = "aab  \n\t'sre.ééß日▁🙂12"
    return ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(150)]


@pytest.mark.parametrize("small_runs", [False, True])
def test_report_and_counts(spark, monkeypatch, small_runs):
    if small_runs:  # many runs and parts
        for name, value in (("RUN_CHARS", 200), ("_PART_CHARS", 500)):
            monkeypatch.setattr(alignment, name, value)
    texts = [t for t in TEXTS if len(t or "") < 7000] + _random_texts()
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, n_a int, part string").repartition(3)
    expected, counts, top, groups = plain(texts)
    vocabularies = queries.two_vocabularies()
    rows = alignment.alignment_report(docs, *vocabularies).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        assert tuple(r)[1:] == expected[r.doc_id], (texts[r.doc_id], tuple(r), expected[r.doc_id])
    pairs = {(r.a_id, r.b_id): (r.n_links, r.highest) for r in alignment.pair_counts(docs, *vocabularies).collect()}
    assert pairs == {p: (n, n == top[p[1]]) for p, n in counts.items()}
    found = {}
    for r in alignment.aligned_groups(docs, *vocabularies).collect():
        found[r.doc_id, r.place] = ",".join(map(str, r.a_ids)), ",".join(map(str, r.b_ids))
    assert found == {(i, k): g for i, own in enumerate(groups) for k, g in enumerate(own)}


def test_stretches_give_what_whole_texts_give(monkeypatch):
    _, _, proto = queries.two_vocabularies()
    pieces = alignment.Pieces(proto)
    monkeypatch.setattr(alignment, "_STRETCH", 7)
    assert pieces.by_word
    for text in [t for t in TEXTS if t] + _random_texts():
        assert pieces.encode(text) == pieces.model.encode(text), text


def test_odd_tables(spark):
    vocabularies = queries.two_vocabularies()
    schema = "doc_id string, text string"
    assert alignment.alignment_report(spark.createDataFrame([], schema), *vocabularies).count() == 0
    rows = alignment.alignment_report(
        spark.createDataFrame([(None, "a b"), (None, "a b"), ("k", None)], schema), *vocabularies).collect()
    by_key = Counter((r.doc_id, r.n_a, r.n_b, r.n_links, r.count_sum) for r in rows)
    assert by_key == {(None, 2, 2, 2, 4): 2, ("k", 0, 0, 0, 0): 1}


def test_merge_in_small_blocks(monkeypatch):
    """The heap merge with blocks and a buffer that are far smaller than the dictionaries."""
    monkeypatch.setattr(alignment, "_BLOCK", 3)
    monkeypatch.setattr(alignment, "_BUFFER", 10)
    rng, n_a = random.Random(5), 50
    dictionaries, expected, owned = [], Counter(), []
    for _ in range(9):
        own = {rng.randrange(40) * n_a + rng.randrange(n_a): rng.randint(1, 3) for _ in range(rng.randint(1, 400))}
        keys = sorted(own)
        run = alignment.Run.__new__(alignment.Run)
        run.key, run.total = np.array(keys), np.array([own[k] for k in keys])
        run.part = np.zeros(len(keys), dtype=np.int64)
        dictionaries.append(next(run.dictionary())[1])
        owned.append(keys)
        expected.update(own)
    top = {b: max(n for k, n in expected.items() if k // n_a == b) for b in {k // n_a for k in expected}}
    back = [[] for _ in dictionaries]
    for pairs, totals, highest, run, own, own_highest in alignment.merged(dictionaries, n_a):
        for k, n, h in zip(pairs.tolist(), totals.tolist(), highest.tolist()):
            assert n == expected[k] and h == (n == top[k // n_a])
        for r, n, h in zip(run.tolist(), own.tolist(), own_highest.tolist()):
            back[r].append((n, h))
    assert back == [[(expected[k], expected[k] == top[k // n_a]) for k in keys] for keys in owned]
