"""The n-gram join and components, beside all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from kerbline import session
from kerbline.llm import components, ngram_join


def _sets(rows, width):
    out = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
        out.setdefault(i, []).append(
            {tuple(words[j:j + width]) for j in range(max(1, len(words) - width + 1))} if words else set())
    return out


def brute(rows, width, percent):
    sets = {i: s[0] for i, s in _sets(rows, width).items() if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def _corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, at = [], 0
    passage = rng.choices(vocabulary, k=60)
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 90, 200, 700]))
        if rng.random() < 0.3:
            words += passage
        for _ in range(rng.choice([1, 1, 2, 4, 12])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5, 20])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((at, rng.choice([" ", "\n", " \t"]).join(copy).upper() if rng.random() < 0.1 else " ".join(copy)))
            at += 1
    rng.shuffle(rows)
    return rows + [(at, None), (at + 1, ""), (at + 2, " \n"), (at + 3, "One two"), (at + 4, "one TWO")]


@pytest.mark.parametrize("seed,width,percent", [(1, 3, 90), (2, 5, 80), (3, 3, 80), (4, 2, 60)])
def test_equal_to_all_pairs(spark, seed, width, percent):
    rows = _corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, h1 int")
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in ngram_join.join_groups(docs, width=width, percent=percent).collect()}
    assert got == brute(rows, width, percent)


def test_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "a b c d"), (3, "x" * 100000), (4, "p q " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.join_groups(docs, width=3, percent=90).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (3, 1, 3), (4, 2, 4)], key=str)
    assert ngram_join.join_groups(docs.limit(0), width=3, percent=90).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    for n in [2, 3, 5, 6, 9, 10, 11, 19, 20, 33, 64, 100, 257, 1000, 3000]:
        for _ in range(25):
            a = ngram_join._mix(rng.integers(1, 1 << 62, n).astype(np.uint64))
            gone = int(rng.integers(0, n - -(-n * percent // 100) + 1))
            b = np.concatenate((a[gone:], ngram_join._mix(rng.integers(1, 1 << 62, int(rng.integers(0, 1 + n // 5)))
                                                          .astype(np.uint64))))
            a, b = np.unique(a), np.unique(b)
            if ngram_join.linked(a, b, percent) and not np.array_equal(a, b):
                (keys_a, own_a), (keys_b, own_b) = (ngram_join.piece_keys(x, percent) for x in (a, b))
                own = own_a if len(a) < len(b) else own_b if len(b) < len(a) else min(own_a, own_b)
                least = own - (len(a) + len(b)) * (100 - percent) // (100 + percent)
                assert len(np.intersect1d(keys_a, keys_b)) >= max(1, least)
                apart = (ngram_join.coarse(a) ^ ngram_join.coarse(b)).view(np.uint64)
                assert sum(int(x).bit_count() for x in apart) <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7)]
    got = {r.node: r.component for r in
           components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in got}
    assert {x for a, b in links if a != b for x in (a, b)} == set(got)


def test_keys_and_pairs_do_not_outlive_the_join(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text), (2, text + " more"), (3, " ".join(f"v{i}" for i in range(80))), (4, text.upper()), (5, None)]
    before = set(session._SETTLED)
    groups = ngram_join.join_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in session._SETTLED if path not in before}
    assert not left & {"sketches", "members", "node-keys", "shared-keys", "near-pairs", "in-pairs", "equal-sets"}
    assert {r.doc_id: r.component_id for r in groups.collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}


def test_keys_are_counted_whole_over_their_parts(spark):
    bits = [0, 1, 2, 3, -1, -2, -3, -4, 7, 7, -7, -7, -7, 10, 10, 5, -(1 << 63), -(1 << 63)]
    found = ngram_join._shared(spark.createDataFrame([(b,) for b in bits], "bit long"))
    assert sorted(map(tuple, found.collect())) == [(-(1 << 63), 2), (-7, 3), (7, 2), (10, 2)]
