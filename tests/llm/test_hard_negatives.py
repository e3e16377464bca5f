"""Hard negatives beside plain Python, with ties, odd rows and small shards."""

import math
import random

import numpy as np
import pytest

from kerbline.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def plain(rows, every=50, positives=5, negatives=3):
    good = []
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        good.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(c))) for c in x)))
    good = sorted(set(good))
    out = []
    for a in good:
        if a[0] % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], c[2])), c[0], c[1]) for c in good if c is not a and len(c[2]) == len(a[2])]
        scored.sort()
        for s, p, _ in [r for r in scored if r[2] == a[1]][:positives]:
            inside = [r for r in scored if r[2] != a[1] and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            out += [(a[0], p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(inside)]
    return sorted(out)


def _spread(rng, n, dims):
    return [(i, [rng.uniform(-0.5, 0.5) for _ in range(dims)], rng.randrange(3)) for i in range(n)]


def _ties(rng, n, dims):
    return [(i, [rng.choice((-1.0, 1.0)) for _ in range(dims)], rng.randrange(3)) for i in range(n)]


def _odd(rng, n, dims):
    rows = _spread(rng, n, dims)
    rows += [(50, [0.0] * dims, 1), (100, None, 1), (150, [math.nan] * dims, 1), (200, [None] * dims, 1), (None, [1.0] * dims, 1),
             (250, [math.inf] * dims, 1), (300, [1.0] * dims, None), (350, [], 1), (400, [0.5] * (dims + 1), 2), (401, [0.5] * (dims + 1), 2),
             (402, [0.4] * (dims + 1), 1)]
    return rows + rows[:20]


@pytest.mark.parametrize("make", [_spread, _ties, _odd])
def test_equal_to_all_pairs(spark, monkeypatch, make):
    monkeypatch.setattr(H, "_SHARD_ROWS", 100)
    monkeypatch.setattr(H, "_BLOCK_ANCHORS", 7)
    rows = make(random.Random(8), 700, 6)
    found = H.hard_negatives(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = plain(rows)
    assert expected and sorted(map(tuple, found.collect())) == expected


def test_nothing_to_find(spark):
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.hard_negatives(spark.createDataFrame([(0, [1.0], 1, "x"), (1, [1.0], 2, "x")], SCHEMA)).count() == 0


def test_reading_stops_early_and_is_exact():
    """On vectors with few strong dimensions the lists are not read to the end, and nothing is lost."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.standard_normal((4000, 8)) ** 5).astype(np.int64)
    lists = H.Lists(np.arange(4000), np.arange(4000), rng.integers(0, 2, 4000), x)
    met = 0
    for row in range(40):
        a = lists.x[row].astype(np.int64)
        met += sum(len(new) for new, *_ in _until(lists, a, row))
        at, scores = lists.best_of_label(row, lists.labels[row], a, 5)
        every = x @ a
        mine = [i for i in np.lexsort((np.arange(4000), -every)) if i != row and lists.labels[i] == lists.labels[row]][:5]
        assert at.tolist() == mine and scores.tolist() == every[mine].tolist()
    assert met < 40 * 4000 / 2


def _until(lists, a, row):
    best = lists.best_of_label(row, lists.labels[row], a, 5)[1][-1]
    for step in lists.read(a):
        yield step
        if step[2] is not None and step[2] < best:
            return


def test_large_numbers_stay_exact():
    x = np.array([[1 << 28, 3], [1 << 28, 1], [(1 << 28) - 1, 1 << 20]], dtype=np.int64)
    lists = H.Lists(np.arange(3), np.arange(3), np.array([1, 1, 1]), x)
    a = np.array([1 << 30, 1], dtype=np.int64)
    assert lists.best_of_label(9, 1, a, 3)[1].tolist() == sorted((x @ a).tolist(), reverse=True)
    with pytest.raises(OverflowError):
        lists.best_of_label(9, 1, np.array([1 << 40, 1]), 3)
