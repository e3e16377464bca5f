import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbline.operators import metrics, ordered, severity, splits
from kerbline.session import settle


def frame(spark, n=500, seed=0, hot=0.0):
    rng = random.Random(seed)
    rows = [(0.5 if rng.random() < hot else round(rng.random(), 2), int(rng.random() < 0.3), f"g{i % 3}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "p double, y int, g string")


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_running_totals_and_ranks(spark, hot):
    rows, df = frame(spark, hot=hot)
    got = {r.p: (r.n, r.n_before, r.n_total) for r in ordered.running_totals(df, "p", {"n": F.count("*")}).collect()}
    values = [r[0] for r in rows]
    assert got == {v: (values.count(v), sum(x < v for x in values), len(values)) for v in set(values)}
    ranks = pd.Series(values).rank()
    assert {r.p: r["rank"] for r in ordered.average_ranks(df, "p").collect()} == dict(zip(values, ranks))


@pytest.mark.parametrize("few", [True, False])
def test_grouped_quantiles(spark, few):
    rows, df = frame(spark, hot=0.3)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.prob): r["quantile"] for r in ordered.quantiles(df, "p", probs, ["g"], few).collect()}
    for g in ("g0", "g1", "g2"):
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile([r[0] for r in rows if r[2] == g], p))
    assert ordered.quantile_values(df, "p", [0.8, 0.1]) == pytest.approx(
        [np.quantile([r[0] for r in rows], q) for q in (0.8, 0.1)])


def test_rank_metrics(spark):
    tied = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0)], "p double, y int")
    assert metrics.roc_auc(tied, "y", "p").first()[0] == 0.5
    one = tied.where("y = 0")
    assert metrics.roc_auc(one, "y", "p").first()[0] is None
    rows, df = frame(spark, hot=0.3)
    by_group = {r.g: r.roc_auc for r in metrics.roc_auc(df, "y", "p", ["g"], few_groups=True).collect()}
    for g in by_group:
        pos = [r[0] for r in rows if r[1] and r[2] == g]
        neg = [r[0] for r in rows if not r[1] and r[2] == g]
        wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        assert by_group[g] == pytest.approx(wins)


def test_concordance_against_pairs(spark):
    rng = random.Random(3)
    rows = [(float(rng.randrange(1, 15)), rng.randrange(2), float(rng.randrange(6))) for _ in range(200)]
    row = metrics.concordance(spark.createDataFrame(rows, "t double, e int, p double"), "t", "e", "p").first()
    pairs = [(a, b) for a in rows for b in rows if a[1] and (a[0] < b[0] or (a[0] == b[0] and not b[1]))]
    assert row.pairs == len(pairs)
    assert row.concordant == sum(a[2] < b[2] for a, b in pairs) and row.tied == sum(a[2] == b[2] for a, b in pairs)
    small = spark.createDataFrame([(1.0, 1, 1.0), (2.0, 1, 2.0), (3.0, 0, 3.0)], "t double, e int, p double")
    assert metrics.concordance(small, "t", "e", "p").first().concordance == 1.0


def test_best_threshold_takes_the_lowest_tie(spark):
    rows = [(i / 100, int(i >= 80)) for i in range(100)]
    got = metrics.best_threshold(spark.createDataFrame(rows, "p double, y int"), "y", "p").first()
    scores = [r[0] for r in rows]

    def f1(t):
        tp, flagged = sum(p >= t and y for p, y in rows), sum(p >= t for p, _ in rows)
        return 2 * tp / (flagged + 20)
    best = max(np.quantile(scores, np.linspace(0.5, 0.99, 50)), key=f1)
    assert got.threshold == pytest.approx(best) and got.f1 == pytest.approx(f1(best))


def test_weight_grid():
    grid = severity.weight_grid()
    assert len(grid) == 231 and all(abs(sum(w) - 1) < 1e-9 and min(w) >= 0 for w in grid)


def test_fold_rules(spark):
    events = spark.range(100).select(
        F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("start"),
        (F.col("id") % 10 == 0).cast("int").alias("y"))
    marked = splits.rolling_folds(events)
    sizes = {r.fold: (r.n_train, r.n_test) for r in splits.fold_sizes(marked, "y").collect()}
    assert sizes == {0: (50, 12), 1: (62, 13), 2: (75, 12), 3: (87, 13)}
    assert splits.kept_folds(marked, 13) == [1, 3] and splits.kept_folds(marked, 1, "y", 8) == [2, 3]
    train, test = splits.train_test(events)
    assert (train.count(), test.count()) == (80, 20)


def test_settle_keeps_rows(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert sorted(map(tuple, settle(df, "t").collect())) == sorted(map(tuple, df.collect()))
