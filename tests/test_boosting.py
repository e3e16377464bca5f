"""Boosted trees beside plain loops, on made-up rows."""

from multiprocessing import pool

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbline.models import boosting as B

COLUMNS = ("a", "b", "corridor")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    n = 3000
    frame = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 9, n).astype(float),
                          "corridor": rng.choice(["x", "y", "z", "q"], n), "validation": rng.random(n) < 0.15})
    signal = frame.a + (frame.corridor == "x") * 2 - (frame.b > 5)
    frame["minutes"] = signal + rng.laplace(size=n) * 0.5
    frame["closed"] = (signal + rng.normal(size=n) > 1).astype(float)
    frame["count"] = rng.poisson(np.exp(0.4 * signal)).astype(float)
    frame.loc[::50, "a"] = np.nan
    frame.loc[::70, "corridor"] = None
    frame.loc[::90, "minutes"] = np.nan
    return frame


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows.astype(object).where(rows.notna(), None), (
        "a double, b double, corridor string, validation boolean, minutes double, closed double, count double")).repartition(3)


def _plain_split(g, h, bins, cat, min_leaf, l2):
    """Best gain of one feature over all cuts, by loops."""
    values = sorted(set(bins))
    if cat:
        values.sort(key=lambda v: (g[bins == v].sum() / (h[bins == v].sum() + 10.0), v))
        tries = [values[:i] for i in range(1, len(values))]
    else:
        numbers = [v for v in values if v]
        tries = [numbers[:i] for i in range(1, len(numbers) + 1)] + [[0, *numbers[:i]] for i in range(len(numbers))]
    best = 0.0
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
    for left in tries:
        m = np.isin(bins, left)
        if m.sum() >= min_leaf and (~m).sum() >= min_leaf:
            best = max(best, score(m) + score(~m) - score(m | True))
    return best


@pytest.mark.parametrize("cat", [False, True])
def test_best_split_beside_loops(cat):
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, size = 200, int(rng.integers(2, 12))
        g, h, bins = rng.normal(size=n), rng.random(n), rng.integers(0, size, n)
        hist = np.stack([np.bincount(bins, x, minlength=size) for x in (g, h, np.ones(n))], axis=1)[None]
        found = B.best_splits(hist, [size], [cat], 10, 1.0)[0]
        best = _plain_split(g, h, bins, cat, 10, 1.0)
        if found is None:
            assert best < 1e-6
            continue
        gain, place, mask, left, right = found
        goes = np.unpackbits(mask).astype(bool)[bins]
        assert place == 0 and gain == pytest.approx(best)
        assert left == pytest.approx([g[goes].sum(), h[goes].sum(), goes.sum()]) and right[2] == (~goes).sum()


def test_one_flat_step_does_not_stop():
    assert not B.is_over([1.0, 0.9, 0.9, 0.9, 0.8], 10, 1e-7)
    assert not B.is_over([1.0] * 10, 10, 1e-7) and B.is_over([1.0] * 11, 10, 1e-7)
    assert not B.is_over([float("nan")] * 50, 10, 1e-7)
    model = B.Boosted(["a"], B.Bins({"a": []}, {}), "log", 0.0, [None] * 4, [1.0, 0.9, 0.95, 0.8, 0.85])
    assert [model.best_of(k) for k in range(5)] == [0, 1, 1, 3, 3]


def test_all_losses_gain(table, rows):
    fits = [B.Fit("p", "closed", COLUMNS, "log", 200, 0.1), B.Fit("m", "minutes", COLUMNS, "absolute", 200, 0.05, l2=0.0),
            B.Fit("n", "count", COLUMNS, "poisson", 200, 0.1)]
    models = B.fit_all(table, fits)
    for m in models.values():
        assert len(m.trees) > 5 and min(m.curve) < 0.95 * m.curve[0]
        assert len(m.curve) - 1 - len(m.trees) <= 10
    valid = rows[rows.validation & rows.minutes.notna()]
    got = B.scored(table, models).where("validation and minutes is not null").toPandas()
    assert len(got) == len(valid)
    assert (got.p - got.closed).pow(2).mean() < 0.75 * valid.closed.var()
    assert (got.m - got.minutes).abs().mean() < 0.8 * (valid.minutes - rows[~rows.validation].minutes.median()).abs().mean()
    assert got.n.mean() == pytest.approx(valid["count"].mean(), rel=0.1)
    # the loss that is reported is that of the kept trees
    assert (got.m - got.minutes).abs().mean() == pytest.approx(min(models["m"].curve), rel=1e-9)


def test_a_shorter_ensemble_is_a_prefix(table):
    long, short = (B.fit_all(table, [B.Fit("p", "closed", COLUMNS, trees=t, rate=0.1)])["p"] for t in (14, 6))
    assert long.curve[:7] == short.curve
    for one, two in zip(long.trees, short.trees):
        assert all((getattr(one, c) == getattr(two, c)).all() for c in ("feature", "mask", "left", "right", "value"))
    got = B.scored(table, {"x": (long, 6), "y": short}).select("x", "y").collect()
    assert all(r.x == r.y for r in got)


def test_blocks_make_no_difference(table, monkeypatch):
    """Many blocks, summed by a shuffle for every level, beside one block."""
    fits = [B.Fit("p", "closed", COLUMNS, trees=4, rate=0.2), B.Fit("m", "minutes", COLUMNS, "absolute", 3, 0.2, l2=0.0)]
    one = B.fit_all(table, fits)
    monkeypatch.setattr(B, "_BLOCK_ROWS", 500)
    monkeypatch.setattr(B, "_ROUNDS_BETWEEN_CHECKPOINTS", 2)
    many = B.fit_all(table, fits)
    for name, model in one.items():
        assert model.curve == pytest.approx(many[name].curve)
        for a, b in zip(model.trees, many[name].trees, strict=True):
            assert (a.feature == b.feature).all() and (a.mask == b.mask).all() and a.value == pytest.approx(b.value)


def test_a_table_of_some_blocks_takes_a_task_per_model(spark, table, monkeypatch):
    """Jobs follow the models, not the levels of all trees; beyond the bound a shuffle sums the same."""
    fits = [B.Fit("p", "closed", COLUMNS, trees=5, rate=0.2), B.Fit("m", "minutes", COLUMNS, "absolute", 5, 0.2, l2=0.0),
            B.Fit("n", "count", COLUMNS, "poisson", 5, 0.2)]
    monkeypatch.setattr(B, "_BLOCK_ROWS", 500)
    jobs = []
    monkeypatch.setattr(B._Trainer, "_job", lambda *a, job=B._Trainer._job: jobs.append(1) or job(*a))
    near = B.fit_all(table, fits)
    assert not jobs
    monkeypatch.setattr(B, "_TASK_ROWS", 2000, raising=False)
    far = B.fit_all(table, fits)
    assert len(jobs) > 20
    for name, model in near.items():
        assert model.curve == pytest.approx(far[name].curve)
        for a, b in zip(model.trees, far[name].trees, strict=True):
            assert (a.feature == b.feature).all() and (a.mask == b.mask).all() and a.value == pytest.approx(b.value)


def test_leaves_sizes_and_folds(table):
    marked = table.withColumn("fold", F.when(F.col("a") > 0, 1).otherwise(0))
    fit = B.Fit("p", "closed", COLUMNS, trees=3, leaves=5, min_leaf=100, before=1)
    alone = B.fit_all(marked, [fit], "fold")["p"]
    together = B.fit_all(marked, [fit, B.Fit("q", "closed", COLUMNS, trees=3, leaves=9)], "fold")
    assert alone.to_json() == together["p"].to_json()
    early = marked.where("fold = 0 and not validation").toPandas()
    assert alone.base == pytest.approx(np.log(early.closed.mean() / (1 - early.closed.mean())))
    for tree in alone.trees:
        assert (tree.feature < 0).sum() <= 5


def test_saved_and_odd(spark, table):
    model = B.fit_all(table, [B.Fit("p", "closed", COLUMNS, trees=4, rate=0.3)])["p"]
    again = B.Boosted.from_json(model.to_json())
    odd = spark.createDataFrame([(None, None, None), (float("nan"), 1e300, "never seen"), (float("inf"), -1.0, "x")],
                                "a double, b double, corridor string")
    assert [r.p for r in B.scored(odd, {"p": model}).collect()] == [r.p for r in B.scored(odd, {"p": again}).collect()]
    assert B.scored(odd.limit(0), {"p": model}).count() == 0
    nothing = B.fit_all(table.limit(0), [B.Fit("p", "closed", COLUMNS, trees=4)])["p"]
    assert nothing.trees == []
    one_class = B.fit_all(table.withColumn("closed", F.lit(0.0)), [B.Fit("p", "closed", COLUMNS, trees=4)])["p"]
    assert all(r.p < 1e-6 for r in B.scored(odd, {"p": one_class}).collect())
    with pytest.raises(ValueError):
        B.fit_all(table, [B.Fit("p", "closed", COLUMNS, loss="other")])


def test_below_the_root_only_the_smaller_nodes_are_summed(table, monkeypatch):
    """The other node has the rest of its parent's sums; features counted together give each one's own sums."""
    summed = []
    plain = B._histogram

    def recorded(rows, g, h, opened):
        hist = plain(rows, g, h, opened)
        own = [np.arange(len(g)) if rows.parts[node] is None else rows.parts[node] for node in opened]
        assert sum(map(len, rows.groups)) == len(rows.sizes) and len(rows.groups) < len(rows.sizes)
        for one, part in zip(hist, own, strict=True):
            for place, end in enumerate(np.cumsum(rows.sizes)):
                for k, x in enumerate((g, h, np.ones(len(g)))):
                    size = rows.sizes[place]
                    loops = np.bincount(rows.bins[place][part], x[part], minlength=size)
                    assert one[end - size:end, k] == pytest.approx(loops, abs=1e-9)
        summed.append((opened, sum(map(len, own)), len(g)))
        return hist

    monkeypatch.setattr(B, "_histogram", recorded)
    trainer = B._Trainer(table, [B.Fit("p", "closed", COLUMNS, trees=3, rate=0.2)], None, "validation")
    fit, = trainer.fits
    trainer.base = {}
    known = trainer._context([0])
    blocks = [(r["n"], bytes(r["bins"]), bytes(r["numbers"])) for r in trainer.packed.collect()]
    rows = B._Rows(blocks, known["fits"][0], known["shape"])
    _, trees, _ = B._rounds(rows, fit, known["fits"][0]["sizes"], known["fits"][0]["cats"])
    assert len(trees) == 3 and len(summed) > 6
    for opened, counted, n in summed:
        assert counted == n if opened == [0] else counted <= n / 2


def test_many_rows_are_counted_in_fewer_passes_and_the_root_once(monkeypatch):
    """Nodes with many rows count more features at once, with the same sums; the root's rows are counted in one round only."""
    rng = np.random.default_rng(5)
    n, sizes = 70_000, [255, 255, 200, 9, 4, 2]
    bins = np.array([rng.integers(0, size, n) for size in sizes], np.uint8)
    numbers = np.array([(bins[0] > 100) ^ (rng.random(n) < 0.2), np.full(n, -1.0), rng.random(n) < 0.15], np.float64)
    fit = {"at": list(range(6)), "y": 0, "w": None, "before": np.inf}
    rows = B._Rows([(n, bins.tobytes(), numbers.tobytes())], fit, (6, 3))
    g, h = rng.normal(size=len(rows.y)), rng.random(len(rows.y))
    with monkeypatch.context() as few:
        few.setattr(B, "_WIDE_BINS", 1 << 15)  # 59,000 rows train
        rows.start(0.0, sizes)
        assert len(rows.wide_groups) < len(rows.groups)
        made, passes = B._histogram(rows, g, h, [0]), []
        plain = np.bincount

        def counted(x, weights=None, minlength=0):
            passes.append(weights is None)
            return plain(x, weights, minlength)

        few.setattr(np, "bincount", counted)
        again = B._histogram(rows, g, h, [0])
        assert len(passes) == 2 * len(rows.wide_groups) and not any(passes)
    assert (again == made).all()
    for place, end in enumerate(np.cumsum(sizes)):
        for k, x in enumerate((g, h, np.ones(len(g)))):
            assert made[0, end - sizes[place]:end, k] == pytest.approx(
                np.bincount(rows.bins[place], x, minlength=sizes[place]), abs=1e-8)


def test_long_fits_start_first(table, monkeypatch):
    started = []
    plain = B._Trainer._fitted
    monkeypatch.setattr(B._Trainer, "_fitted", lambda self, fit: started.append(fit.name) or plain(self, fit))
    monkeypatch.setattr(B, "ThreadPool", lambda n: pool.ThreadPool(1))
    fits = [B.Fit("few", "closed", COLUMNS[:1], trees=2), B.Fit("all", "closed", COLUMNS, trees=2),
            B.Fit("more", "closed", COLUMNS, trees=3)]
    assert list(B.fit_all(table, fits)) == ["few", "all", "more"]
    assert started == ["more", "all", "few"]


@pytest.mark.parametrize("leaves", [1, 2, 15, 16, 17, 32, 33, 63, 64, 70])
def test_leaf_bits_beside_the_walk(leaves):
    """The leaf that no split closes is the one that steps from the root reach, without a step per level."""
    rng = np.random.default_rng(leaves)
    grown = B._Growing()
    while sum(f < 0 for f in grown.feature) < leaves:
        grown.open = [int(rng.choice(np.flatnonzero(np.array(grown.feature) < 0)))]
        grown.split([(1.0, int(rng.integers(0, 4)), np.packbits(rng.random(256) < 0.5), None, None)], leaves)
    tree = grown.tree(rng.normal(size=len(grown.feature)))
    bins = rng.integers(0, 256, (4, 3000)).astype(np.uint8)
    assert (tree._leaves is None) == (leaves > 64)
    assert (tree.predict(bins) == tree.value[tree.nodes(bins)]).all()
    assert len(tree.predict(bins[:, :0])) == 0


def test_millions_of_rows_take_a_task_per_model(spark, table, monkeypatch):
    """Beyond a million rows, too; blocks that come in any order make one table."""
    monkeypatch.setattr(B, "_BLOCK_ROWS", 500)
    fits = [B.Fit("m", "minutes", COLUMNS, "absolute", 2, 0.2, l2=0.0), B.Fit("p", "closed", COLUMNS, trees=3)]
    plain = B.fit_all(table, fits)
    trainer = B._Trainer(table, fits, None, "validation")
    trainer.n_rows, trainer.base = 5_000_000, {}
    monkeypatch.setattr(B._Trainer, "_job", lambda *a: pytest.fail("a job per level"))
    assert {name: m.to_json() for name, m in trainer.run().items()} == {name: m.to_json() for name, m in plain.items()}


def test_blocks_arrive_in_any_order(table, monkeypatch):
    monkeypatch.setattr(B, "_BLOCK_ROWS", 500)
    trainer = B._Trainer(table, [B.Fit("m", "minutes", COLUMNS, "absolute")], None, "validation")
    trainer.base = {}
    known = trainer._context([0])
    batches = trainer.packed.toArrow().to_batches()
    blocks = [tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows)]
    assert len(blocks) > 2
    whole = B._Rows([b[1:] for b in sorted(blocks)], known["fits"][0], known["shape"])
    cut = [batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)]
    parts = B._Rows.arriving(cut[::-1], known["fits"][0], known["shape"])
    for name in ("bins", "y", "w", "valid_bins", "valid_y", "valid_w"):
        assert (getattr(parts, name) == getattr(whole, name)).all()


def test_codes_made_when_asked_for_count_the_same(monkeypatch):
    """Beside many rows' wide codes the narrow ones are made for the rows at hand."""
    rng = np.random.default_rng(7)
    n, sizes = 4000, [200, 30, 9, 4]
    bins = np.array([rng.integers(0, size, n) for size in sizes], np.uint8)
    numbers = np.array([rng.random(n) < 0.3, np.full(n, -1.0), rng.random(n) < 0.15], np.float64)
    fit = {"at": list(range(4)), "y": 0, "w": None, "before": np.inf}
    made = []
    for most in (1 << 20, 100):
        monkeypatch.setattr(B, "_KEPT_CODES", most)
        monkeypatch.setattr(B, "_WIDE_BINS", 2000)
        rows = B._Rows([(n, bins.tobytes(), numbers.tobytes())], fit, (4, 3))
        made.append(B._rounds(rows, B.Fit("p", "y", tuple("abcd"), trees=3, min_leaf=5), sizes, [False] * 4))
    assert made[0][2] == made[1][2]
    assert all((a.value == b.value).all() for a, b in zip(made[0][1], made[1][1], strict=True))
