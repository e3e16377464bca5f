"""Invariants of model output, persistence and streaming, on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from kerbline.models.impact import ImpactModel
from kerbline.operators import cleaning, panel
from kerbline.plans import learning
from kerbline.plans.fixture import Tables
from kerbline.session import fresh_path
from kerbline.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


@pytest.fixture(scope="module")
def model(tables):
    return ImpactModel(trees=3, rate=0.3, duration_trees=2, duration_rate=0.3).fit(tables.clean_table)


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_scores_are_in_range(tables, model):
    scored = model.score(tables.clean_table)
    assert scored.count() == tables.clean_table.count()
    assert scored.where(~F.col("p_road_closure").between(0, 1) | ~F.col("p_high_priority").between(0, 1)
                        | ~F.col("exp_duration_min").between(1, 1440)).count() == 0


def test_fitted_events_score_the_same_without_their_features_made_again(tables, model, monkeypatch):
    keep = ["start", "event_cause", "corridor", "road_closure"]
    plain = model.score(tables.clean_table, keep=keep)
    monkeypatch.setattr(ImpactModel, "features", lambda *a, **k: pytest.fail("features are made again"))
    again = model.score_fitted(keep)
    assert again.columns == plain.columns and _sorted(again) == _sorted(plain)


def test_saved_model_scores_the_same(spark, tables, model):
    path = fresh_path(spark, "model")
    model.save(path)
    assert _sorted(ImpactModel.load(spark, path).score(tables.clean_table)) == _sorted(model.score(tables.clean_table))


def test_stream_equals_batch(spark, tables, model):
    sink, checkpoint = fresh_path(spark, "sink"), fresh_path(spark, "checkpoint")
    stream = jobs.report_stream(spark, learning._reports_folder(tables), files_per_batch=1)
    jobs.score_stream(stream, model, tables.clean_table, sink, checkpoint).awaitTermination()
    batch = jobs.score_batch(tables.raw, model, tables.clean_table)
    assert _sorted(spark.read.parquet(sink).select(batch.columns)) == _sorted(batch)


def test_hourly_stream_equals_panel(spark, tables):
    """All hours, with reports that arrive long after their hour."""
    sink, checkpoint, folder = (fresh_path(spark, n) for n in ("sink", "checkpoint", "late"))
    raw = tables.raw.repartition(3)
    for part in raw.randomSplit([1.0, 1.0, 1.0], seed=1):
        part.write.mode("append").parquet(folder)
    jobs.panel_stream(jobs.report_stream(spark, folder, files_per_batch=2), sink, checkpoint).awaitTermination()
    assert _sorted(jobs.hourly_counts(spark, sink)) == _sorted(panel.panel_counts(cleaning.clean(tables.raw)))


def test_forecaster_tells_many_corridors_apart(spark):
    from kerbline.models.forecast import HotspotModel

    loads = [(f"C{i:04d}", float(i % 7) / 3) for i in range(300)]
    frame = spark.createDataFrame(loads, "corridor string, n_events double").withColumn("n_impact", F.lit(0.0))
    model = HotspotModel()
    model.learn_loads(frame)
    assert model.loads.where("not is_overall").count() == 300
    assert model.loads.where("corridor = 'C0299'").first()["load_n_events"] > model.loads.where(
        "corridor = 'C0294'").first()["load_n_events"]


def test_forward_selection_covers_all_groups(tables):
    from kerbline import constants as K
    from kerbline.models import studies

    study = studies.FoldStudy(tables.clean_table)
    table = studies.forward_selection(study, list(K.FEATURE_GROUPS), "logistic", lambda: studies.logistic(2)).collect()
    assert {r["candidate"] for r in table if r["step"] == 1} == set(K.FEATURE_GROUPS)
    joined = [r for r in table if r["joins"]]
    assert [r["step"] for r in joined] == list(range(1, len(joined) + 1))


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from kerbline import session

    conf = SimpleNamespace(get=lambda key, other=None: other)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        session.shared_dir(cluster)

def test_forecast_covers_the_panel(spark):
    rows = learning.forecast_panel(spark, SF)
    t = Tables(spark, SF)
    assert rows.count() == t.panel_features.count()
    assert rows.where((F.col("pred_events") < 0) | F.col("pred_events").isNull()).count() == 0


def test_weibull_without_penalty_equals_spark(spark):
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import AFTSurvivalRegression

    from kerbline.models import aft

    rng = np.random.default_rng(4)
    rows = []
    for _ in range(400):
        a, b = int(rng.integers(0, 2)), float(rng.normal())
        t = float(np.exp(1.0 + 0.7 * a - 0.4 * b + 0.6 * np.log(rng.exponential())))
        rows.append((min(t, 6.0), int(t < 6.0), a, b))
    table = spark.createDataFrame(rows, "T double, E int, a int, b double")
    own = aft.fit_aft(table, penalty=0.0, covariates=["a", "b"])
    theirs = AFTSurvivalRegression(labelCol="T", censorCol="E", maxIter=200, tol=1e-10).fit(VectorAssembler(
        inputCols=["a", "b"], outputCol="features").transform(table.withColumn("E", F.col("E").cast("double"))))
    assert own.coefficients == pytest.approx(list(theirs.coefficients), abs=2e-3)
    assert own.intercept == pytest.approx(theirs.intercept, abs=2e-3)
    assert np.exp(own.log_scale) == pytest.approx(theirs.scale, abs=2e-3)

    # with a penalty: no neighbour of the solution has a higher penalised likelihood, by the formula row by row
    held = aft.fit_aft(table, penalty=0.05, covariates=["a", "b"])
    t, e, x = (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2:] for r in rows]))

    def value(theta):
        z = (np.log(t) - x @ theta[:2] - theta[2]) / np.exp(theta[3])
        return (e * (z - theta[3]) - np.exp(z)).mean() - 0.05 / 2 * (theta[:2] ** 2).sum()

    best = np.array([*held.coefficients, held.intercept, held.log_scale])
    for i in range(4):
        for step in (-1e-3, 1e-3):
            assert value(best + step * np.eye(4)[i]) < value(best)
    assert abs(held.coefficients[0]) < abs(own.coefficients[0])
    medians = aft.median_minutes(held, table.withColumn("id", F.lit("x"))).collect()
    want = np.clip(np.exp(x @ best[:2] + best[2] + np.exp(best[3]) * np.log(np.log(2))), 1, 1440)
    assert sorted(r.median_min for r in medians) == pytest.approx(sorted(want))


def test_weibull_steps_are_not_compiled_anew(spark, monkeypatch):
    """A step's sums are made by tasks, beside loops; no step is an aggregate of as many terms."""
    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame

    from kerbline.models import aft

    rng = np.random.default_rng(6)
    rows = [(float(rng.exponential()) + 0.01, int(rng.integers(0, 2)), int(rng.integers(0, 3)), float(rng.normal()))
            for _ in range(50)]
    table = spark.createDataFrame(rows, "T double, E int, a int, b double").repartition(3)
    theta = np.array([0.3, -0.2, 0.1, -0.4])

    def loops(theta):
        total = 0.0
        for t, e, a, b in rows:
            z = (np.log(t) - theta[0] * a - theta[1] * b - theta[2]) / np.exp(theta[3])
            total += e * (z - theta[3]) - np.exp(z)
        return total / len(rows)

    value, gradient, second = aft._sums(table, ["a", "b"], theta)
    assert value == pytest.approx(loops(theta))
    ways = 1e-4 * np.eye(4)
    assert gradient == pytest.approx([(loops(theta + w) - loops(theta - w)) / 2e-4 for w in ways], rel=1e-5, abs=1e-7)
    for i, one in enumerate(ways):
        up, down = (aft._sums(table, ["a", "b"], theta + k * one)[1] for k in (1, -1))
        assert second[i] == pytest.approx((up - down) / 2e-4, rel=1e-5, abs=1e-6)

    wide = []
    monkeypatch.setattr(DataFrame, "agg", lambda self, *c, agg=DataFrame.agg: wide.append(len(c)) or agg(self, *c))
    aft.fit_aft(table, covariates=["a", "b"])
    assert wide and max(wide) <= 3


def test_few_files_are_parsed_by_all_cores(spark, tmp_path, monkeypatch):
    """The written clean table has the rows of the cleaning; a file of one row group is dealt out before it is parsed."""
    from kerbline.plans import fixture
    from kerbline.plans.fixture import Tables

    monkeypatch.setattr(fixture, "_ROWS_TO_DEAL", 200)

    spark.range(300).selectExpr(
        "id AS event_id", "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS ts", "id % 40 AS user_id",
        "'x' AS event_type", "CAST(id AS DOUBLE) AS value", "'p' AS props").coalesce(1).write.parquet(
        str(tmp_path / "events.parquet"))
    t = Tables(spark, str(tmp_path))
    assert len(t.clean_table.inputFiles()) > 4
    assert sorted(map(str, t.clean_table.collect())) == sorted(map(str, t.clean.collect()))


def test_forecast_families(tables):
    from kerbline.models.forecast import HotspotModel

    for family in ("line", "trees"):
        model = HotspotModel(family=family, iterations=3, trees=3).fit(tables.clean_table)
        made = model.forecast_panel(tables.clean_table)
        assert made.where("pred_events < 0 or pred_impact < 0 or pred_events is null").count() == 0
        path = fresh_path(tables.spark, "hotspot")
        model.save(path)
        again = HotspotModel.load(tables.spark, path)
        assert again.family == family and made.exceptAll(again.forecast_panel(tables.clean_table)).count() == 0
    with pytest.raises(ValueError):
        HotspotModel(family="other")


def test_forecasts_without_spread_have_no_correlation(spark):
    from kerbline.operators import metrics

    flat = spark.createDataFrame([(0.3, 1), (0.3, 0), (0.3, 2)], "p double, n long")
    assert metrics.pearson(flat, "p", "n").first()[0] is None
    assert metrics.pearson(flat.limit(1), "p", "n").first()[0] is None
    known = spark.createDataFrame([(1.0, 2), (2.0, 1), (4.0, 7), (None, 50), (9.0, None)], "p double, n long")
    assert metrics.pearson(known, "p", "n").first()[0] == pytest.approx(0.8824975)


def test_grid_runs_equal_separate_fits(tables):
    from kerbline import constants as K
    from kerbline.models import studies

    study = studies.FoldStudy(tables.clean_table, K.CLASSIFIER_FEATURES)
    table = {r["run"]: r["auc_mean"] for r in studies.grid_search(study, K.CLASSIFIER_FEATURES, [
        (0.1, 3, 15), (0.1, 8, 15), (0.3, 8, 7)]).collect()}
    assert set(table) == {"0.1/3/15", "0.1/8/15", "0.3/8/7"}
    for run, auc in table.items():
        rate, trees, leaves = (float(x) for x in run.split("/"))
        alone = study.cv({"one": (K.CLASSIFIER_FEATURES, "boosted", lambda: studies.boosted(  # noqa: B023
            int(trees), rate, int(leaves)))}).first()["auc_mean"]
        assert auc == pytest.approx(alone)


def test_published_tables(spark):
    counts = {r.name: r.n_rows for r in learning.publish_tables(spark, SF).collect()}
    assert set(counts) == {"corridor_forecast", "how_profile", "events_sample", "options", "centroids", "meta"}
    assert counts["meta"] == 1 and counts["how_profile"] <= 168 * counts["centroids"]
