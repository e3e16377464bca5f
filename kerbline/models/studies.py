"""Model selection over time folds: families, feature groups, hyperparameters, permutations."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.constants import CLASSIFIER_FEATURES, FEATURE_GROUPS, FEATURES
from kerbline.models import boosting, encode
from kerbline.models.impact import ImpactModel
from kerbline.operators import features, metrics, splits
from kerbline.session import join_grown, settle

LABEL = "road_closure"
# Columns too wide for the encoded baselines, and study settings.
WIDE = ["junction", "police_station", "pin", "cause_corridor"]
STUDY_LEVELS = 200
GRID = [(rate, trees, leaves) for rate in (0.03, 0.05, 0.1) for trees in (400, 800) for leaves in (15, 31, 63)]
LEAST_GAIN = 0.0005
_KERNELS = ["kde_intensity", "kde_gathering", "kde_accident"]
_DENSITY = ["hist_density_1km", "hist_density_3km"]
DROPPED = {"full": [], "no_kde": _KERNELS, "no_density": _DENSITY, "neither": _KERNELS + _DENSITY}
_JOBS_AT_ONCE = 8


def boosted(trees: int = 600, rate: float = 0.05, leaves: int = 31) -> boosting.Fit:
    return boosting.Fit("", LABEL, (), "log", trees, rate, leaves)


def forest(trees: int = 400, depth: int = 10) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=LABEL, numTrees=trees, maxDepth=depth, maxBins=encode.MAX_BINS,
                                  minInstancesPerNode=5, seed=0)


def logistic(iterations: int = 2000) -> LogisticRegression:
    return LogisticRegression(labelCol=LABEL, maxIter=iterations, weightCol="balance", standardization=False)


class FoldStudy:
    """One feature table with fold marks, scored by any estimator and feature set.

    The table is written once, rare levels collapsed; every fit is a filter and a projection of it. The corridor rate
    is learned again on each fold's training rows.
    """

    def __init__(self, clean_events: DataFrame, columns: Sequence[str] = tuple(FEATURES), min_test: int = 40,
                 min_positives: int = 10, edges: Sequence[float] = tuple(splits.COUNT_EDGES)):
        marked = splits.quantile_folds(clean_events, list(edges))
        frame = features.feature_frame(marked, keep=["id", "fold", LABEL], features=columns)
        wide = settle(frame, "study")
        self.levels = features.learn_levels(wide, most=STUDY_LEVELS)
        self.table = settle(encode.with_validation(features.cap_levels(wide, self.levels)), "study-capped")
        self.folds = splits.kept_folds(self.table, min_test, LABEL, min_positives)

    def _fold(self, fold: int, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        train, test = splits.fold_frames(self.table, fold)
        if "corridor_event_rate" in columns:
            rates = train.groupBy("corridor").agg(F.avg(LABEL).alias("corridor_event_rate"))
            train, test = (features.target_encoding(d.drop("corridor_event_rate"), rates) for d in (train, test))
        return train, test

    def _rated(self) -> DataFrame:
        """The table with the corridor rate as every fold's training rows have it."""
        if not hasattr(self, "_with_rates"):
            table = self.table
            for fold in self.folds:
                rates = self.table.where(F.col("fold") < fold).groupBy("corridor").agg(F.avg(LABEL).alias("corridor_event_rate"))
                table = features.target_encoding(table.drop("corridor_event_rate"), rates).withColumnRenamed(
                    "corridor_event_rate", f"corridor_event_rate_{fold}")
            self._with_rates = settle(table, "study-rates")
        return self._with_rates

    def staged(self, runs: dict[str, tuple[Sequence[str], boosting.Fit, int | None]]) -> list[DataFrame]:
        """(fold, run, y, p) per fold for runs of (columns, boosted fit, number of trees).

        All fits go through the same jobs. Runs that differ in their number of trees alone share one fit: the shorter
        ensemble is a prefix of the longer.
        """
        rated = any("corridor_event_rate" in columns for columns, _, _ in runs.values())
        table = self._rated() if rated else self.table

        def name(column: str, fold: int) -> str:
            return f"corridor_event_rate_{fold}" if column == "corridor_event_rate" else column

        fits: dict[tuple, boosting.Fit] = {}
        for columns, fit, _ in runs.values():
            for fold in self.folds:
                key = tuple(columns), fit, fold
                if columns and key not in fits:
                    fits[key] = replace(fit, name=str(len(fits)), label=LABEL, before=fold,
                                        features=tuple(name(c, fold) for c in columns))
        models = boosting.fit_all(table, list(fits.values()), "fold")
        predicted = []
        for fold in self.folds:
            test = table.where(F.col("fold") == fold)
            base = self.table.where(F.col("fold") < fold).agg(F.avg(LABEL)).first()[0]
            own = {run: (models[fits[tuple(columns), fit, fold].name], most)
                   for run, (columns, fit, most) in runs.items() if columns}
            used = sorted({c for m, _ in own.values() for c in m.features})
            rows = boosting.scored(test.select(F.col(LABEL).alias("y"), *used), {
                f"__p{i}": m for i, m in enumerate(own.values())})
            scores = [F.struct(F.lit(run).alias("run"), F.col(f"__p{i}").alias("p")) for i, run in enumerate(own)]
            scores += [F.struct(F.lit(run).alias("run"), F.lit(base).alias("p")) for run in runs if run not in own]
            predicted.append(rows.select(F.lit(fold).alias("fold"), "y", F.inline(F.array(*scores))))
        return predicted

    def _predict(self, fold: int, columns: Sequence[str], family: str, estimator) -> DataFrame:
        train, test = self._fold(fold, columns)
        used = [c for c in columns if c not in WIDE]
        base = train.agg(F.avg(LABEL)).first()[0]
        if not used:
            return test.select(F.lit(fold).alias("fold"), F.col(LABEL).alias("y"), F.lit(base).alias("p"))
        if family == "logistic":
            share = F.when(F.col(LABEL) == 1, 0.5 / base).otherwise(0.5 / (1 - base))
            train, test = train.withColumn("balance", share), test.withColumn("balance", F.lit(1.0))
            stages = encode.linear_stages(used)
        else:
            stages = encode.tree_stages(used)
        model = Pipeline(stages=[*stages, estimator]).fit(train)
        return model.transform(test).select(
            F.lit(fold).alias("fold"), F.col(LABEL).alias("y"), vector_to_array(F.col("probability"))[1].alias("p"))

    def cv(self, runs: dict[str, tuple[Sequence[str], str, Callable]]) -> DataFrame:
        """(run, auc_mean, auc_std, pr_auc_mean) for named runs of (columns, family, estimator maker).

        Boosted runs are fitted together, other fits run a few at a time; all predictions are then evaluated together.
        """
        trees = {name: (columns, make(), None) for name, (columns, family, make) in runs.items() if family == "boosted"}

        def fit(job):
            name, (columns, family, make), fold = job
            return self._predict(fold, columns, family, make()).withColumn("run", F.lit(name))

        jobs = [(name, spec, fold) for name, spec in runs.items() if name not in trees for fold in self.folds]
        predicted = self.staged(trees) if trees else []
        with ThreadPool(_JOBS_AT_ONCE) as pool:
            predicted += pool.map(fit, jobs)
        return self._evaluated(predicted)

    def _evaluated(self, predicted: list[DataFrame]) -> DataFrame:
        together = settle(reduce(DataFrame.unionByName, predicted), "predictions")
        keys = ["run", "fold"]
        scores = metrics.roc_auc(together, "y", "p", keys).join(
            metrics.average_precision(together, "y", "p", keys), keys)
        return scores.groupBy("run").agg(
            F.avg("roc_auc").alias("auc_mean"), F.stddev_pop("roc_auc").alias("auc_std"),
            F.avg("average_precision").alias("pr_auc_mean"))


def family_compare(study: FoldStudy, columns: Sequence[str], trees: int = 600, forest_trees: int = 400,
                   iterations: int = 2000) -> DataFrame:
    return study.cv({
        "boosted": (columns, "boosted", lambda: boosted(trees)),
        "forest": (columns, "forest", lambda: forest(forest_trees)),
        "logistic": (columns, "logistic", lambda: logistic(iterations))})


def group_ablation(study: FoldStudy, groups: Iterable[str], family: str, make: Callable) -> DataFrame:
    """(run, auc_mean, ..., delta): each group left out, against all columns."""
    columns = [c for c in FEATURES if c in study.table.columns]
    runs = {"all": (columns, family, make)}
    for g in groups:
        runs[g] = ([c for c in columns if c not in FEATURE_GROUPS[g]], family, make)
    scores = settle(study.cv(runs), "ablation")
    base = scores.where(F.col("run") == "all").first()["auc_mean"]
    return scores.withColumn("delta", F.col("auc_mean") - F.lit(base))


def kde_ablation(study: FoldStudy, family: str, make: Callable) -> DataFrame:
    """Kernel and density columns left out in turn."""
    columns = [c for c in FEATURES if c in study.table.columns]
    return study.cv({n: ([c for c in columns if c not in d], family, make) for n, d in DROPPED.items()})


def forward_selection(study: FoldStudy, groups: Sequence[str], family: str, make: Callable,
                      baseline: float = 0.5) -> DataFrame:
    """(step, candidate, auc_mean, auc_std, pr_auc_mean, gain, joins): every candidate of every step, tried together.

    A step extends the path so far by each group that is not on it. `gain` is against the step before (at first against
    `baseline`, a coin toss); the best candidate joins if it gains more than the least gain, ties going by name. The
    table ends with the first step in which none joins, or when no group is left.
    """
    steps: list[DataFrame] = []
    path: list[str] = []
    reached = baseline
    for step in range(1, len(groups) + 1):
        open_groups = [g for g in groups if g not in path]
        tried = study.cv({g: (_columns_of([*path, g]), family, make) for g in open_groups})
        best_first = W.orderBy(F.col("auc_mean").desc_nulls_last(), "run")
        table = settle(tried.withColumn("gain", F.col("auc_mean") - F.lit(reached)).select(
            F.lit(step).alias("step"), F.col("run").alias("candidate"), "auc_mean", "auc_std", "pr_auc_mean", "gain",
            ((F.row_number().over(best_first) == 1) & (F.coalesce("gain", F.lit(0.0)) > LEAST_GAIN)).alias("joins")),
            "selection-step")
        steps.append(table)
        joined = table.where("joins").first()
        if joined is None:
            break
        path.append(joined["candidate"])
        reached = joined["auc_mean"]
    return reduce(DataFrame.unionByName, steps)


def _columns_of(groups: Sequence[str]) -> list[str]:
    members = {c for g in groups for c in FEATURE_GROUPS[g]}
    return [c for c in FEATURES if c in members]


def top_drivers(importances: DataFrame, most: int = 8) -> DataFrame:
    """The features whose permutation costs most, ties by name."""
    return importances.orderBy(F.desc("importance"), "feature").limit(most)


def grid_search(study: FoldStudy, columns: Sequence[str], grid: Sequence[tuple[float, int, int]] = tuple(GRID)) -> DataFrame:
    """Cross-validated AUC per (rate, trees, leaves).

    One fit per rate and leaves, with the most trees that are asked for, serves every number of trees.
    """
    most = {(rate, leaves): max(t for r, t, n in grid if (r, n) == (rate, leaves)) for rate, _, leaves in grid}
    return study._evaluated(study.staged({
        f"{rate}/{trees}/{leaves}": (columns, boosted(most[rate, leaves], rate, leaves), trees)
        for rate, trees, leaves in grid}))


def permutation_importance(model: ImpactModel, clean_events: DataFrame, repeats: int = 5, seed: int = 0,
                           bucket_rows: int = 10_000) -> DataFrame:
    """(feature, importance, spread): mean AUC lost when a column is shuffled.

    Every feature and repeat is one shuffled copy of one column. Values get a random order by hash; within random buckets
    of bounded size each row takes the next row's value (the last the first's), so a copy holds exactly the same values.
    Only the shuffled value travels; it meets its row again by the row's number. All copies are scored in one job.
    """
    frame = settle(model.features(clean_events, keep=["id", LABEL], wanted=CLASSIFIER_FEATURES).select(
        F.monotonically_increasing_id().alias("_row"), LABEL, *CLASSIFIER_FEATURES), "permute")
    buckets = max(1, frame.count() // bucket_rows)
    texts = set(encode.categorical(CLASSIFIER_FEATURES))
    copies = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(r).alias("repeat"),
                 (F.col(c) if c in texts else F.lit(None)).cast("string").alias("text"),
                 (F.lit(None) if c in texts else F.col(c)).cast("double").alias("number"))
        for c in CLASSIFIER_FEATURES for r in range(repeats)])
    dealt = (frame.select("_row", F.inline(copies))
             .withColumn("_order", F.xxhash64("_row", "feature", "repeat", F.lit(seed)))
             .withColumn("_bucket", F.pmod(F.xxhash64("_order"), F.lit(buckets))))
    ordered = W.partitionBy("feature", "repeat", "_bucket").orderBy("_order", "_row")
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    value = F.struct("text", "number")
    other = dealt.select("_row", "feature", "repeat", F.coalesce(
        F.lead(value).over(ordered), F.first(value).over(whole)).alias("_other"))
    kinds = dict(frame.dtypes)
    shuffled = join_grown(other, frame, "_row").select(LABEL, "feature", "repeat", *[
        F.when(F.col("feature") == c, F.col("_other.text" if c in texts else "_other.number").cast(kinds[c])).otherwise(
            F.col(c)).alias(c) for c in CLASSIFIER_FEATURES])
    scored = settle(boosting.scored(shuffled, {"p": model.closure}).select("feature", "repeat", LABEL, "p"), "permuted")
    base = metrics.roc_auc(boosting.scored(frame, {"p": model.closure}).select(LABEL, "p"), LABEL, "p").first()[0]
    lost = metrics.roc_auc(scored, LABEL, "p", by=["feature", "repeat"], few_groups=True).withColumn(
        "lost", F.lit(base) - F.col("roc_auc"))
    return lost.groupBy("feature").agg(F.avg("lost").alias("importance"), F.stddev_pop("lost").alias("spread"))
