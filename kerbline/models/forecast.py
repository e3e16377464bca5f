"""Event-count forecasts per corridor and hour."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.constants import PANEL_FEATURES
from kerbline.functions import clock
from kerbline.models import boosting, encode
from kerbline.models.boosting import Boosted, Fit
from kerbline.operators import metrics, panel, splits, weights
from kerbline.session import settle

_COUNTS = [c for c in PANEL_FEATURES if c.startswith(("lag_", "roll_", "slag_"))]
_TARGETS = {"n_events": "pred_events", "n_impact": "pred_impact"}
_LOADS = [f"load_{t}" for t in _TARGETS]
_LEAST_LOAD = 1e-3
_TREE_FEATURES = (*PANEL_FEATURES, "corridor", *_LOADS)
FAMILIES = ("trees", "line")


def _validated(frame: DataFrame) -> DataFrame:
    """Marks 15 % of the panel's rows for early stopping."""
    return frame.withColumn("validation", F.pmod(F.xxhash64("corridor", "bin"), F.lit(100)) < 15)


class HotspotModel:
    """Event and closure counts per corridor and hour from calendar, lags, trailing means, neighbours and corridor.

    `family` is `trees`, boosted trees with the Poisson loss, or `line`, a Poisson regression with a log link, for which
    count features enter as log(1 + x). A corridor enters by what was learned of it, the logarithm of its mean load per
    target, so there is no limit to their number; trees also know the 254 busiest corridors by name. Corridors that were
    not there in training get the overall mean.
    """

    def __init__(self, reg: float = 1e-3, iterations: int = 25, targets: tuple[str, ...] = ("n_events", "n_impact"),
                 family: str = "trees", trees: int = 500, rate: float = 0.05, leaves: int = 31, min_leaf: int = 50):
        if family not in FAMILIES:
            raise ValueError(f"{family!r} is not one of {FAMILIES}")
        self.reg, self.iterations, self.targets, self.family = reg, iterations, targets, family
        self.trees, self.rate, self.leaves, self.min_leaf = trees, rate, leaves, min_leaf
        self.edges: DataFrame | None = None
        self.loads: DataFrame | None = None
        self.models: dict[str, PipelineModel | Boosted] = {}

    def _prepared(self, frame: DataFrame) -> DataFrame:
        if self.family == "line":
            frame = frame.withColumns({c: F.log1p(F.coalesce(F.col(c), F.lit(0.0))) for c in _COUNTS})
        usual = self.loads.where("is_overall").first()
        known = self.loads.where("not is_overall").drop("is_overall")
        return frame.join(known, "corridor", "left").fillna({c: usual[c] for c in _LOADS})

    def tree_fit(self, name: str, label: str) -> Fit:
        return Fit(name, label, _TREE_FEATURES, "poisson", self.trees, self.rate, self.leaves, self.min_leaf, 0.0)

    def learn(self, clean_events: DataFrame) -> DataFrame:
        """Learns neighbours and loads; returns the prepared training panel."""
        self.edges = settle(weights.spatial_weights(clean_events), "edges")
        frame = settle(panel.panel_features(clean_events, self.edges), "panel")
        self.learn_loads(frame)
        return self._prepared(frame)

    def fit(self, clean_events: DataFrame) -> HotspotModel:
        train = self.learn(clean_events)
        if self.family == "trees":
            self.models = boosting.fit_all(_validated(train), [self.tree_fit(t, t) for t in self.targets])
            return self
        for target in self.targets:
            glm = GeneralizedLinearRegression(
                family="poisson", link="log", labelCol=target, featuresCol="features", maxIter=self.iterations,
                regParam=self.reg, predictionCol=_TARGETS[target])
            stages = encode.linear_stages([*PANEL_FEATURES, *_LOADS])
            self.models[target] = Pipeline(stages=[*stages, glm]).fit(train)
        return self

    def learn_loads(self, frame: DataFrame) -> None:
        """Mean loads per corridor and over all rows, as logarithms."""
        means = [F.log(F.avg(t) + F.lit(_LEAST_LOAD)).alias(c) for t, c in zip(_TARGETS, _LOADS)]
        self.loads = settle(frame.groupBy("corridor").agg(F.lit(False).alias("is_overall"), *means).unionByName(
            frame.agg(F.lit(None).cast("string").alias("corridor"), F.lit(True).alias("is_overall"), *means)), "loads")

    def forecast_panel(self, clean_events: DataFrame) -> DataFrame:
        """One-step-ahead predictions with observed lags over the whole panel after its warm-up."""
        frame = panel.panel_features(clean_events, self.edges)
        kept = ["corridor", "bin", "n_events", "n_impact", "hour", "dow"]
        scored = self._prepared(frame)
        if self.family == "trees":
            scored = boosting.scored(scored.select(*dict.fromkeys([*kept, *_TREE_FEATURES])), {
                _TARGETS[t]: m for t, m in self.models.items()})
        else:
            for target, model in self.models.items():
                columns = scored.columns
                scored = model.transform(scored).select(*columns, _TARGETS[target])
        return scored.select(*kept, *[_TARGETS[t] for t in self.models])

    def save(self, path: str) -> None:
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        self.loads.write.mode("overwrite").parquet(f"{path}/loads")
        spark = self.edges.sparkSession
        spark.createDataFrame([(self.family,)], "family string").write.mode("overwrite").parquet(f"{path}/family")
        for target, model in self.models.items():
            if self.family == "trees":
                spark.createDataFrame([(model.to_json(),)], "model string").write.mode("overwrite").parquet(f"{path}/{target}")
            else:
                model.write().overwrite().save(f"{path}/{target}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, targets: tuple[str, ...] = ("n_events", "n_impact")) -> HotspotModel:
        model = cls(targets=targets, family=spark.read.parquet(f"{path}/family").first()["family"])
        model.edges = spark.read.parquet(f"{path}/edges")
        model.loads = spark.read.parquet(f"{path}/loads")
        model.models = {t: Boosted.from_json(spark.read.parquet(f"{path}/{t}").first()["model"]) if model.family == "trees"
                        else PipelineModel.load(f"{path}/{t}") for t in targets}
        return model


def after(frame: DataFrame, cut: float) -> DataFrame:
    return frame.where(clock.micros(F.col("bin")) > F.lit(cut))


def forecast_cv(clean_events: DataFrame, n_folds: int = 4, min_test: int = 50) -> DataFrame:
    """(family, fold, mae, n): walk-forward evaluation of both families, refitted on the rows before every fold.

    A fold forecasts train and test together and keeps the hours after the first test hour. The trees of all folds are
    fitted together: their panels are one table in which a fold's label is null on the rows of others.
    """
    marked = settle(splits.rolling_folds(clean_events, n_folds), "folds")
    per_fold, tables, waiting = [], [], []
    for fold in splits.kept_folds(marked, min_test):
        train, test = splits.fold_frames(marked, fold)
        first = test.agg(clock.micros(F.date_trunc("hour", F.min("start")).cast("timestamp_ntz"))).first()[0]
        line = HotspotModel(targets=("n_events",), family="line").fit(train)
        trees = HotspotModel(targets=("n_events",))
        trees.edges, trees.loads = line.edges, line.loads
        panel_of = settle(trees._prepared(panel.panel_features(train, trees.edges)), "fold-panel")
        tables.append(panel_of.withColumn(f"label_{fold}", F.col("n_events")))
        waiting.append((fold, trees))
        for model in (line, trees):
            per_fold.append((fold, model, train.unionByName(test), first))
    if not tables:
        return clean_events.sparkSession.createDataFrame([], "family string, fold int, mae double, n long")
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    fitted = boosting.fit_all(_validated(together), [m.tree_fit(str(fold), f"label_{fold}") for fold, m in waiting])
    for fold, model in waiting:
        model.models = {"n_events": fitted[str(fold)]}
    return reduce(DataFrame.unionByName, [
        metrics.mae(after(model.forecast_panel(events), first), "n_events", "pred_events").select(
            F.lit(model.family).alias("family"), F.lit(fold).cast("int").alias("fold"), "mae", "n")
        for fold, model, events, first in per_fold])
