"""Closure risk, priority and clearance time of an incident."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.constants import CLASSIFIER_FEATURES, FEATURES, MAX_CLEARANCE_MIN
from kerbline.models import boosting, encode
from kerbline.models.boosting import Boosted, Fit
from kerbline.operators import features, profile
from kerbline.session import settle

_LABELS = ["id", "start", "road_closure", "high_priority", "duration_min", "recency_weight"]
PARTS = ("closure", "priority", "duration")


class ImpactModel:
    """Two classifiers on the lean feature set and a clearance regressor on the full one.

    The clearance regressor is fitted on log minutes with recent events weighing more, and only with more than
    `min_labelled` known clearances. All parts are fitted together; each stops after ten rounds without gain on the
    validation rows and keeps the trees up to its best round.
    """

    def __init__(self, trees: int = 600, rate: float = 0.03, leaves: int = 15, min_leaf: int = 30, l2: float = 1.0,
                 duration_trees: int = 500, duration_rate: float = 0.05, duration_leaves: int = 31,
                 min_labelled: int = 200):
        self.trees, self.rate, self.leaves, self.min_leaf, self.l2 = trees, rate, leaves, min_leaf, l2
        self.duration_trees, self.duration_rate, self.duration_leaves = duration_trees, duration_rate, duration_leaves
        self.min_labelled = min_labelled
        self.rates: DataFrame | None = None
        self.levels: dict[str, list[str]] = {}
        self.closure: Boosted | None = None
        self.priority: Boosted | None = None
        self.duration: Boosted | None = None
        self._fitted_on: DataFrame | None = None

    def _classifier(self, part: str, label: str) -> Fit:
        return Fit(part, label, tuple(CLASSIFIER_FEATURES), "log", self.trees, self.rate, self.leaves, self.min_leaf, self.l2)

    def fit(self, clean_events: DataFrame, parts: tuple[str, ...] = PARTS) -> ImpactModel:
        """Fit the asked parts. The feature table is written once and read by every fit."""
        self.rates = settle(features.closure_rates(clean_events), "rates")
        wanted = FEATURES if "duration" in parts else CLASSIFIER_FEATURES
        frame = settle(features.feature_frame(
            profile.recency_weight(clean_events), rates=self.rates, keep=_LABELS, features=wanted), "features")
        self.levels = features.learn_levels(frame)
        self._fitted_on = frame
        train = encode.with_validation(features.cap_levels(frame, self.levels)).withColumn(
            "log_minutes", F.log1p("duration_min"))
        fits = [self._classifier(part, label) for part, label in (("closure", "road_closure"), ("priority", "high_priority"))
                if part in parts]
        if "duration" in parts and train.where("duration_min is not null").count() > self.min_labelled:
            fits.append(Fit("duration", "log_minutes", tuple(FEATURES), "absolute", self.duration_trees, self.duration_rate,
                            self.duration_leaves, self.min_leaf, 0.0, "recency_weight"))
        for part, model in boosting.fit_all(train, fits).items():
            setattr(self, part, model)
        return self

    def tree_counts(self, spark: SparkSession) -> DataFrame:
        """(part, n_fitted, n_trees, first_loss, best_loss): rounds made, trees kept, validation loss before and at best."""
        rows = [(part, len(m.curve) - 1, len(m.trees), m.curve[0], min(m.curve))
                for part, m in ((p, getattr(self, p)) for p in PARTS) if m is not None]
        return spark.createDataFrame(rows, "part string, n_fitted int, n_trees int, first_loss double, best_loss double")

    def features(self, clean_events: DataFrame, history: DataFrame | None = None, keep=(),
                 wanted: Sequence[str] | None = None) -> DataFrame:
        """The capped features, by default those that the fitted parts need."""
        wanted = wanted or (FEATURES if self.duration else CLASSIFIER_FEATURES)
        frame = features.feature_frame(clean_events, rates=self.rates, history=history, keep=keep, features=wanted)
        levels = {c: v for c, v in self.levels.items() if c in frame.columns}
        return features.cap_levels(frame, levels)

    def score(self, clean_events: DataFrame, history: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """(id, `keep` columns, p_road_closure, p_high_priority, exp_duration_min).

        `history` is where earlier neighbours are looked up; by default the batch itself. Columns to keep travel with
        the rows, under other names, because features of the same name are capped.
        """
        carried = {f"kept_{c}": F.col(c) for c in keep}
        return self._scored(self.features(clean_events.withColumns(carried), history, keep=["id", *carried]), keep)

    def score_fitted(self, keep: Sequence[str] = ()) -> DataFrame:
        """`score` of the very events that the model was fitted on, whose features are written already."""
        carried = {f"kept_{c}": F.col(c) for c in keep}
        frame = self._fitted_on.select("id", *[c.alias(n) for n, c in carried.items()], *[
            c for c in self._fitted_on.columns if c in FEATURES])
        return self._scored(features.cap_levels(frame, self.levels), keep)

    def _scored(self, scored: DataFrame, keep: Sequence[str]) -> DataFrame:
        carried = [f"kept_{c}" for c in keep]
        models = {"p_road_closure": self.closure, "p_high_priority": self.priority, "log_minutes_hat": self.duration}
        models = {name: m for name, m in models.items() if m is not None}
        used = {c for m in models.values() for c in m.features}
        scored = boosting.scored(scored.select("id", *carried, *[c for c in scored.columns if c in used]), models)
        if self.duration is not None:
            minutes = F.greatest(F.least(F.expm1("log_minutes_hat"), F.lit(float(MAX_CLEARANCE_MIN))), F.lit(1.0))
        else:
            minutes = F.lit(None).cast("double")
        outputs = [n for n in models if n != "log_minutes_hat"]
        return scored.select("id", *[F.col(f"kept_{c}").alias(c) for c in keep], *outputs, minutes.alias("exp_duration_min"))

    def save(self, path: str) -> None:
        spark = self.rates.sparkSession
        self.rates.write.mode("overwrite").parquet(f"{path}/rates")
        rows = [(c, i, v) for c, names in self.levels.items() for i, v in enumerate(names)]
        (spark.createDataFrame(rows, "feature string, place int, level string")
         .write.mode("overwrite").parquet(f"{path}/levels"))
        made = [(p, getattr(self, p).to_json()) for p in PARTS if getattr(self, p) is not None]
        spark.createDataFrame(made, "part string, model string").write.mode("overwrite").parquet(f"{path}/models")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ImpactModel:
        model = cls()
        model.rates = spark.read.parquet(f"{path}/rates")
        for row in spark.read.parquet(f"{path}/levels").orderBy("feature", "place").collect():
            model.levels.setdefault(row["feature"], []).append(row["level"])
        for row in spark.read.parquet(f"{path}/models").collect():
            setattr(model, row["part"], Boosted.from_json(row["model"]))
        return model
