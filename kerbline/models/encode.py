"""Encoders over capped categories and numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.constants import CATEGORICAL_FEATURES
from kerbline.operators.features import cap_levels

MAX_BINS = 256  # 250 levels, the collapsed rest and one for unseen values


def categorical(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in CATEGORICAL_FEATURES]


def indexers(cats: Sequence[str]) -> list[StringIndexer]:
    """Level -> position by falling frequency, all columns in one stage; unseen values get a
    position of their own. The columns are capped, so the label lists are short."""
    if not cats:
        return []
    return [StringIndexer(inputCols=list(cats), outputCols=[f"{c}_ix" for c in cats], handleInvalid="keep")]


def tree_stages(columns: Sequence[str]) -> list:
    """Indexed categories and plain numbers in one vector."""
    cats = categorical(columns)
    numbers = [c for c in columns if c not in cats]
    assembler = VectorAssembler(inputCols=[f"{c}_ix" for c in cats] + numbers, outputCol="features",
                                handleInvalid="keep")
    return indexers(cats) + [assembler]


def linear_stages(columns: Sequence[str]) -> list:
    """One-hot categories and plain numbers, scaled but not centred (the vector stays sparse)."""
    cats = categorical(columns)
    numbers = [c for c in columns if c not in cats]
    hot = OneHotEncoder(inputCols=[f"{c}_ix" for c in cats], outputCols=[f"{c}_hot" for c in cats]) if cats else None
    assembler = VectorAssembler(inputCols=[f"{c}_hot" for c in cats] + numbers, outputCol="raw_features",
                                handleInvalid="keep")
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=False)
    return indexers(cats) + ([hot] if cats else []) + [assembler, scaler]


def encode_features(frame: DataFrame, columns: Sequence[str], levels: dict[str, list[str]],
                    linear: bool = False) -> tuple[DataFrame, PipelineModel]:
    capped = cap_levels(frame, {c: levels[c] for c in categorical(columns)})
    stages = linear_stages(columns) if linear else tree_stages(columns)
    fitted = Pipeline(stages=stages).fit(capped)
    return fitted.transform(capped), fitted


def with_validation(frame: DataFrame, percent: int = 15) -> DataFrame:
    """Marks a fixed share of rows, by id, for early stopping."""
    return frame.withColumn("validation", F.pmod(F.xxhash64("id"), F.lit(100)) < percent)
