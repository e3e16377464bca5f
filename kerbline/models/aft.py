"""Weibull accelerated-failure-time regression of the clearance time, with a penalty on the coefficients.

log T = x b + b0 + s e, with e of the standard smallest-extreme-value law. Spark's own regression has no penalty, so the
likelihood is maximised by Newton steps: in each, tasks sum its value, gradient and second derivatives over their rows with
numpy (15 parameters, some 240 sums; as an aggregate they would be compiled anew for each step), Spark adds the sums up by
their place, and only the totals come to the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.constants import MAX_CLEARANCE_MIN
from kerbline.operators.survival import COVARIATES

_LEAST_STEP = 1e-8


@dataclass
class WeibullAft:
    """Coefficients by covariate, intercept and the logarithm of the scale."""

    covariates: list[str]
    coefficients: list[float]
    intercept: float
    log_scale: float
    log_likelihood: float = float("nan")
    steps: int = 0

    def linear(self) -> Column:
        return sum((F.col(c) * F.lit(b) for c, b in zip(self.covariates, self.coefficients)), F.lit(self.intercept))

    def to_json(self) -> str:
        return json.dumps(self.__dict__)


def _sums(survival: DataFrame, covariates: list[str], theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood, gradient and second derivatives. Tasks sum their rows, Spark adds the sums up."""
    n = len(covariates) + 1
    names = ["T", "E", *covariates]

    def work(batches):
        total = np.zeros(1 + (n + 1) + (n + 1) ** 2 + 1)
        for batch in batches:
            time, e, *columns = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64)
                                 for c in names)
            x = np.array([*columns, np.ones(len(e))])
            s = np.exp(theta[-1])
            z = (np.log(time) - theta[:-1] @ x) / s
            w = np.exp(np.minimum(z, 50.0))
            second = np.empty((n + 1, n + 1))
            second[:n, :n] = (x * (-w / (s * s))) @ x.T
            second[n, :n] = second[:n, n] = x @ ((e - w - w * z) / s)
            second[n, n] = (-z * (w - e) - z * z * w).sum()
            total += np.concatenate([[(e * (z - theta[-1]) - w).sum()], x @ ((w - e) / s), [((w - e) * z - e).sum()],
                                     second.ravel(), [len(e)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "x"])

    found = survival.select(*names).mapInArrow(work, "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).collect()
    total = np.array([r["x"] for r in sorted(found, key=lambda r: r["place"])])
    mean = total[:-1] / total[-1]
    return float(mean[0]), mean[1:n + 2], mean[n + 2:].reshape(n + 1, n + 1)


def fit_aft(survival: DataFrame, penalty: float = 0.05, iterations: int = 100,
            covariates: list[str] | None = None) -> WeibullAft:
    """Maximises the mean log-likelihood less penalty / 2 times the squares of the coefficients (not of the intercept).

    Rows with a time of zero or less, or with nulls, take no part. Steps are halved until the likelihood grows.
    """
    covariates = list(COVARIATES if covariates is None else covariates)
    known = F.col("T") > 0
    for c in (*covariates, "E"):
        known = known & F.col(c).isNotNull()
    rows = survival.where(known).select("T", "E", *covariates).persist()
    n, mean, spread = rows.agg(F.count("*"), F.avg(F.log("T")), F.stddev_pop(F.log("T"))).first()
    if not n:
        raise ValueError("no row has a time and all covariates")
    ridge = np.array([penalty] * len(covariates) + [0.0, 0.0])
    theta = np.array([0.0] * len(covariates) + [mean, float(np.log(max(spread or 1.0, 1e-3)))])
    value, gradient, second = _sums(rows, covariates, theta)
    steps = 0
    while steps < iterations:
        steps += 1
        slope = gradient - ridge * theta
        curve = -second + np.diag(ridge)
        bends = np.linalg.eigvalsh(curve)
        if bends[0] <= 1e-9:  # far from the top the likelihood need not be concave
            curve = curve + np.eye(len(theta)) * (0.1 * max(np.abs(bends).max(), 1e-6) - bends[0])
        move = np.linalg.solve(curve, slope)
        now = value - (ridge * theta ** 2).sum() / 2
        size = min(1.0, 1.0 / max(abs(float(move[-1])), 1e-12))  # the scale changes by a factor of e at most
        while True:
            tried = theta + size * move
            value, gradient, second = _sums(rows, covariates, tried)
            if value - (ridge * tried ** 2).sum() / 2 >= now - 1e-12 or size < 1e-6:
                break
            size /= 2
        theta = tried
        if np.abs(size * move).max() < _LEAST_STEP:
            break
    rows.unpersist()
    return WeibullAft(covariates, theta[:-2].tolist(), float(theta[-2]), float(theta[-1]), float(value), steps)


def median_minutes(model: WeibullAft, survival: DataFrame) -> DataFrame:
    """Adds `median_min`, the predicted median clearance within one minute and one day."""
    median = F.exp(model.linear() + F.lit(float(np.exp(model.log_scale) * np.log(np.log(2.0)))))
    clipped = F.greatest(F.least(median, F.lit(float(MAX_CLEARANCE_MIN))), F.lit(1.0))
    return survival.select("id", "T", F.col("E").cast("int").alias("E"), clipped.alias("median_min"))
