"""Evaluation metrics as distributed aggregates.

Labels are 0/1 columns, scores are doubles. `by` computes a metric per group in the same jobs.
Rank metrics add up equal scores first and use slice-wise running totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.operators import ordered

_D = "double"
THRESHOLD_PROBS = [0.5 + 0.49 * i / 49 for i in range(50)]


def _label_totals(df: DataFrame, y: str, p: str, by: Sequence[str], few_groups: bool) -> DataFrame:
    sums = {"pos": F.sum(F.col(y).cast("bigint")), "neg": F.sum(1 - F.col(y).cast("bigint"))}
    return ordered.running_totals(df, p, sums, by, few_groups)


def roc_auc(df: DataFrame, y: str, p: str, by: Sequence[str] = (), few_groups: bool = False) -> DataFrame:
    """Mann-Whitney form; equal scores count one half. Null with a single class."""
    totals = _label_totals(df, y, p, by, few_groups)
    wins = F.sum(F.col("pos").cast(_D) * (F.col("neg_before") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast(_D) * F.sum("neg").cast(_D)
    return totals.groupBy(*by).agg(F.try_divide(wins, pairs).alias("roc_auc"))


def _descending(df: DataFrame, y: str, p: str, by: Sequence[str] = (), few_groups: bool = False) -> DataFrame:
    """Per distinct score: hits and false alarms at `score >= p`, with class totals."""
    totals = _label_totals(df, y, p, by, few_groups)
    return totals.withColumns({"tp": F.col("pos_total") - F.col("pos_before"),
                               "fp": F.col("neg_total") - F.col("neg_before")})


def average_precision(df: DataFrame, y: str, p: str, by: Sequence[str] = (),
                      few_groups: bool = False) -> DataFrame:
    """Sum of precision times recall gained, over falling distinct scores."""
    ranked = _descending(df, y, p, by, few_groups)
    gain = F.try_divide(F.col("pos").cast(_D), F.col("pos_total"))
    precision = F.col("tp") / (F.col("tp") + F.col("fp")).cast(_D)
    return ranked.groupBy(*by).agg(F.sum(gain * precision).alias("average_precision"))


def roc_curve(df: DataFrame, y: str, p: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score."""
    return _descending(df, y, p).select(
        F.col(p).alias("threshold"),
        F.try_divide(F.col("fp").cast(_D), F.col("neg_total")).alias("fpr"),
        F.try_divide(F.col("tp").cast(_D), F.col("pos_total")).alias("tpr"))


def pr_curve(df: DataFrame, y: str, p: str) -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    return _descending(df, y, p).select(
        F.col(p).alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp")).cast(_D)).alias("precision"),
        F.try_divide(F.col("tp").cast(_D), F.col("pos_total")).alias("recall"))


def pr_area(df: DataFrame, y: str, p: str) -> DataFrame:
    """Trapezoid area under the precision-recall points (closing at recall 0, precision 1), and
    the base rate.

    A point and the next higher score's point share an edge; the latter's counts are this
    point's counts less its own row, so no ordering beyond the running totals is needed.
    """
    ranked = _descending(df, y, p)
    tp, fp = F.col("tp").cast(_D), F.col("fp").cast(_D)
    above_tp, above_fp = tp - F.col("pos"), fp - F.col("neg")
    above = F.coalesce(F.try_divide(above_tp, above_tp + above_fp), F.lit(1.0))
    strip = (tp - above_tp) / F.col("pos_total") * (tp / (tp + fp) + above) / 2
    return ranked.agg(F.sum(strip).alias("pr_area"),
                      (F.sum("pos") / F.sum(F.col("pos") + F.col("neg"))).alias("base_rate"))


def brier(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def best_threshold(df: DataFrame, y: str, p: str, probs: Sequence[float] = tuple(THRESHOLD_PROBS)) -> DataFrame:
    """(threshold, f1): the quantile of the scores with the best F1, the lowest on ties.

    Rows are counted by how many candidates they reach; the candidates then read the counts
    of that small table (one row per candidate).
    """
    candidates = sorted({c for c in ordered.quantile_values(df.select(p), p, probs) if c is not None})
    reached = (ordered.bucketed(df.where(F.col(p).isNotNull()).select(y, p), p, candidates, "place")
               .groupBy("place").agg(F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos")))
    whole = W.partitionBy(F.lit(0))
    falling = whole.orderBy(F.desc("place")).rowsBetween(W.unboundedPreceding, 0)
    counted = reached.withColumns({"flagged": F.sum("n").over(falling), "tp": F.sum("pos").over(falling),
                                   "all_pos": F.sum("pos").over(whole)}).where(F.col("place") > 0)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("flagged") + F.col("all_pos")), F.lit(0.0))
    return (counted.select("place", F.get(F.array(*[F.lit(c) for c in candidates]), F.col("place") - 1)
                           .alias("threshold"), f1.alias("f1"))
            .orderBy(F.desc("f1"), "place").limit(1).select("threshold", "f1"))


def confusion(df: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    """Counts at `p >= threshold`, precision, recall and F1 (0 when undefined), base rate."""
    flagged = df.select((F.col(p) >= F.lit(threshold)).alias("hit"), (F.col(y) == 1).alias("real"))
    counts = flagged.agg(
        F.count_if(~F.col("hit") & ~F.col("real")).alias("tn"),
        F.count_if(F.col("hit") & ~F.col("real")).alias("fp"),
        F.count_if(~F.col("hit") & F.col("real")).alias("fn"),
        F.count_if(F.col("hit") & F.col("real")).alias("tp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return counts.withColumns({
        "precision": share(tp, tp + fp), "recall": share(tp, tp + fn),
        "f1": share(2.0 * tp, 2 * tp + fp + fn),
        "positive_rate": (tp + fn) / (tp + fp + fn + F.col("tn"))})


def classifier_report(train: DataFrame, test: DataFrame, y: str, p: str) -> DataFrame:
    """All classifier metrics of the test rows at the threshold chosen on the train rows."""
    threshold = best_threshold(train, y, p).first()["threshold"]
    return confusion(test, y, p, threshold).withColumns({
        "threshold": F.lit(threshold), "auc": F.lit(roc_auc(test, y, p).first()[0]),
        "pr_auc": F.lit(average_precision(test, y, p).first()[0]),
        "brier": F.lit(brier(test, y, p).first()[0])})


def duration_error(df: DataFrame, y: str, yhat: str, naive: float) -> DataFrame:
    """MAE, median absolute error, and the MAE of a constant guess."""
    known = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).select(
        y, F.abs(F.col(y) - F.col(yhat)).alias("e"))
    return known.agg(F.avg("e").alias("mae"), F.avg(F.abs(F.col(y) - F.lit(naive))).alias("naive_mae"),
                     F.count("*").alias("n_test")).withColumn("median_ae", F.lit(median(known, "e")))


def median(df: DataFrame, value: str) -> float:
    return ordered.quantile_values(df, value, [0.5])[0]


def mae(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(yhat).isNotNull()).groupBy(*by).agg(
        F.avg(F.abs(F.col(y) - F.col(yhat))).alias("mae"), F.count("*").alias("n"))


def forecast_skill(model_mae: Column, naive_mae: Column) -> Column:
    return 1 - model_mae / naive_mae


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation as an aggregate; null where either side has no spread, for which `corr` divides by zero."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(correlation(a, b).alias("pearson"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 8) -> DataFrame:
    """Quantile bins (an edge value falls below its edge): mean score, observed rate, size."""
    edges = ordered.quantile_values(df.select(p), p, [i / bins for i in range(1, bins)])
    above = sum(((F.col(p) > F.lit(e)).cast("int") for e in edges), F.lit(0))
    return (df.withColumn("bin", above)
            .groupBy("bin")
            .agg(F.avg(p).alias("mean_predicted"), F.avg(y).alias("observed_rate"),
                 F.count("*").alias("n")))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with mean ranks for ties."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = both.groupBy(a, b).agg(F.count("*").alias("_n"))
    ranked = (cells.join(ordered.average_ranks(both, a, rank="_ra"), a)
              .join(ordered.average_ranks(both, b, rank="_rb"), b))
    middle = F.lit((both.count() + 1) / 2.0)
    spread = ranked.select(F.col("_n").cast(_D).alias("_n"), (F.col("_ra") - middle).alias("_ra"),
                           (F.col("_rb") - middle).alias("_rb"))
    return spread.agg(F.try_divide(
        F.sum(F.col("_n") * F.col("_ra") * F.col("_rb")),
        F.sqrt(F.sum(F.col("_n") * F.col("_ra") * F.col("_ra")))
        * F.sqrt(F.sum(F.col("_n") * F.col("_rb") * F.col("_rb")))).alias("spearman"))


def concordance(df: DataFrame, t: str, e: str, pred: str) -> DataFrame:
    """Harrell's concordance under censoring: one row (pairs, concordant, tied, concordance).

    A pair counts when the earlier time is observed; at equal times an observed event comes
    before a censored one. So pairs are "smaller key, observed" against "larger key" with
    key (time, censored), and counting them is counting ordered points in the plane. Keys get
    dense ranks; at each binary digit of the rank, rows with digit 0 meet rows with digit 1 of
    the same prefix, and one running total over the prediction counts them. Every pair meets at
    exactly one digit, so the work is rows x digits and no pair is ever formed.
    """
    rows = df.where(F.col(t).isNotNull() & F.col(pred).isNotNull()).select(
        F.col(t).cast(_D).alias("t"), F.col(e).cast("int").alias("e"), F.col(pred).cast(_D).alias("pred"))
    cells = rows.groupBy("t", "e", "pred").agg(F.count("*").alias("n"))
    times = ordered.running_totals(cells, "t", {"keys": F.count_distinct("e"), "seen": F.max("e")})
    # keys before this time; at the time itself observed events come first
    ranks = times.select("t", F.col("keys_before").alias("first"), (F.col("seen").cast("bigint")).alias("seen"))
    ranked = cells.join(ranks, "t").select(
        (F.col("first") + F.when(F.col("e") == 0, F.col("seen")).otherwise(0)).alias("rank"),
        "e", "pred", "n")
    digits = ((ranks.agg(F.max("first")).first()[0] or 0) + 1).bit_length()
    dealt = (ranked.select("*", F.explode(F.sequence(F.lit(0), F.lit(digits - 1))).alias("digit"))
             .select("digit", F.expr("shiftright(rank, digit + 1)").alias("prefix"),
                     F.expr("shiftright(rank, digit) & 1").alias("side"), "e", "pred", "n"))
    met = ordered.running_totals(dealt, "pred", {
        "low": F.sum(F.when((F.col("side") == 0) & (F.col("e") == 1), F.col("n")).otherwise(0)),
        "high": F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)),
    }, by=["digit", "prefix"])
    low, high = F.col("low").cast(_D), F.col("high").cast(_D)
    per_prefix = met.groupBy("digit", "prefix").agg(
        F.sum(high * F.col("low_before")).alias("concordant"), F.sum(high * low).alias("tied"),
        (F.sum(low) * F.sum(high)).alias("pairs"))
    total = per_prefix.agg(*[F.sum(c).alias(c) for c in ("pairs", "concordant", "tied")])
    return total.withColumn("concordance", F.try_divide(
        F.col("concordant") + F.col("tied") / 2, F.col("pairs")))


def fold_summary(per_fold: DataFrame, value: str) -> DataFrame:
    return per_fold.agg(F.avg(value).alias("cv_mean"), F.stddev_pop(value).alias("cv_std"),
                        F.count(value).alias("n_folds"))
