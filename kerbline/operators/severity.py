"""Choosing severity weights and tiers against recorded impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline import constants as K
from kerbline.operators import ordered
from kerbline.operators.rules import barricade_cause
from kerbline.session import settle

_D = "double"


def weight_grid(step: float = 0.05) -> list[tuple[float, float, float]]:
    """All (closure, duration, cause) weights on the simplex."""
    n = round(1 / step)
    return [(round(a * step, 2), round(b * step, 2), max(0.0, round(1 - round(a * step, 2) - round(b * step, 2), 2)))
            for a in range(n + 1) for b in range(n + 1 - a)]


def severity_parts(scored: DataFrame) -> DataFrame:
    """The parts every weighting combines, and the recorded impact, per event.

    Needs p_road_closure, p_high_priority, exp_duration_min, event_cause, road_closure and
    duration_min. Unknown predicted clearance counts as the default.
    """
    share = F.coalesce(F.col("exp_duration_min"), F.lit(K.DEFAULT_CLEARANCE_MIN)) / K.FULL_CLEARANCE_MIN
    recorded = F.col("duration_min") / K.FULL_CLEARANCE_MIN
    return scored.select(
        F.col("p_road_closure").alias("closure"),
        F.col("p_high_priority").alias("priority"),
        F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)).alias("duration"),
        barricade_cause(F.col("event_cause")).cast(_D).alias("cause"),
        F.col("road_closure").alias("real_closure"),
        F.greatest(F.least(recorded, F.lit(1.0)), F.lit(0.0)).alias("real_duration"))


PARTS = ["closure", "priority", "duration", "cause"]


#: Slice limits are kept per blend, so there are so many blends at most.
MOST_BLENDS = 256


def rank_objective(parts: DataFrame, blends: list[tuple[float, float, float, float]]) -> DataFrame:
    """Per blend (weights of PARTS, MOST_BLENDS at most; more raise): Spearman of the blended score against
    closure, against known duration, and their mean.

    The ranks of the recorded facets do not depend on the blend, so they are made once. Equal
    events are added up first; each distinct one then gives one row per blend, and equal scores
    are added up again before anything is ordered.
    """
    if len(blends) > MOST_BLENDS:
        raise ValueError(f"{len(blends)} blends at once, of {MOST_BLENDS} at most")
    facets = settle(parts.groupBy("real_closure", "real_duration", *PARTS).agg(F.count("*").alias("m")).withColumn(
        "known", F.col("real_duration").isNotNull().cast("bigint")), "distinct-events")
    size = facets.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("all"),
                      F.coalesce(F.sum(F.col("known") * F.col("m")), F.lit(0)).alias("known")).first()
    middle_all, middle_known = F.lit((size["all"] + 1) / 2.0), F.lit((size["known"] + 1) / 2.0)
    closure_rank = ordered.average_ranks(parts, "real_closure", rank="rank_c")
    duration_rank = ordered.average_ranks(parts, "real_duration", rank="rank_d")
    facets = (facets.join(F.broadcast(closure_rank), "real_closure")  # two rows: closed or not
              .join(duration_rank, "real_duration", "left")
              .select("*", (F.col("rank_c") - middle_all).alias("c"), (F.col("rank_d") - middle_known).alias("d")))
    choices = F.expr("array(" + ", ".join(
        f"named_struct('blend', {i}, " + ", ".join(f"'w_{p}', {float(w)!r}D" for p, w in zip(PARTS, weights)) + ")"
        for i, weights in enumerate(blends)) + ")")
    score = sum((F.col(f"w_{p}") * F.col(p) for p in PARTS[1:]), F.col("w_closure") * F.col("closure"))
    long = (facets.select("known", "c", "d", "m", *PARTS, F.inline(choices))
            .select("known", "c", "d", "m", "blend", F.rint(score * 1e12).alias("score")))
    m = F.col("m")
    totals = ordered.running_totals(long, "score", {
        "n": F.sum("m"), "k": F.sum(F.col("known") * m), "c": F.sum(F.col("c") * m), "d": F.sum(F.col("d") * m),
        "cc": F.sum(F.col("c") * F.col("c") * m), "dd": F.sum(F.col("d") * F.col("d") * m),
    }, by=["blend"], few_groups=True)
    n, k = F.col("n").cast(_D), F.col("k").cast(_D)
    ranked = totals.withColumns({
        "ra": F.col("n_before") + (F.col("n") + 1) / 2.0 - middle_all,
        "rk": F.when(F.col("k") > 0, F.col("k_before") + (F.col("k") + 1) / 2.0 - middle_known)})
    sums = ranked.groupBy("blend").agg(
        F.sum(F.col("ra") * F.col("c")).alias("ac"), F.sqrt(F.sum(n * F.col("ra") * F.col("ra"))).alias("a"),
        F.sum(F.col("rk") * F.col("d")).alias("kd"), F.sqrt(F.sum(k * F.col("rk") * F.col("rk"))).alias("kk"),
        F.sqrt(F.sum("cc")).alias("cc"), F.sqrt(F.sum("dd")).alias("dd"))
    rho_c = F.try_divide(F.col("ac"), F.col("a") * F.col("cc"))
    rho_d = F.try_divide(F.col("kd"), F.col("kk") * F.col("dd"))
    return (sums.withColumns({"closure_corr": rho_c, "duration_corr": rho_d})
            .select("blend", "closure_corr", "duration_corr",
                    (0.5 * F.col("closure_corr") + 0.5 * F.col("duration_corr")).alias("objective")))


def weight_search(scored: DataFrame, step: float = 0.05) -> DataFrame:
    """(w_closure, w_duration, w_cause, closure_corr, duration_corr, objective) per weighting."""
    grid = weight_grid(step)
    found = rank_objective(severity_parts(scored), [(c, 0.0, d, g) for c, d, g in grid])
    table = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in w) + ")" for w in grid) + ")")
    at = F.get(table, F.col("blend"))
    return found.select(F.get(at, F.lit(0)).alias("w_closure"), F.get(at, F.lit(1)).alias("w_duration"),
                        F.get(at, F.lit(2)).alias("w_cause"), "closure_corr", "duration_corr", "objective")


def best_weights(found: DataFrame) -> DataFrame:
    """The best weighting; ties go to the smaller closure, then duration weight."""
    return found.where(F.col("objective").isNotNull()).orderBy(
        F.desc(F.round("objective", 12)), "w_closure", "w_duration").limit(1)


def former_objective(scored: DataFrame) -> DataFrame:
    """The same objective for the earlier formula with the priority part."""
    weights = [K.FORMER_WEIGHTS.get(p, 0.0) for p in PARTS]
    return rank_objective(severity_parts(scored), [tuple(weights)])


def tier_thresholds(scores: DataFrame, score: str = "score") -> dict[str, float]:
    """The lower score of each tier above Low, as score quantiles."""
    return dict(zip(K.TIERS[1:], ordered.quantile_values(scores, score, K.TIER_QUANTILES)))


def tiers(scores: DataFrame, cuts: dict[str, float], score: str = "score") -> DataFrame:
    s = F.col(score)
    return scores.withColumn("tier", F.when(s >= F.lit(cuts["Critical"]), "Critical")
                             .when(s >= F.lit(cuts["High"]), "High")
                             .when(s >= F.lit(cuts["Moderate"]), "Moderate").otherwise("Low"))


def tier_summary(tiered: DataFrame, label: str = "road_closure") -> DataFrame:
    return tiered.groupBy("tier").agg(F.count("*").alias("n_events"), F.avg(label).alias("closure_rate"))
