"""Severity and deployment rules: column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline import constants as K


def _by_tier(tier: Column, values: dict, otherwise) -> Column:
    items = list(values.items())
    start = F.when(tier == items[0][0], items[0][1])
    return reduce(lambda c, kv: c.when(tier == kv[0], kv[1]), items[1:], start).otherwise(otherwise)


def barricade_cause(cause: Column) -> Column:
    return cause.isin(K.BARRICADE_CAUSES)


def severity_score(p_closure: Column, minutes: Column, cause: Column) -> Column:
    """Weighted closure risk, capped clearance and cause; unknown or zero clearance counts as 60."""
    known = F.coalesce(F.nullif(minutes, F.lit(0.0)), F.lit(K.DEFAULT_CLEARANCE_MIN))
    share = F.least(known / K.FULL_CLEARANCE_MIN, F.lit(1.0))
    return (K.SEVERITY_WEIGHTS["closure"] * p_closure + K.SEVERITY_WEIGHTS["duration"] * share
            + K.SEVERITY_WEIGHTS["cause"] * barricade_cause(cause).cast("double"))


def severity_tier(p_closure: Column, score: Column) -> Column:
    return (F.when((p_closure >= 0.80) | (score >= K.SEVERITY_CUTS["Critical"]), "Critical")
            .when((p_closure >= 0.60) | (score >= K.SEVERITY_CUTS["High"]), "High")
            .when(score >= K.SEVERITY_CUTS["Moderate"], "Moderate")
            .otherwise("Low"))


def _long(minutes: Column) -> Column:
    return F.coalesce(minutes > 180, F.lit(False))


def officers(tier: Column, p_closure: Column, minutes: Column) -> Column:
    return (_by_tier(tier, K.OFFICERS, None)
            + F.when(p_closure > 0.4, 2).otherwise(0) + F.when(_long(minutes), 2).otherwise(0))


def barricades(tier: Column, p_closure: Column, cause: Column) -> Column:
    needed = (p_closure > 0.35) | (tier.isin("High", "Critical") & barricade_cause(cause))
    return F.when(needed, _by_tier(tier, K.BARRICADES, 2)).otherwise(0)


def diversion(tier: Column, p_closure: Column) -> Column:
    return (F.when(p_closure > 0.6, K.DIVERSION_FULL)
            .when(p_closure > 0.35, K.DIVERSION_PARTIAL)
            .when(tier.isin("High", "Critical"), K.DIVERSION_ADVISORY)
            .otherwise(K.DIVERSION_NONE))


def tow_crane(p_closure: Column, minutes: Column) -> Column:
    return (p_closure > 0.4) | _long(minutes)


def eta_minutes(minutes: Column) -> Column:
    return minutes.cast("int")


def recommend(scored: DataFrame) -> DataFrame:
    """Add the deployment plan to rows with event_cause, p_road_closure and exp_duration_min."""
    p, minutes, cause = F.col("p_road_closure"), F.col("exp_duration_min"), F.col("event_cause")
    tiered = scored.withColumn("severity_score", severity_score(p, minutes, cause))
    tiered = tiered.withColumn("severity_tier", severity_tier(p, F.col("severity_score")))
    tier = F.col("severity_tier")
    return tiered.withColumns({
        "severity_score": F.rint(F.col("severity_score") * 1000) / 1000,
        "rec_officers": officers(tier, p, minutes),
        "rec_barricades": barricades(tier, p, cause),
        "rec_diversion": diversion(tier, p),
        "rec_tow_crane": tow_crane(p, minutes),
        "rec_eta_minutes": eta_minutes(minutes),
    })


def incident_report(recommended: DataFrame) -> DataFrame:
    """The texts of a printed incident report, one row per event."""
    percent = F.concat(F.bround(F.col("p_road_closure") * 100, 0).cast("int").cast("string"), F.lit("%"))
    minutes = F.concat(F.bround("exp_duration_min", 0).cast("int").cast("string"), F.lit(" mins"))
    rows = recommended.withColumns({
        "closure_risk": percent, "duration": minutes,
        "severity_colour": _by_tier(F.col("severity_tier"), K.TIER_COLOURS, "#64748b"),
        "major_road": F.when(F.col("p_high_priority") > 0.5, "Yes").otherwise("No"),
        "tow_crane": F.when(F.col("rec_tow_crane"), "Yes").otherwise("No"),
    })
    return rows.withColumn("summary", F.format_string(
        "A %s event is expected to close the road with a risk of %s and to clear in %s. "
        "Its severity is %s.", "event_cause", "closure_risk",
        F.coalesce("duration", F.lit("an unknown time")), "severity_tier"))
