"""The censored clearance-time table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.constants import MAX_CLEARANCE_MIN, NO_CORRIDOR, SURVIVAL_CAUSES
from kerbline.functions import clock

COVARIATES = ["is_corridor", "is_planned", "hour", "is_weekend"] + [f"cause_{c}" for c in SURVIVAL_CAUSES]


def survival_frame(clean_events: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(id, T, E, covariates): cleared events observed, active ones censored at the snapshot.

    The snapshot is in UTC microseconds; by default the latest start.
    """
    if snapshot is None:
        snapshot = clean_events.agg(clock.micros(F.max("start_datetime"))).first()[0]
    elapsed = (F.lit(snapshot) - clock.micros(F.col("start_datetime"))) / F.lit(6e7)
    observed = F.col("duration_min").isNotNull()
    active = ~observed & F.coalesce(F.col("status") == "active", F.lit(False)) & (elapsed > 0)
    return clean_events.where(observed | active).select(
        "id",
        F.when(observed, F.col("duration_min"))
        .otherwise(F.least(elapsed, F.lit(float(MAX_CLEARANCE_MIN)))).alias("T"),
        observed.cast("int").alias("E"),
        (F.col("corridor") != NO_CORRIDOR).cast("int").alias("is_corridor"),
        (F.col("event_type") == "planned").cast("int").alias("is_planned"),
        F.hour("start").alias("hour"),
        clock.is_weekend(F.weekday("start")).alias("is_weekend"),
        *[(F.col("event_cause") == c).cast("int").alias(f"cause_{c}") for c in SURVIVAL_CAUSES])
