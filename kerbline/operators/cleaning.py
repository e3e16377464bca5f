"""Raw incident log to clean incidents: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline import schema
from kerbline.constants import CAUSE_SYNONYMS, GATHERING_CAUSES, MAX_CLEARANCE_MIN, NO_CORRIDOR
from kerbline.functions import clock, text
from kerbline.session import lookup
from kerbline.sources.incidents import align, null_literals


def cause(raw: Column) -> Column:
    return text.canonical(F.lower(text.cleaned(raw, "unknown")), CAUSE_SYNONYMS)


def event_type(raw: Column) -> Column:
    return F.lower(text.cleaned(raw, "unknown"))


def corridor(raw: Column) -> Column:
    return text.cleaned(raw, NO_CORRIDOR)


def vehicle(raw: Column) -> Column:
    return F.lower(text.cleaned(raw, "unknown"))


def zone(raw: Column) -> Column:
    return text.cleaned(raw, "unknown")


def priority(raw: Column) -> Column:
    return text.cleaned(raw, "Low")


def closure_flag(raw: Column) -> Column:
    return F.coalesce(F.upper(raw) == "TRUE", F.lit(False)).cast("int")


def priority_flag(cleaned_priority: Column) -> Column:
    return (cleaned_priority == "High").cast("int")


def gathering_flag(cleaned_cause: Column) -> Column:
    return cleaned_cause.isin(GATHERING_CAUSES).cast("int")


def raw_minutes(start: Column, end: Column, resolved: Column, closed: Column) -> Column:
    """Minutes to the first known end, ungated."""
    return clock.minutes_between(start, F.coalesce(end, resolved, closed))


def plausible(minutes: Column) -> Column:
    return F.when((minutes > 0) & (minutes <= MAX_CLEARANCE_MIN), minutes)


def parse_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: clock.parse_utc(F.col(c)) for c in schema.TIMESTAMP_COLUMNS})


def clean(raw: DataFrame) -> DataFrame:
    """The clean incident table. Row order is not part of a table; sort where rows leave it."""
    timed = (parse_times(null_literals(align(raw)))
             .where(F.col("start_datetime").isNotNull()))
    fitted = timed.withColumns({
        "event_type": event_type(F.col("event_type")),
        "event_cause": cause(F.col("event_cause")),
        "corridor": corridor(F.col("corridor")),
        "veh_type": vehicle(F.col("veh_type")),
        "zone": zone(F.col("zone")),
        "priority": priority(F.col("priority")),
        "start": clock.utc_to_local(F.col("start_datetime")),
        "road_closure": closure_flag(F.col("requires_road_closure")),
        "_minutes": raw_minutes(F.col("start_datetime"), F.col("end_datetime"),
                                F.col("resolved_datetime"), F.col("closed_datetime")),
    })
    return fitted.withColumns({
        "high_priority": priority_flag(F.col("priority")),
        "is_gathering": gathering_flag(F.col("event_cause")),
        "duration_min": plausible(F.col("_minutes")),
    }).drop("_minutes")


def clean_summary(clean_events: DataFrame) -> DataFrame:
    return clean_events.agg(
        F.count("*").alias("n_events"),
        F.avg("road_closure").alias("closure_rate"),
        F.avg("high_priority").alias("priority_rate"),
        F.avg(F.col("duration_min").isNotNull().cast("int")).alias("duration_coverage"),
        F.min("start").alias("first_start"),
        F.max("start").alias("last_start"),
    )


def lead_hours(clean_events: DataFrame) -> DataFrame:
    """Hours from the record being created to the event's start."""
    return clean_events.withColumn(
        "lead_hours", clock.minutes_between(F.col("created_date"), F.col("start_datetime")) / 60)


def impute_location(events: DataFrame, centroids: DataFrame, centre: tuple[float, float]) -> DataFrame:
    """Missing coordinates take the corridor's centroid, else the city centre."""
    known = lookup(centroids.select("corridor", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")),
                   "centroids")
    return (events.join(known, "corridor", "left")
            .withColumns({
                "latitude": F.coalesce("latitude", "_lat", F.lit(centre[0])),
                "longitude": F.coalesce("longitude", "_lon", F.lit(centre[1]))})
            .drop("_lat", "_lon"))
