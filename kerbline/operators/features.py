"""The feature frame of an incident, known at report time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.constants import (CATEGORICAL_FEATURES, CITY_CENTRE, FEATURE_GROUPS, FEATURES,
                                NO_CORRIDOR, OTHER_LEVEL)
from kerbline.functions import clock, geo, text
from kerbline.operators.neighbours import causal_neighbourhood
from kerbline.session import lookup

_NEIGHBOURHOOD = set(FEATURE_GROUPS["density_kde"] + FEATURE_GROUPS["recency"])


def temporal(start: Column) -> dict[str, Column]:
    hour = clock.fractional_hour(start)
    dow = F.weekday(start)
    hour_sin, hour_cos = clock.cycle(hour, 24)
    dow_sin, dow_cos = clock.cycle(dow, 7)
    return {
        "hour_sin": hour_sin, "hour_cos": hour_cos, "dow_sin": dow_sin, "dow_cos": dow_cos,
        "dow": dow, "is_weekend": clock.is_weekend(dow), "month": F.month(start),
        "is_peak": clock.is_peak(hour), "daypart": clock.daypart(hour),
    }


def spatial() -> dict[str, Column]:
    return {
        "lat": F.col("latitude"), "lon": F.col("longitude"),
        "dist_center_km": geo.haversine_km(F.col("latitude"), F.col("longitude"),
                                           F.lit(CITY_CENTRE[0]), F.lit(CITY_CENTRE[1])),
    }


def categorical() -> dict[str, Column]:
    core = {c: F.col(c) for c in ("event_type", "event_cause", "corridor", "veh_type", "zone")}
    return core | {
        "authenticated": F.coalesce("authenticated", F.lit("unknown")),
        "is_gathering": F.col("is_gathering"),
        "is_corridor": (F.col("corridor") != NO_CORRIDOR).cast("int"),
        "junction": F.coalesce("junction", F.lit("none")),
        "police_station": F.coalesce("police_station", F.lit("none")),
        "pin": F.coalesce(text.pin_code(F.col("address")), F.lit("none")),
        "cause_corridor": F.concat_ws("|", "event_cause", "corridor"),
    }


def textual(description: Column) -> dict[str, Column]:
    return {
        "has_desc": text.has_text(description),
        "desc_len": text.clipped_length(description),
        "desc_nonascii": text.has_non_ascii(description),
    }


def closure_rates(clean_events: DataFrame) -> DataFrame:
    """Corridor -> mean closure, learned on the events given (training events only)."""
    return clean_events.groupBy("corridor").agg(F.avg("road_closure").alias("corridor_event_rate"))


def target_encoding(events: DataFrame, rates: DataFrame) -> DataFrame:
    """Look the corridor's rate up; unseen corridors take the plain mean of the rates.

    The rates hold one row per corridor; they are broadcast while their count is within the bound.
    """
    rates = lookup(rates, "corridor-rates")
    overall = rates.agg(F.avg("corridor_event_rate")).scalar()
    return (events.join(rates, "corridor", "left")
            .withColumn("corridor_event_rate",
                        F.coalesce(F.col("corridor_event_rate"), overall, F.lit(0.0))))


def feature_frame(clean_events: DataFrame, rates: DataFrame | None = None,
                  history: DataFrame | None = None, keep: Iterable[str] = (),
                  features: Iterable[str] = tuple(FEATURES)) -> DataFrame:
    """`keep` columns of the events, then the asked features.

    The neighbourhood join and the rate lookup run only when a feature needs them.
    """
    keep, features = list(keep), list(features)
    frame = clean_events
    if _NEIGHBOURHOOD & set(features):
        frame = causal_neighbourhood(frame, history)
    if "corridor_event_rate" in features:
        frame = target_encoding(frame, closure_rates(clean_events) if rates is None else rates)
    columns = temporal(F.col("start")) | spatial() | categorical() | textual(F.col("description"))
    made = [columns[f].alias(f) if f in columns else F.col(f) for f in features]
    return frame.select(*[F.col(c) for c in keep if c not in features], *made)


def group_columns(*groups: str) -> list[str]:
    return [c for g in groups for c in FEATURE_GROUPS[g]]


def without_groups(*groups: str) -> list[str]:
    dropped = set(group_columns(*groups))
    return [c for c in FEATURES if c not in dropped]


def top_levels(frame: DataFrame, columns: Iterable[str], most: int = 250) -> DataFrame:
    """(feature, level, n) of the most frequent levels per column, ties by name."""
    columns = list(columns)
    long = frame.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "feature", "level")
    counted = long.where(F.col("level").isNotNull()).groupBy("feature", "level").agg(
        F.count("*").alias("n"))
    order = W.partitionBy("feature").orderBy(F.desc("n"), "level")
    return (counted.withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= most).drop("place"))


def learn_levels(frame: DataFrame, columns: Iterable[str] = tuple(CATEGORICAL_FEATURES),
                 most: int = 250) -> dict[str, list[str]]:
    """The level sets as a dictionary: at most `most` names per column."""
    columns = [c for c in columns if c in frame.columns]
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for row in top_levels(frame, columns, most).orderBy("feature", F.desc("n"), "level").toLocalIterator():
        levels[row["feature"]].append(row["level"])
    return levels


def cap_levels(frame: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Levels outside the learned sets collapse to one name."""
    def capped(c: str) -> Column:
        value = F.col(c).cast("string")
        if not levels[c]:
            return F.lit(OTHER_LEVEL).alias(c)
        known = F.expr(f"CAST(`{c}` AS STRING) IN ({', '.join(text.literal(v) for v in levels[c])})")
        return F.when(known, value).otherwise(OTHER_LEVEL).alias(c)

    return frame.select([capped(c) if c in levels else F.col(c) for c in frame.columns])


def cap_categories(frame: DataFrame, columns: Iterable[str] = tuple(CATEGORICAL_FEATURES),
                   most: int = 250) -> DataFrame:
    return cap_levels(frame, learn_levels(frame, columns, most))
