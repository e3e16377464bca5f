"""Time columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.constants import LOCAL_ZONE


def parse_utc(text: Column) -> Column:
    """Tolerant parse of a timestamp string to UTC wall clock; null where it does not parse."""
    return text.try_cast("timestamp").cast("timestamp_ntz")


def utc_to_local(utc: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def local_to_utc(local: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def utc_text(utc: Column) -> Column:
    """The export's own text form of a UTC timestamp."""
    return F.concat(F.date_format(utc, "yyyy-MM-dd HH:mm:ss"), F.lit("+00"))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch (bigint). The session zone is UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def minutes_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(6e7)


def fractional_hour(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def cycle(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value's place in a period."""
    angle = value * F.lit(2 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def is_weekend(dow: Column) -> Column:
    return (dow >= 5).cast("int")


def is_peak(hour: Column) -> Column:
    return (hour.between(8, 11) | hour.between(17, 20)).cast("int")


def daypart(hour: Column) -> Column:
    return (F.when(hour <= 6, "night")
            .when(hour <= 11, "morning")
            .when(hour <= 16, "afternoon")
            .when(hour <= 21, "evening")
            .otherwise("latenight"))


def hour_of_week(ts: Column) -> Column:
    return F.weekday(ts) * 24 + F.hour(ts)
