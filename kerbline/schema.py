"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of the raw export, in its order, and those that hold times.
_TEXT = [
    "id", "event_type", "event_cause", "corridor", "veh_type", "zone", "priority",
    "requires_road_closure",
]
_TAIL = [
    "start_datetime", "end_datetime", "resolved_datetime", "closed_datetime",
    "created_date", "modified_datetime", "status", "authenticated", "junction",
    "police_station", "address", "description", "direction", "reason_breakdown",
]
TIMESTAMP_COLUMNS = [
    "start_datetime", "end_datetime", "created_date", "resolved_datetime",
    "closed_datetime", "modified_datetime",
]
COORDINATES = ["latitude", "longitude"]

RAW = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, T.DoubleType()) for c in COORDINATES]
    + [T.StructField(c, T.StringType()) for c in _TAIL]
)
RAW_COLUMNS = RAW.fieldNames()

# Columns profiled one by one (fixed list).
PROFILED = [
    "event_type", "event_cause", "status", "requires_road_closure", "priority", "corridor",
    "veh_type", "zone", "direction", "authenticated", "reason_breakdown",
]

EDGES = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("w", T.DoubleType()),
])

METRICS = T.StructType([
    T.StructField("ts", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.StringType()),
])
