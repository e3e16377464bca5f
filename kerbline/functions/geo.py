"""Distances, and a global latitude-band grid for distance joins.

The grid cuts the sphere into bands of equal height and each band into whole cells of about
the same width, so that a cell keeps its size away from the equator and the antimeridian is an
ordinary cell border.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.constants import EARTH_RADIUS_KM

KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180.0
_SLACK = 1.0 + 1e-9
_BAND_STRIDE = 1 << 32


def half_chord_squared(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The haversine of the central angle (sin^2 of its half)."""
    dlat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    dlon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlon * dlon


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return arc_km(half_chord_squared(lat1, lon1, lat2, lon2))


def arc_km(half_chord_sq: Column) -> Column:
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(half_chord_sq))


def reach(radius_km: float) -> float:
    """A bound on the haversine for points within the radius, a hair wide."""
    return math.sin(min(radius_km / (2 * EARTH_RADIUS_KM), math.pi / 2)) ** 2 * _SLACK


def _band(lat: Column, step: Column) -> Column:
    return F.floor((lat + 90.0) / step)


def _cells_in_band(band: Column, step: Column) -> Column:
    middle = band * step + step / 2 - 90.0
    width = F.greatest(F.cos(F.radians(middle)), F.lit(0.0))
    return F.greatest(F.floor(F.lit(360.0) * width / step), F.lit(1).cast("bigint"))


def grid_cell(lat: Column, lon: Column, step: Column) -> Column:
    """The cell (bigint) a point falls in; `step` is the cell height in degrees."""
    band = _band(lat, step)
    n = _cells_in_band(band, step)
    slot = F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n)
    return band * _BAND_STRIDE + F.least(slot, n - 1)


def with_cover(df: DataFrame, lat: str, lon: str, radius_km: Column, step: Column,
               cell: str = "cell") -> DataFrame:
    """One row per grid cell that may hold a point within the radius."""
    arc = radius_km / F.lit(EARTH_RADIUS_KM) * F.lit(_SLACK) + F.lit(1e-12)
    arc_deg = F.degrees(arc)
    south = F.greatest(F.col(lat) - arc_deg, F.lit(-90.0))
    north = F.least(F.col(lat) + arc_deg, F.lit(90.0))
    touches_pole = (F.abs(F.col(lat)) + arc_deg) >= 90.0
    spread = F.when(touches_pole, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.sin(arc) / F.cos(F.radians(F.col(lat))), F.lit(1.0))))
        * F.lit(_SLACK))
    banded = df.select(
        "*", spread.alias("_spread"), step.alias("_step"),
        F.explode(F.sequence(_band(south, step), _band(north, step))).alias("_band"))
    n = _cells_in_band(F.col("_band"), F.col("_step"))
    west = F.floor((F.col(lon) - F.col("_spread") + 180.0) / 360.0 * n)
    east = F.floor((F.col(lon) + F.col("_spread") + 180.0) / 360.0 * n)
    east = F.least(east, west + n - 1)
    slotted = banded.select("*", n.alias("_n"), F.explode(F.sequence(west, east)).alias("_slot"))
    return (slotted
            .withColumn(cell, F.col("_band") * _BAND_STRIDE + F.pmod(F.col("_slot"), F.col("_n")))
            .drop("_spread", "_step", "_band", "_n", "_slot"))
