"""Angles, distances and index arithmetic on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.maths import Number, asin, cos, radians, sin, sqrt
from gridloom.functions.projections import EARTH_RADIUS


def normalize_lon(lon: Column) -> Column:
    """To (-180, 180]; 180 itself stays."""
    return F.when(lon.between(-180, 180), lon).otherwise(F.pmod(lon + 180, F.lit(360.0)) - 180)


def clamp_lat(lat: Column) -> Column:
    return F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat))


def haversine(lat1: Number, lon1: Number, lat2: Number, lon2: Number, radius: float = EARTH_RADIUS) -> Number:
    """Great-circle distance in the radius's unit."""
    dp, dl = sin((radians(lat2) - radians(lat1)) / 2), sin((radians(lon2) - radians(lon1)) / 2)
    h = dp * dp + cos(radians(lat1)) * cos(radians(lat2)) * dl * dl
    return asin(sqrt(F.least(F.lit(1.0), h) if isinstance(h, Column) else min(1.0, h))) * (2 * radius)


def cosine_of_angle(lat1: Number, lon1: Number, lat2: Number, lon2: Number) -> Number:
    """Cosine of the great-circle angle; the larger, the nearer."""
    return sin(radians(lat1)) * sin(radians(lat2)) + cos(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2) - radians(lon1))


def cell_index(value: Column, origin: float, step: float, size: int) -> Column:
    """Index on a regular axis, cut towards zero; null outside the axis."""
    at = ((value - origin) / step).cast("int")
    return F.when((at >= 0) & (at < size), at)


def bin_index(value: Column, low: float, high: float, size: int) -> Column:
    """Which of ``size`` equal bins of [low, high] holds the value; ends go to the outer bins."""
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor((value - low) / (high - low) * size))).cast("int")


def shift_lon(lon: Number, low: float, high: float) -> Number:
    """The longitude, or it a full turn east or west, whichever lies in [low, high]; else unchanged."""
    if isinstance(lon, Column):
        return F.when(lon.between(low, high), lon).when((lon + 360).between(low, high), lon + 360).when((lon - 360).between(low, high), lon - 360).otherwise(lon)
    return next((x for x in (lon, lon + 360, lon - 360) if low <= x <= high), lon)
