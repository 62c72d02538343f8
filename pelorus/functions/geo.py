"""Spherical geometry as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8


def wrap_lon(lon: Column) -> Column:
    """Longitude modulo 360, in [0, 360)."""
    return F.pmod(F.pmod(lon, F.lit(360.0)), F.lit(360.0))


def lon_gap(a: Column, b: Column) -> Column:
    """Smallest difference of two longitudes in degrees, 0 to 180."""
    return F.abs(F.pmod(a - b + F.lit(180.0), F.lit(360.0)) - F.lit(180.0))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on the mean sphere, in metres."""
    s1 = F.sin(F.radians(lat2 - lat1) / 2)
    s2 = F.sin(F.radians(lon2 - lon1) / 2)
    h = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def usable_point(lat: Column, lon: Column) -> Column:
    """True where both coordinates are finite numbers and the latitude exists on a sphere."""
    return F.coalesce(
        ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90.0) & (F.abs(lon) < 1e9), F.lit(False)
    )
