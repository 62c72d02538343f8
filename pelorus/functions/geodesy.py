"""Geodesics on the WGS84 ellipsoid, vectorised; and the projections in use."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

A_M, FLAT = 6_378_137.0, 1 / 298.257223563
B_M = A_M * (1 - FLAT)
ECC2 = FLAT * (2 - FLAT)


def _pair(*names: str) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


def inverse(lat1, lon1, lat2, lon2):
    """Distance in metres and initial azimuth in degrees, by Vincenty's iteration."""
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(v, float)) for v in (lat1, lon1, lat2, lon2))
    u1, u2 = np.arctan((1 - FLAT) * np.tan(lat1)), np.arctan((1 - FLAT) * np.tan(lat2))
    gap = (lon2 - lon1 + np.pi) % (2 * np.pi) - np.pi
    lam = gap.copy()
    with np.errstate(all="ignore"):
        for _ in range(60):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(np.cos(u2) * sl, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * cl)
            cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, np.cos(u1) * np.cos(u2) * sl / np.where(ss > 0, ss, 1), 0.0)
            ca2 = 1 - sa**2
            c2m = np.where(ca2 > 0, cs - 2 * np.sin(u1) * np.sin(u2) / np.where(ca2 > 0, ca2, 1), 0.0)
            c = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
            new = gap + (1 - c) * FLAT * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
            done = np.nanmax(np.abs(new - lam), initial=0.0) < 1e-13
            lam = new
            if done:
                break
        k = ca2 * (A_M**2 - B_M**2) / B_M**2
        ka = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        kb = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        ds = kb * ss * (c2m + kb / 4 * (cs * (2 * c2m**2 - 1) - kb / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        azimuth = np.degrees(np.arctan2(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))) % 360
    return B_M * ka * (sigma - ds), azimuth


def forward(lat, lon, azimuth, distance):
    """Latitude and longitude reached from a point along an azimuth."""
    lat, lon, az = (np.radians(np.asarray(v, float)) for v in (lat, lon, azimuth))
    s = np.asarray(distance, float)
    u = np.arctan((1 - FLAT) * np.tan(lat))
    s1 = np.arctan2(np.tan(u), np.cos(az))
    sa = np.cos(u) * np.sin(az)
    ca2 = 1 - sa**2
    k = ca2 * (A_M**2 - B_M**2) / B_M**2
    ka = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    kb = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    sigma = s / (B_M * ka)
    for _ in range(30):
        c2m, ss, cs = np.cos(2 * s1 + sigma), np.sin(sigma), np.cos(sigma)
        ds = kb * ss * (c2m + kb / 4 * (cs * (2 * c2m**2 - 1) - kb / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        new = s / (B_M * ka) + ds
        done = np.nanmax(np.abs(new - sigma), initial=0.0) < 1e-15
        sigma = new
        if done:
            break
    c2m, ss, cs = np.cos(2 * s1 + sigma), np.sin(sigma), np.cos(sigma)
    out_lat = np.arctan2(np.sin(u) * cs + np.cos(u) * ss * np.cos(az), (1 - FLAT) * np.hypot(sa, np.sin(u) * ss - np.cos(u) * cs * np.cos(az)))
    lam = np.arctan2(ss * np.sin(az), np.cos(u) * cs - np.sin(u) * ss * np.cos(az))
    c = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
    out_lon = lon + lam - (1 - c) * FLAT * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
    return np.degrees(out_lat), (np.degrees(out_lon) + 180) % 360 - 180


@pandas_udf(_pair("distance_m", "azimuth_deg"))
def geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
    d, a = inverse(lat1, lon1, lat2, lon2)
    return pd.DataFrame({"distance_m": d, "azimuth_deg": a})


@pandas_udf(_pair("lat", "lon"))
def destination(lat: pd.Series, lon: pd.Series, azimuth: pd.Series, distance: pd.Series) -> pd.DataFrame:
    la, lo = forward(lat, lon, azimuth, distance)
    return pd.DataFrame({"lat": la, "lon": lo})


def local_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the ellipsoid for points up to tens of kilometres apart, by its radii of curvature."""
    mid = F.radians((lat1 + lat2) / 2)
    w2 = 1 - ECC2 * F.sin(mid) * F.sin(mid)
    north = F.radians(lat2 - lat1) * A_M * (1 - ECC2) / (w2 * F.sqrt(w2))
    gap = F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0
    east = F.radians(gap) * A_M / F.sqrt(w2) * F.cos(mid)
    return F.sqrt(north * north + east * east)


def mercator_pixel(lon: Column, lat: Column, zoom: int, tile: int = 512) -> Column:
    """(col, row) of a point among Web-Mercator pixels."""
    world = float(tile * 2**zoom)
    s = F.radians(lat)
    return F.struct(
        ((lon + 180.0) / 360.0 * world).alias("col"), ((1 - F.ln(F.tan(s) + 1 / F.cos(s)) / F.pi()) / 2 * world).alias("row")
    )


def mercator_lonlat(col: Column, row: Column, zoom: int, tile: int = 512) -> Column:
    world = float(tile * 2**zoom)
    return F.struct((col / world * 360.0 - 180.0).alias("lon"), F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * row / world)))).alias("lat"))


def lambert(lat, lon, phi1=49.0, phi2=77.0, lat0=63.390675, lon0=-91.8666666667, fe=6_200_000.0, fn=3_000_000.0):
    """Lambert conformal conic on the ellipsoid; the defaults are the parameters of EPSG:3347 (fixed values)."""
    e = np.sqrt(ECC2)

    def m(p):
        return np.cos(p) / np.sqrt(1 - ECC2 * np.sin(p) ** 2)

    def t(p):
        return np.tan(np.pi / 4 - p / 2) / ((1 - e * np.sin(p)) / (1 + e * np.sin(p))) ** (e / 2)

    p1, p2, p0, p = (np.radians(np.asarray(v, float)) for v in (phi1, phi2, lat0, lat))
    n = (np.log(m(p1)) - np.log(m(p2))) / (np.log(t(p1)) - np.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    r, r0 = A_M * f * t(p) ** n, A_M * f * t(p0) ** n
    theta = n * np.radians((np.asarray(lon, float) - lon0 + 180) % 360 - 180)
    return fe + r * np.sin(theta), fn + r0 - r * np.cos(theta)


def ring_area_km2(ring) -> float | None:
    """Area of a ring of (lon, lat) on the sphere of equal area to the ellipsoid; edges are straight in longitude and sine of latitude there."""
    if ring is None:
        return None
    p = np.array([(q["lon"], q["lat"]) for q in ring], float)
    if len(p) > 1 and (p[0] == p[-1]).all():
        p = p[:-1]
    if len(p) < 3 or np.isnan(p).any():
        return None
    e = np.sqrt(ECC2)

    def q(s):
        return (1 - ECC2) * (s / (1 - ECC2 * s * s) - np.log((1 - e * s) / (1 + e * s)) / (2 * e))

    whole = q(1.0)
    radius2 = A_M**2 * whole / 2
    sin_lat = q(np.sin(np.radians(p[:, 1]))) / whole
    gap = np.radians((np.roll(p[:, 0], -1) - p[:, 0] + 180) % 360 - 180)
    return float(abs(np.sum(gap * (sin_lat + np.roll(sin_lat, -1)) / 2)) * radius2 / 1e6)


def azimuthal_equidistant(lat, lon, lat0: float, lon0: float):
    """(x, y) in metres about a centre: true distance and azimuth on the ellipsoid."""
    lat, lon = np.asarray(lat, float), np.asarray(lon, float)
    d, az = inverse(np.full(lat.shape, lat0), np.full(lat.shape, lon0), lat, lon)
    return d * np.sin(np.radians(az)), d * np.cos(np.radians(az))


def lambert_inverse(x, y, phi1=49.0, phi2=77.0, lat0=63.390675, lon0=-91.8666666667, fe=6_200_000.0, fn=3_000_000.0):
    """(lat, lon) of a place under lambert() with the same parameters."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    # a parallel far south gives the cone: its radius and the pole's follow from two known places
    north = lambert(90.0 - 1e-12, lon0, phi1, phi2, lat0, lon0, fe, fn)[1]
    dx, dy = x - fe, north - y
    r = np.hypot(dx, dy)
    step = lambert(lat0, lon0 + 10.0, phi1, phi2, lat0, lon0, fe, fn)
    n = np.arctan2(step[0] - fe, north - step[1]) / np.radians(10.0)
    lon = lon0 + np.degrees(np.arctan2(dx, dy) / n)
    low, high = np.full(r.shape, -89.0), np.full(r.shape, 90.0 - 1e-12)
    for _ in range(80):  # the radius falls with latitude
        mid = (low + high) / 2
        further = north - lambert(mid, lon0, phi1, phi2, lat0, lon0, fe, fn)[1] > r
        low, high = np.where(further, mid, low), np.where(further, high, mid)
    return (low + high) / 2, (lon + 180) % 360 - 180


def envelope(lat: float, lon: float, half_m: float) -> list[tuple[float, float]]:
    """The corners (lon, lat) of a square about a place on the plane of lambert(), closed."""
    x, y = lambert(lat, lon)
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    la, lo = lambert_inverse([x + a * half_m for a, _ in corners], [y + b * half_m for _, b in corners])
    return [(float(o), float(a)) for a, o in zip(la, lo, strict=True)]
