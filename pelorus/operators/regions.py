"""Points in polygons, and how far from a shoreline, by grid cells and an exact check.

Polygons have an outer ring and holes, as arrays of (lon, lat) structs; a point on an edge is inside.
Defined cases: a null or broken polygon (fewer than three corners) contains nothing and has no shore; points
without usable coordinates join nothing; a polygon must not span more than half the globe.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelorus.functions.geo import EARTH_RADIUS_M
from pelorus.operators.proximity import HOT_ROWS, cell, reach, salted

RING = "array<array<struct<lon: double, lat: double>>>"


def covers(lon: np.ndarray, lat: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Which points lie in the polygon or on its edge; NaN is outside. Longitudes count modulo 360."""
    inside = np.zeros(len(lon), bool)
    edge = np.zeros(len(lon), bool)
    known = ~(np.isnan(lon) | np.isnan(lat))
    middle = rings[0][:, 0].mean()
    x = (np.where(known, lon, 0) - middle + 180) % 360 - 180
    y = np.where(known, lat, 0)
    for ring in rings:
        rx, ry = (ring[:, 0] - middle + 180) % 360 - 180, ring[:, 1]
        for x1, y1, x2, y2 in zip(rx, ry, np.roll(rx, -1), np.roll(ry, -1), strict=True):
            cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            edge |= (cross == 0) & (x >= min(x1, x2)) & (x <= max(x1, x2)) & (y >= min(y1, y2)) & (y <= max(y1, y2))
            if y1 != y2:
                over = (y1 > y) != (y2 > y)
                inside ^= over & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return (inside | edge) & known


def edge_distance_m(lon: np.ndarray, lat: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Metres to the nearest edge, on a plane about each point (right to a part in a thousand within 50 km)."""
    out = np.full(len(lon), np.inf)
    k = math.pi / 180 * EARTH_RADIUS_M
    scale = np.cos(np.radians(lat)) * k
    for ring in rings:
        rx, ry = ring[:, 0], ring[:, 1]
        for x1, y1, x2, y2 in zip(rx, ry, np.roll(rx, -1), np.roll(ry, -1), strict=True):
            ax, ay = ((x1 - lon + 180) % 360 - 180) * scale, (y1 - lat) * k
            bx, by = ((x2 - lon + 180) % 360 - 180) * scale, (y2 - lat) * k
            dx, dy = bx - ax, by - ay
            n = dx * dx + dy * dy
            t = np.clip(-(ax * dx + ay * dy) / np.where(n > 0, n, 1), 0, 1)
            out = np.minimum(out, np.hypot(ax + t * dx, ay + t * dy))
    return out


def _rings(value) -> list[np.ndarray]:
    rings = [np.array([(p["lon"], p["lat"]) for p in r], float) for r in value if r is not None]
    rings = [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings]
    return [r for r in rings if len(r) >= 3]


def _candidates(points: DataFrame, polygons: DataFrame, margin_m: float) -> DataFrame:
    """Pairs of a point (l_id, l_lat, l_lon) and a polygon (r_id, rings) whose box, with a margin, holds it."""
    lons = F.transform(F.flatten("rings"), lambda p: p["lon"])
    lats = F.transform(F.flatten("rings"), lambda p: p["lat"])
    first = lons[0]
    near = F.transform(lons, lambda x: F.pmod(x - first + 180.0, F.lit(360.0)) - 180.0)
    boxed = polygons.where(F.size(F.flatten("rings")) >= 3).select(
        "r_id", "rings", F.pmod(first + (F.array_min(near) + F.array_max(near)) / 2, F.lit(360.0)).alias("_lon"), ((F.array_max(near) - F.array_min(near)) / 2).alias("_dlon"),
        ((F.array_min(lats) + F.array_max(lats)) / 2).alias("_lat"), ((F.array_max(lats) - F.array_min(lats)) / 2).alias("_dlat"),
    )
    wide = math.degrees(margin_m / EARTH_RADIUS_M)
    edge = F.least(F.lit(90.0), F.abs("_lat") + F.col("_dlat") + wide)
    boxed = boxed.withColumn("_dlon", F.least(F.lit(180.0), F.col("_dlon") + wide / F.greatest(F.cos(F.radians(edge)), F.lit(1e-9)) + 1e-9)).withColumn("_dlat", F.col("_dlat") + wide + 1e-9)
    size = F.greatest("_dlat", F.col("_dlon") * F.cos(F.radians("_lat")), F.lit(1e-3))
    boxed = boxed.withColumn("_level", F.ceil(F.log2(size / 1e-3)).cast("int"))
    levels = sorted(r[0] for r in boxed.select("_level").distinct().collect())
    step = F.lit(1e-3) * F.pow(F.lit(2.0), F.col("_level"))
    few = reach(boxed, F.col("_lat"), F.col("_lon"), step, F.col("_dlat"), F.col("_dlon"), "_cell")
    few = few.withColumn("_cell", F.col("_cell") * 64 + F.col("_level")).drop("_level")
    many = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    many = many.withColumn("_cell", cell(F.col("l_lat"), F.col("l_lon"), step) * 64 + F.col("_level")).drop("_level")
    in_box = (F.abs(F.col("l_lat") - F.col("_lat")) <= F.col("_dlat")) & (F.abs(F.pmod(F.col("l_lon") - F.col("_lon") + 180.0, F.lit(360.0)) - 180.0) <= F.col("_dlon"))
    many, few = salted(many, few, "_cell", "l_id", None, HOT_ROWS)
    return many.join(few, ["_cell", "_salt"]).where(in_box).drop("_cell", "_salt")


def covers_column(rings: Column, lon: Column, lat: Column) -> Column:
    """True where a polygon (outer ring and holes, closed or not) covers a point or has it on an edge; without Python."""
    first = F.get(F.get(rings, F.lit(0)), F.lit(0))["lon"]
    turn = lambda x: F.pmod(x - first + 180.0, F.lit(360.0)) - 180.0
    px = turn(lon)

    def edges(ring: Column) -> Column:
        return F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1))), lambda a, b: F.struct(turn(a["lon"]).alias("x1"), a["lat"].alias("y1"), turn(b["lon"]).alias("x2"), b["lat"].alias("y2")))

    sound = F.filter(F.coalesce(rings, F.array().cast(RING)), lambda r: F.size(F.array_distinct(r)) >= 3)

    def step(state: Column, e: Column) -> Column:
        x1, y1, x2, y2 = (e[k] for k in ("x1", "y1", "x2", "y2"))
        on = ((x2 - x1) * (lat - y1) == (y2 - y1) * (px - x1)) & px.between(F.least(x1, x2), F.greatest(x1, x2)) & lat.between(F.least(y1, y2), F.greatest(y1, y2))
        over = ((y1 > lat) != (y2 > lat)) & (px < F.try_divide((x2 - x1) * (lat - y1), y2 - y1) + x1)
        return F.struct((state["inside"] != F.coalesce(over, F.lit(False))).alias("inside"), (state["edge"] | F.coalesce(on, F.lit(False))).alias("edge"))

    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("edge"))
    return F.aggregate(F.flatten(F.transform(sound, edges)), start, step, lambda s: s["inside"] | s["edge"])


def containing(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """l_id, r_id: the polygons (r_id, rings) that cover each point (l_id, l_lat, l_lon)."""
    pairs = _candidates(points, polygons, 0.0)
    return pairs.where(covers_column(F.col("rings"), F.col("l_lon"), F.col("l_lat"))).select("l_id", "r_id")


def shore(points: DataFrame, land: DataFrame, reach_m: float) -> DataFrame:
    """l_id, surface, shore_m: land or water, and the distance to the nearest edge, below zero inland.

    Edges farther than reach_m are not looked for: shore_m is then null, which is "beyond", not "unknown".
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            inside, far = np.zeros(len(b), bool), np.full(len(b), np.inf)
            for _, at in b.groupby("r_id").indices.items():
                rings = _rings(b["rings"].iloc[at[0]])
                if rings:
                    lon, lat = b["l_lon"].to_numpy()[at], b["l_lat"].to_numpy()[at]
                    inside[at], far[at] = covers(lon, lat, rings), edge_distance_m(lon, lat, rings)
            yield pd.DataFrame({"l_id": b["l_id"], "inside": inside, "m": far})

    pairs = _candidates(points, land, reach_m).select("l_id", "l_lat", "l_lon", "r_id", "rings")
    met = pairs.mapInPandas(run, "l_id bigint, inside boolean, m double").groupBy("l_id").agg(F.max("inside").alias("inside"), F.min("m").alias("m"))
    out = points.select("l_id").join(met, "l_id", "left")
    inside = F.coalesce("inside", F.lit(False))
    metres = F.when(F.col("m") <= reach_m, F.when(inside, -F.col("m")).otherwise(F.col("m")))
    return out.select("l_id", F.when(inside, "land").otherwise("water").alias("surface"), metres.alias("shore_m"))
