"""Points near other points, and points inside regions, by grid cells and an exact check.

Every point has one cell; the other side visits each cell its radius can reach, so a pair is met once
and needs no de-duplication. Rows of a grid are bands of latitude as high as the radius; each band is cut
into as many columns as keep a column at least a radius wide, so the grid holds up to the poles and over
the antimeridian.

Defined cases: rows with null, NaN or impossible coordinates join nothing; repeated rows give repeated
pairs (ids are kept as they come); equal points are at distance 0; empty tables give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelorus.functions.geo import EARTH_RADIUS_M, haversine_m, lon_gap, usable_point, wrap_lon

#: No more cells than this are ever salted, so the list of them is small whatever the input.
HOT_CELLS = 4096
#: Rows of a cell that one task takes without salting.
HOT_ROWS = 50_000


def _columns_in(row: Column, step: Column) -> Column:
    """Columns in a band of latitude: one at a pole, and never narrower than the band is high."""
    edge = F.greatest(F.abs(row * step - 90.0), F.abs((row + 1) * step - 90.0))
    fit = F.floor(F.lit(360.0) * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / step)
    return F.greatest(F.lit(1).cast("long"), fit.cast("long"))


def _column_of(lon: Column, columns: Column) -> Column:
    return F.floor(lon / 360.0 * columns).cast("long")


def _key(row: Column, column: Column) -> Column:
    return row * F.lit(1 << 31).cast("long") + column


def cell(lat: Column, lon: Column, step: Column) -> Column:
    """The cell of a point; lon in [0, 360), step in degrees."""
    row = F.floor((lat + 90.0) / step).cast("long")
    n = _columns_in(row, step)
    return _key(row, F.pmod(_column_of(lon, n), n))


def reach(df: DataFrame, lat: Column, lon: Column, step: Column, dlat: Column, dlon: Column, into: str) -> DataFrame:
    """df with one row for each cell that the box of +-dlat, +-dlon degrees around a point touches."""
    df = df.withColumn(
        "_row",
        F.explode(
            F.sequence(
                F.floor((F.greatest(lat - dlat, F.lit(-90.0)) + 90.0) / step).cast("long"),
                F.floor((F.least(lat + dlat, F.lit(90.0)) + 90.0) / step).cast("long"),
            )
        ),
    )
    n = _columns_in(F.col("_row"), step)
    first = _column_of(lon - dlon, n)
    last = F.least(_column_of(lon + dlon, n), first + n - 1)
    df = df.withColumn("_col", F.explode(F.sequence(first, last)))
    return df.withColumn(into, _key(F.col("_row"), F.pmod(F.col("_col"), n))).drop("_row", "_col")


def points(df: DataFrame, id_col: Column, lat: Column, lon: Column, prefix: str) -> DataFrame:
    """Ids and coordinates of the usable points, columns named by the prefix."""
    return (
        df.select(id_col.alias(f"{prefix}_id"), lat.cast("double").alias(f"{prefix}_lat"), lon.cast("double").alias("_lon"))
        .where(usable_point(F.col(f"{prefix}_lat"), F.col("_lon")))
        .withColumn(f"{prefix}_lon", wrap_lon(F.col("_lon")))
        .drop("_lon")
    )


def salted(many: DataFrame, few: DataFrame, cell_col: str, spread: str, total: int | None, hot_rows: int):
    """Both sides with a salt: rows of hot cells of `many` are spread, rows of `few` in such cells repeated.

    A cell is hot above hot_rows rows and above a HOT_CELLS-th of the table, which bounds their number.
    """
    total = many.count() if total is None else total
    limit = max(hot_rows, math.ceil(total / HOT_CELLS))
    if total <= limit:
        return many.withColumn("_salt", F.lit(0)), few.withColumn("_salt", F.lit(0))
    hot = (
        many.groupBy(cell_col).count().where(F.col("count") > limit)
        .select(F.col(cell_col).alias("_hot"), F.ceil(F.col("count") / limit).cast("int").alias("_parts"))
    )
    hot = F.broadcast(hot)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    many = (
        many.join(hot, F.col(cell_col) == F.col("_hot"), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_hot", "_parts")
    )
    few = (
        few.join(hot, F.col(cell_col) == F.col("_hot"), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hot", "_parts")
    )
    return many, few


def within_distance(left: DataFrame, right: DataFrame, radius_m: float, total: int | None = None, hot_rows: int = HOT_ROWS, once: bool = False) -> DataFrame:
    """Pairs of a left and a right point at most radius_m apart on the sphere, with distance_m.

    left and right come from points() with the prefixes "l" and "r"; the smaller side should be left, as
    it is the one repeated per cell. once: of a table with itself each pair once, the smaller id left. total: rows of right or more, counted if not given; it only sets when a cell counts as hot.
    """
    step = math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9)
    reached = math.sin(min(radius_m / EARTH_RADIUS_M, math.pi / 2))
    width = F.lit(reached) / F.greatest(F.cos(F.radians("l_lat")), F.lit(1e-15))
    near_pole = (F.abs("l_lat") + step >= 90.0) | (width >= 1.0)
    dlon = F.when(near_pole, 180.0).otherwise(F.degrees(F.asin(F.least(width, F.lit(1.0)))) * (1 + 1e-9) + 1e-12)
    few = reach(left, F.col("l_lat"), F.col("l_lon"), F.lit(step), F.lit(step), dlon, "cell")
    many = right.withColumn("cell", cell(F.col("r_lat"), F.col("r_lon"), F.lit(step)))
    many, few = salted(many, few, "cell", "r_id", total, hot_rows)
    distance = haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))
    met = many.join(few, ["cell", "_salt"])
    return (
        (met.where("l_id < r_id") if once else met)
        .where(F.abs(F.col("l_lat") - F.col("r_lat")) <= step)
        .withColumn("distance_m", distance)
        .where(F.col("distance_m") <= radius_m)
        .select("l_id", "r_id", "distance_m")
    )


def inside_boxes(located: DataFrame, regions: DataFrame, total: int | None = None, base_m: float = 128.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of a point (prefix "l") and a square region (prefix "r", with r_half_m) that contains it.

    Inside: |north| and |east| of the point from the centre, measured on the sphere at the centre's
    latitude, are both at most r_half_m. Regions of unlike size use unlike grids, one per power of two of
    base_m, so none covers more than nine cells; points visit each grid in use (at most 40).
    """
    sized = regions.where(F.coalesce(F.col("r_half_m") >= 0, F.lit(False)))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("r_half_m"), F.lit(1.0)) / base_m))).cast("int")
    sized = sized.withColumn("level", F.least(level, F.lit(40)))
    levels = sorted(r[0] for r in sized.select("level").distinct().collect())
    step = F.degrees(F.lit(base_m) * F.pow(F.lit(2.0), F.col("level")) / EARTH_RADIUS_M) * (1 + 1e-9)
    dlat = F.degrees(F.col("r_half_m") / EARTH_RADIUS_M) * (1 + 1e-9) + 1e-12
    dlon = F.least(F.lit(180.0), dlat / F.greatest(F.cos(F.radians("r_lat")), F.lit(1e-12)))
    few = reach(sized, F.col("r_lat"), F.col("r_lon"), step, F.least(dlat, F.lit(180.0)), dlon, "cell")
    many = located.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    many = many.withColumn("cell", cell(F.col("l_lat"), F.col("l_lon"), step) * 64 + F.col("level"))
    few = few.withColumn("cell", F.col("cell") * 64 + F.col("level")).drop("level")
    many, few = salted(many, few, "cell", "l_id", None if total is None else total * max(1, len(levels)), hot_rows)
    north = F.radians(F.abs(F.col("l_lat") - F.col("r_lat"))) * EARTH_RADIUS_M
    east = F.radians(lon_gap(F.col("l_lon"), F.col("r_lon"))) * F.cos(F.radians("r_lat")) * EARTH_RADIUS_M
    return (
        many.join(few, ["cell", "_salt"])
        .where((north <= F.col("r_half_m")) & (east <= F.col("r_half_m")))
        .select("l_id", "r_id")
    )


def nearest_site(places: DataFrame, sites: DataFrame, radius_m: float) -> DataFrame:
    """l_id, r_id, distance_m: the nearest site within radius_m of each place, of equally near ones the first by id."""
    near = within_distance(places, sites, radius_m)
    best = near.groupBy("l_id").agg(F.min(F.struct("distance_m", "r_id")).alias("b"))
    return best.select("l_id", F.col("b.r_id").alias("r_id"), F.col("b.distance_m").alias("distance_m"))
