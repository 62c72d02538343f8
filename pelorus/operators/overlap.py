"""Scenes with a footprint and the reports, sightings and tracks that meet them in space and time.

A scene (scene_id, at_us, ring) covers a ring of (lon, lat) structs around an instant. Joins go by slices of time and
grid cells at once, so that neither a busy hour nor a busy harbour is one key. Defined cases: a footprint that is null,
open or of fewer than four points covers nothing; a null instant meets nothing; points on an edge are inside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelorus.functions.geo import EARTH_RADIUS_M, haversine_m
from pelorus.operators import alignment

#: Names of what became of a scene (fixed values of the report).
STATES = ("invalid_identity_or_time", "missing_or_invalid_footprint", "barred_group", "temporal_candidate", "sparse_support_only", "no_observed_overlap")
CELL_DEG = 0.25
CLOSE_S, BRACKET_S, HISTORY_S = 120.0, 240.0, 1800.0
#: Farther than a ship sails within the age of an aligned report.
MARGIN_M = 12_000.0


def complete(ring: Column) -> Column:
    """True for a closed ring of four points and more."""
    n = F.size(ring)
    return F.coalesce((n >= 4) & (F.get(ring, F.lit(0)) == F.get(ring, n - 1)) & ~F.exists(ring, lambda p: p["lon"].isNull() | p["lat"].isNull()), F.lit(False))


def covers(ring: Column, lon: Column, lat: Column) -> Column:
    """True where a closed ring holds a point or has it on its edge; a column expression, without Python."""
    edges = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("edge"))

    def step(state: Column, e: Column) -> Column:
        x1, y1, x2, y2 = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        on = ((x2 - x1) * (lat - y1) == (y2 - y1) * (lon - x1)) & lon.between(F.least(x1, x2), F.greatest(x1, x2)) & lat.between(F.least(y1, y2), F.greatest(y1, y2))
        over = ((y1 > lat) != (y2 > lat)) & (lon < F.try_divide((x2 - x1) * (lat - y1), y2 - y1) + x1)
        return F.struct((state["inside"] != F.coalesce(over, F.lit(False))).alias("inside"), (state["edge"] | F.coalesce(on, F.lit(False))).alias("edge"))

    inside = F.aggregate(edges, start, step, lambda s: s["inside"] | s["edge"])
    return F.coalesce(complete(ring) & inside, F.lit(False))


def _cells(df: DataFrame, west: Column, south: Column, east: Column, north: Column) -> DataFrame:
    """df once for each grid cell that a box touches."""
    steps = lambda a, b: F.sequence(F.floor(a / CELL_DEG).cast("int"), F.floor(b / CELL_DEG).cast("int"))
    return df.withColumn("_x", F.explode(steps(west, east))).withColumn("_y", F.explode(steps(south, north)))


def _slices(df: DataFrame, half_s: float, slice_s: int = 600) -> DataFrame:
    """df (at_us) once for each slice of time within half_s of its instant."""
    half, slice_us = int(half_s * 1e6), slice_s * 1_000_000
    return df.withColumn("_slice", F.explode(F.sequence(F.floor((F.col("at_us") - half) / slice_us), F.floor((F.col("at_us") + half) / slice_us))))


def _placed(reports: DataFrame, slice_s: int = 600) -> DataFrame:
    """reports (t_us, lat, lon) with their slice and cell."""
    cell = lambda c: F.floor(F.col(c) / CELL_DEG).cast("int")
    return reports.withColumn("_slice", F.floor(F.col("t_us") / (slice_s * 1_000_000))).withColumn("_x", cell("lon")).withColumn("_y", cell("lat"))


def in_box_and_time(scenes: DataFrame, reports: DataFrame, half_s: float) -> DataFrame:
    """Pairs of a scene (at_us, west, south, east, north) and a report (t_us, lat, lon) in its box within half_s."""
    visits = _cells(_slices(scenes.where("at_us is not null and west <= east and south <= north"), half_s), *[F.col(c) for c in ("west", "south", "east", "north")])
    near = _placed(reports).join(visits, ["_slice", "_x", "_y"]).drop("_slice", "_x", "_y")
    return near.where((F.abs(F.col("t_us") - F.col("at_us")) <= int(half_s * 1e6)) & F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north")))


def boxed(scenes: DataFrame, margin_m: float = 0.0) -> DataFrame:
    """Scenes whose ring is complete, with its box, widened by a margin."""
    kept = scenes.where(complete(F.col("ring")))
    lons, lats = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    wide = math.degrees(margin_m / EARTH_RADIUS_M)
    edge = F.least(F.lit(89.0), F.greatest(F.abs(F.array_min(lats)), F.abs(F.array_max(lats))) + wide)
    dlon = wide / F.cos(F.radians(edge))
    return kept.select("*", (F.array_min(lons) - dlon).alias("west"), (F.array_min(lats) - wide).alias("south"), (F.array_max(lons) + dlon).alias("east"), (F.array_max(lats) + wide).alias("north"))


def in_swath(scenes: DataFrame, reports: DataFrame, half_s: float) -> DataFrame:
    """Pairs of a scene and a report in its footprint within half_s; a footprint that is none lets nothing pass."""
    pairs = in_box_and_time(boxed(scenes), reports, half_s)
    return pairs.where(covers(F.col("ring"), F.col("lon"), F.col("lat"))).drop("west", "south", "east", "north")


def around(centres: DataFrame, reports: DataFrame, half_s: float, base_m: float, drift_m_s: float) -> DataFrame:
    """Pairs of a centre (at_us, c_lat, c_lon) and a report within half_s and base_m plus drift_m_s for each second between."""
    far = math.degrees((base_m + drift_m_s * half_s) / EARTH_RADIUS_M) * (1 + 1e-9)
    dlon = far / F.cos(F.radians(F.least(F.lit(89.0), F.abs("c_lat") + far)))
    box = [(F.col("c_lon") - dlon).alias("west"), (F.col("c_lat") - far).alias("south"), (F.col("c_lon") + dlon).alias("east"), (F.col("c_lat") + far).alias("north")]
    pairs = in_box_and_time(centres.select("*", *box), reports, half_s).drop("west", "south", "east", "north")
    offset = F.abs(F.col("t_us") - F.col("at_us")) / 1e6
    pairs = pairs.withColumn("offset_s", offset).withColumn("distance_m", haversine_m(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon")))
    return pairs.where(F.col("distance_m") <= base_m + drift_m_s * F.col("offset_s"))


def supports(scenes: DataFrame, reports: DataFrame) -> DataFrame:
    """scene_id, user_id, nearest_s, bracket_s of the vessels aligned into a scene's footprint.

    reports: cleaned ones with t_us. A vessel comes into question if a report of it lies near the footprint; then all
    its reports around the instant count, wherever they are, as one elsewhere may speak against the track.
    """
    near = in_box_and_time(boxed(scenes, MARGIN_M), reports, alignment.AGE_S).select("scene_id", "at_us", "user_id").distinct()
    found = alignment.asof(near, reports, alignment.AGE_S, HISTORY_S)
    before, after = (F.col("at_us") - F.col("left.t_us")) / 1e6, (F.col("right.t_us") - F.col("at_us")) / 1e6
    bracket = F.when(before == 0, F.lit(0.0)).otherwise(before + after)
    history = found.select("scene_id", "user_id", "at_us", "left", "right", "torn", "reports", F.least(before, after).alias("nearest_s"), bracket.alias("bracket_s"))
    inside = alignment.placed(history, "nearest_s", "bracket_s").join(scenes.select("scene_id", "ring"), "scene_id").where(covers(F.col("ring"), F.col("lon"), F.col("lat")))
    return inside.select("scene_id", "user_id", "lat", "lon", "method", "nearest_s", "bracket_s")


def audit(scenes: DataFrame, reports: DataFrame, barred: Column) -> DataFrame:
    """Each scene's status: why it is left out, or what observes it; with vessels aligned, close and bracketed.

    scenes: scene_id, at_us, ring and what `barred` needs, true where a scene must not be used.
    """
    usable = scenes.where(F.col("at_us").isNotNull() & complete(F.col("ring")) & ~F.coalesce(barred, F.lit(False)))
    held = supports(usable, reports).groupBy("scene_id").agg(
        F.count("*").alias("aligned"), F.count_if(F.col("nearest_s") <= CLOSE_S).alias("close"), F.count_if(F.col("bracket_s") <= BRACKET_S).alias("bracketed")
    )
    raw = in_swath(usable, reports, HISTORY_S).groupBy("scene_id").agg(F.count("*").alias("rows"))
    status = (
        F.when(F.col("at_us").isNull() | F.col("scene_id").isNull(), STATES[0]).when(~complete(F.col("ring")), STATES[1])
        .when(F.coalesce(barred, F.lit(False)), STATES[2]).when(F.col("close") > 0, STATES[3]).when(F.col("rows") > 0, STATES[4]).otherwise(STATES[5])
    )
    joined = scenes.join(held, "scene_id", "left").join(raw, "scene_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("scene_id", status.alias("status"), count("aligned"), count("close"), count("bracketed"), count("rows"))


def repeats(reports: DataFrame, key: str, row: str, span_s: float, base_m: float, drift_m_s: float) -> DataFrame:
    """Per row how many other rows of its key lie within span_s, and how many of them are compatible in place.

    Rows (t_us, lat, lon) of a key meet by slices of time, each pair once, so that a long history is no one group.
    """
    slice_us = int(span_s * 1e6)
    left = reports.select(key, row, "t_us", "lat", "lon").withColumn("_slice", F.floor(F.col("t_us") / slice_us))
    right = left.select(key, "_slice", *[F.col(c).alias(f"o_{c}") for c in (row, "t_us", "lat", "lon")])
    right = right.withColumn("_slice", F.explode(F.array("_slice", F.col("_slice") - 1)))  # a later row also visits the slice before
    gap = F.col("o_t_us") - F.col("t_us")
    later = ((gap > 0) | ((gap == 0) & (F.col(f"o_{row}") > F.col(row)))) & (gap <= slice_us)
    met = left.join(right, [key, "_slice"]).where(later)
    fits = haversine_m(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) <= base_m + drift_m_s * gap / 1e6
    pair = met.select(F.array(F.col(row), F.col(f"o_{row}")).alias("ids"), fits.cast("int").alias("fits"))
    return pair.select(F.explode("ids").alias(row), "fits").groupBy(row).agg(F.count("*").alias("others"), F.sum("fits").alias("compatible"))


def bracketing_beats(beats: DataFrame, breaks: DataFrame, key: str, t: str, centre: float, longest_s: float) -> DataFrame:
    """By key the beats around an instant (a at or before, b at or after) that bracket it without a break.

    beats: key, t, connected; both must be connected, and the gap and either side at most longest_s; a break at
    either end or between speaks against it.
    """
    row = F.struct(F.col(t).alias("t"), "connected")
    ends = beats.groupBy(key).agg(F.max(F.when(F.col(t) <= centre, row)).alias("l"), F.min(F.when(F.col(t) >= centre, row)).alias("r")).where("l is not null and r is not null")
    ends = ends.where(F.col("l.connected") & F.col("r.connected") & (F.col("r.t") - F.col("l.t") <= longest_s))
    ends = ends.select(key, F.col("l.t").alias("a"), F.col("r.t").alias("b"))
    broken = ends.join(breaks.select(key, F.col(t).alias("_t")), key).where(F.col("_t").between(F.col("a"), F.col("b"))).select(key).distinct()
    return ends.join(broken, key, "left_anti")


def near_pairs(tracks: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of vessels (scene_id, user_id, lat, lon) of one scene within radius_m: scene_id, a, b, distance_m."""
    far = math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9)
    dlon = far / F.cos(F.radians(F.least(F.lit(89.0), F.abs("lat") + far)))
    one = _cells(tracks.select("scene_id", F.col("user_id").alias("a"), "lat", "lon"), F.col("lon") - dlon, F.col("lat") - far, F.col("lon") + dlon, F.col("lat") + far)
    cell = lambda c: F.floor(F.col(c) / CELL_DEG).cast("int")
    two = tracks.select("scene_id", F.col("user_id").alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), cell("lon").alias("_x"), cell("lat").alias("_y"))
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"))
    return one.join(two, ["scene_id", "_x", "_y"]).where("a < b").withColumn("distance_m", d).where(F.col("distance_m") <= radius_m).select("scene_id", "a", "b", "distance_m")


def reasons_of(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with `reasons`: the names of all checks that hold, in order; unknown counts as not holding."""
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])))


def counted_reasons(rows: DataFrame) -> DataFrame:
    """How many rows each reason has; rows without one count under 'passed'."""
    names = F.when(F.size("reasons") == 0, F.array(F.lit("passed"))).otherwise(F.col("reasons"))
    return rows.select(F.explode(names).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
