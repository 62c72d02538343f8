"""Stays and the voyages between them, from position reports with noise, silences and wrong positions.

Each gap session of a vessel is simplified by time-synchronised Douglas-Peucker: a report is kept where it
strays from where the simplified track has the vessel at that instant. Slow simplified legs become stops,
the rest are voyages. A stop is then held against its reports: they lie within SPOT_M of one spot, and it
lasts from the first to the last of them. Stops at the same spot with nothing but silence between are one.

Defined cases: reports without a usable position or time take no part; a report delivered twice counts
once; a vessel with one report has no stay; ties in time keep one position after the other by coordinates.
Histories are worked on in stretches of BUCKET_S, each with HALO_S to either side; stops that meet at a
boundary are joined afterwards, over stops and no longer over reports.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelorus.functions.geo import haversine_m
from pelorus.operators.grouped import in_time_buckets, over_groups
from pelorus.operators.spikes import nine_digit

BUCKET_S = 7 * 86_400.0
HALO_S = 2 * 3_600.0
GAP_S = 3_600.0
TOLERANCE_M = 100.0
SLOW_M_S = 0.5
SPOT_M = 250.0
STAY_S = 1_800.0
#: A fitted circle may be this much wider than asked, for noise and for the fit.
SLACK = 1.06
WRONG_M = 500.0
METRES_A_DEGREE = 111_195.08
TOP_M_S = 26.0

PARTS = (
    "kind string, user_id bigint, bucket bigint, t0 double, t1 double, lat0 double, lon0 double, "
    "lat1 double, lon1 double, distance_m double, reports bigint, opens boolean, closes boolean"
)


def wrong_positions(t: np.ndarray, x: np.ndarray, y: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Positions that leap away and back: one alone, or up to three faster than a ship sails."""
    n = len(t)
    out = np.zeros(n, bool)
    for length in (1, 2, 3):
        a = np.arange(0, n - length - 1)
        b = a + length + 1
        if not len(a):
            break
        whole = group[a] == group[b]
        base = np.hypot(x[b] - x[a], y[b] - y[a])
        there = np.hypot(x[a + 1] - x[a], y[a + 1] - y[a])
        back = np.hypot(x[b] - x[b - 1], y[b] - y[b - 1])
        leap = whole & (np.minimum(there, back) > WRONG_M + base)
        if length > 1:
            dt = np.maximum(np.minimum(t[a + 1] - t[a], t[b] - t[b - 1]), 1.0)
            leap &= np.maximum(there, back) / dt > TOP_M_S
        leap &= ~out[a] & ~out[b]
        for k in range(1, length + 1):
            out[a[leap] + k] = True
    return out


def simplify(t: np.ndarray, x: np.ndarray, y: np.ndarray, session: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points a time-synchronised Douglas-Peucker keeps; all sessions are split level by level."""
    n = len(t)
    keep = np.zeros(n, bool)
    if not n:
        return keep
    edge = np.ones(n, bool)
    edge[1:] = session[1:] != session[:-1]
    keep |= edge
    keep[:-1] |= edge[1:]
    keep[-1] = True
    first = np.flatnonzero(edge)
    last = np.r_[first[1:], n] - 1
    while len(first):
        inner = last - first > 1
        first, last = first[inner], last[inner]
        if not len(first):
            break
        size = last - first - 1
        start = np.r_[0, np.cumsum(size)[:-1]]
        seg = np.repeat(np.arange(len(first)), size)
        i = np.arange(size.sum()) - start[seg] + first[seg] + 1
        a, b = first[seg], last[seg]
        span = t[b] - t[a]
        share = np.where(span > 0, (t[i] - t[a]) / np.where(span > 0, span, 1.0), 0.0)
        off = np.hypot(x[i] - x[a] - share * (x[b] - x[a]), y[i] - y[a] - share * (y[b] - y[a]))
        most = np.maximum.reduceat(off, start)
        at = np.flatnonzero(off == most[seg])
        _, one = np.unique(seg[at], return_index=True)
        split = i[at[one]]
        far = most > tolerance
        keep[split[far]] = True
        first, last = np.r_[first[far], split[far]], np.r_[split[far], last[far]]
    return keep


def _circle(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Centre and radius of a circle around all points, at most a few per cent wider than the least one."""
    cx, cy = np.median(x), np.median(y)
    r = np.hypot(x - cx, y - cy).max()
    if r <= SPOT_M:
        return cx, cy, r
    cx, cy = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
    if max(np.ptp(x), np.ptp(y)) > 2.2 * SPOT_M:
        return cx, cy, np.hypot(x - cx, y - cy).max()
    for step in range(1, 40):
        d = np.hypot(x - cx, y - cy)
        far = int(np.argmax(d))
        if d[far] <= SPOT_M:
            break
        cx, cy = cx + (x[far] - cx) / (step + 1), cy + (y[far] - cy) / (step + 1)
    return cx, cy, np.hypot(x - cx, y - cy).max()


def _spots(x: np.ndarray, y: np.ndarray, a: int, b: int) -> list[tuple[int, int, float, float]]:
    """The slow stretch a..b cut into stretches that stay around one spot each: first, last, spot."""
    out = []
    while a <= b:
        cx, cy, r = _circle(x[a : b + 1], y[a : b + 1])
        high = b
        if r > SPOT_M * SLACK:
            low = a  # the longest beginning that fits a spot
            while low < high:
                mid = (low + high + 1) // 2
                if _circle(x[a : mid + 1], y[a : mid + 1])[2] <= SPOT_M * SLACK:
                    low = mid
                else:
                    high = mid - 1
            high = low
            cx, cy, r = _circle(x[a : high + 1], y[a : high + 1])
        out.append((a, high, cx, cy))
        a = high + 1
    return out


def _stops(t, x, y, slow, edge) -> list[list]:
    """Stops of one group: [start, end, x, y, reports, first index, last index]."""
    n = len(t)
    stretches = []
    i = 0
    marks = np.flatnonzero(slow | edge)
    for i in marks:
        lo, hi = (i, min(i + 1, n - 1)) if slow[i] else (i, i)
        if stretches and lo <= stretches[-1][1]:
            stretches[-1][1] = max(hi, stretches[-1][1])
        else:
            stretches.append([lo, hi])
    spots = [s for lo, hi in stretches for s in _spots(x, y, lo, hi)]
    out: list[list] = []
    for a, b, cx, cy in spots:
        if out:
            p = out[-1]
            between = slice(p[6] + 1, a)
            away = np.hypot(x[between] - p[2], y[between] - p[3]) > 2 * SPOT_M
            if np.hypot(cx - p[2], cy - p[3]) <= 2 * SPOT_M and not away.any():
                mx, my, r = _circle(x[p[5] : b + 1], y[p[5] : b + 1])
                if r <= SPOT_M * SLACK:
                    out[-1] = [p[0], t[b], mx, my, p[4] + (b - a + 1), p[5], b]
                    continue
        out.append([t[a], t[b], cx, cy, b - a + 1, a, b])
    for k, p in enumerate(out):
        low = out[k - 1][6] if k else -1
        high = out[k + 1][5] if k + 1 < len(out) else n
        while p[5] - 1 > low and np.hypot(x[p[5] - 1] - p[2], y[p[5] - 1] - p[3]) <= SPOT_M:
            p[5] -= 1
        while p[6] + 1 < high and np.hypot(x[p[6] + 1] - p[2], y[p[6] + 1] - p[3]) <= SPOT_M:
            p[6] += 1
        # a stretch may begin or end with reports on the way
        while p[5] < p[6] and np.hypot(x[p[5]] - p[2], y[p[5]] - p[3]) > SPOT_M:
            p[5] += 1
        while p[6] > p[5] and np.hypot(x[p[6]] - p[2], y[p[6]] - p[3]) > SPOT_M:
            p[6] -= 1
        p[0], p[1] = t[p[5]], t[p[6]]
    return out


def judge(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    """Stops, legs and ends of whole groups sorted by time."""
    n = len(frame)
    group = np.zeros(n, int)
    group[starts] = 1
    group = np.cumsum(group) - 1
    t, lat, lon = (frame[c].to_numpy(float) for c in ("t", "latitude", "longitude"))
    core, user, bucket = frame["core"].to_numpy(bool), frame["user_id"].to_numpy(), frame["bucket"].to_numpy()
    base_lat, base_lon = lat[starts][group], lon[starts][group]
    scale = np.cos(np.radians(base_lat)) * METRES_A_DEGREE
    x = ((lon - base_lon + 180.0) % 360.0 - 180.0) * scale
    y = (lat - base_lat) * METRES_A_DEGREE
    twice = np.zeros(n, bool)
    twice[1:] = (group[1:] == group[:-1]) & (t[1:] == t[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    use = np.flatnonzero(~twice)
    good = use[~wrong_positions(t[use], x[use], y[use], group[use])]
    t, x, y, group, core, user, bucket = (v[good] for v in (t, x, y, group, core, user, bucket))
    base_lat, base_lon, scale = base_lat[good], base_lon[good], scale[good]
    n = len(good)
    new = np.ones(n, bool)
    new[1:] = (group[1:] != group[:-1]) | (t[1:] - t[:-1] > GAP_S)
    session = np.cumsum(new)
    keep = simplify(t, x, y, session, TOLERANCE_M)

    # the leg that each report lies on: slow or not
    at = np.flatnonzero(keep)
    a, b = at[:-1], at[1:]
    inside = session[a] == session[b]
    length = np.hypot(x[b] - x[a], y[b] - y[a])
    slow_leg = inside & (length < SLOW_M_S * np.maximum(t[b] - t[a], 1e-6))
    slow = np.zeros(n, bool)
    for i, j in zip(a[slow_leg], b[slow_leg], strict=True):
        slow[i:j] = True
    edge = new.copy()
    edge[:-1] |= new[1:]
    if n:
        edge[-1] = True

    rows: list[tuple] = []
    bounds = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), n] if n else np.zeros(1, int)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        g = slice(lo, hi)
        u, k, lat0, lon0, sc = user[lo], bucket[lo], base_lat[lo], base_lon[lo], scale[lo]
        for p in _stops(t[g], x[g], y[g], slow[g], edge[g]):
            opens, closes = p[5] == 0, p[6] == hi - lo - 1
            if p[1] - p[0] >= STAY_S or opens or closes:
                la, lo_ = lat0 + p[3] / METRES_A_DEGREE, lon0 + p[2] / sc
                rows.append(("stop", u, k, p[0], p[1], la, lo_, la, lo_, 0.0, p[4], opens, closes))
        own = np.flatnonzero(core[g]) + lo
        if len(own):
            f, l_ = own[0], own[-1]
            rows.append(("ends", u, k, t[f], t[l_], lat0 + y[f] / METRES_A_DEGREE, lon0 + x[f] / sc, lat0 + y[l_] / METRES_A_DEGREE, lon0 + x[l_] / sc, 0.0, len(own), False, False))
    # legs between kept reports of the stretch itself, over silences too
    mine = at[core[at]] if n else at
    if n:
        ends = np.zeros(n, bool)
        ends[mine] = True
        c = np.flatnonzero(core)
        if len(c):
            cg = group[c]
            ends[c[np.r_[True, cg[1:] != cg[:-1]]]] = True
            ends[c[np.r_[cg[1:] != cg[:-1], True]]] = True
        mine = np.flatnonzero(ends)
    a, b = mine[:-1], mine[1:]
    ok = group[a] == group[b] if n else np.zeros(0, bool)
    a, b = a[ok], b[ok]
    lat_of = lambda i: base_lat[i] + y[i] / METRES_A_DEGREE
    lon_of = lambda i: base_lon[i] + x[i] / scale[i]
    legs = pd.DataFrame(
        {"kind": "leg", "user_id": user[a], "bucket": bucket[a], "t0": t[a], "t1": t[b], "lat0": lat_of(a), "lon0": lon_of(a), "lat1": lat_of(b), "lon1": lon_of(b), "distance_m": np.hypot(x[b] - x[a], y[b] - y[a]), "reports": b - a, "opens": False, "closes": False}
    )
    stops = pd.DataFrame(rows, columns=list(legs.columns))
    return pd.concat([stops, legs], ignore_index=True) if len(stops) else legs


def parts(reports: DataFrame) -> DataFrame:
    """Stops, legs and ends by vessel and stretch."""
    lat, lon = F.col("latitude"), F.col("longitude")
    placed = reports.where(
        nine_digit("user_id") & F.col("time_utc").isNotNull() & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~F.isnan(lat) & ~F.isnan(lon)
    ).select("user_id", "latitude", "longitude", (F.unix_micros("time_utc") / 1e6).alias("t"))
    spread = in_time_buckets(placed, "t", BUCKET_S, HALO_S)
    return over_groups(spread, ["user_id", "bucket"], ["t", "latitude", "longitude"], judge, PARTS)


def stays(found: DataFrame) -> DataFrame:
    """user_id, start_s, end_s, lat, lon of the stays of STAY_S or more, stops joined over boundaries."""
    stops = found.where("kind = 'stop'")
    w = Window.partitionBy("user_id").orderBy("t0", "t1", "bucket")
    before = [F.lag(c).over(w) for c in ("t1", "lat0", "lon0", "closes")]
    gap = haversine_m(before[1], before[2], F.col("lat0"), F.col("lon0"))
    joins = (gap <= SPOT_M * 1.2) & ((F.col("t0") <= before[0]) | (before[3] & F.col("opens")))
    tied = stops.withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    numbered = tied.withColumn("stay", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    most = F.max_by(F.struct("lat0", "lon0"), F.col("reports"))
    joined = numbered.groupBy("user_id", "stay").agg(
        F.min("t0").alias("start_s"), F.max("t1").alias("end_s"), most.alias("spot"), F.sum("reports").alias("reports")
    )
    kept = joined.where(F.col("end_s") - F.col("start_s") >= STAY_S)
    return kept.select("user_id", "start_s", "end_s", F.col("spot.lat0").alias("lat"), F.col("spot.lon0").alias("lon"))


def stays_and_voyages(found: DataFrame) -> DataFrame:
    """user_id, kind (stay, voyage), start_s, end_s, duration_s, distance_m, lat, lon.

    A voyage is what lies between two stays; its distance is that of the simplified legs in it, each
    counted by the share of its time. Legs meet voyages by vessel and stretch of time.
    """
    halts = stays(found)
    w = Window.partitionBy("user_id").orderBy("start_s", "end_s")
    voyages = (
        halts.withColumn("next", F.lead("start_s").over(w)).where(F.col("next") > F.col("end_s"))
        .select("user_id", F.col("end_s").alias("start_s"), F.col("next").alias("end_s"))
    )
    ends = found.where("kind = 'ends'")
    we = Window.partitionBy("user_id").orderBy("bucket")
    over = (
        ends.withColumn("p", F.lag(F.struct("t1", "lat1", "lon1")).over(we)).where("p is not null")
        .select("user_id", F.col("p.t1").alias("a"), F.col("t0").alias("b"), haversine_m(F.col("p.lat1"), F.col("p.lon1"), F.col("lat0"), F.col("lon0")).alias("m"))
    )
    legs = found.where("kind = 'leg'").select("user_id", F.col("t0").alias("a"), F.col("t1").alias("b"), F.col("distance_m").alias("m"))
    bucket = lambda c: F.floor(F.col(c) / BUCKET_S)
    legs = legs.unionByName(over).where("b > a").withColumn("bucket", F.explode(F.sequence(bucket("a"), bucket("b"))))
    spread = voyages.withColumn("bucket", F.explode(F.sequence(bucket("start_s"), bucket("end_s"))))
    # a leg that spans stretches meets a voyage in each: it counts in the stretch where their overlap begins
    begin, end = F.greatest("a", "start_s"), F.least("b", "end_s")
    met = legs.join(spread, ["user_id", "bucket"]).where((begin < end) & (F.floor(begin / BUCKET_S) == F.col("bucket")))
    share = (end - begin) / (F.col("b") - F.col("a"))
    sailed = met.groupBy("user_id", "start_s", "end_s").agg(F.sum(F.col("m") * share).alias("distance_m"))
    nowhere = F.lit(None).cast("double")
    travelled = voyages.join(sailed, ["user_id", "start_s", "end_s"], "left").select(
        "user_id", F.lit("voyage").alias("kind"), "start_s", "end_s", F.coalesce("distance_m", F.lit(0.0)).alias("distance_m"),
        nowhere.alias("lat"), nowhere.alias("lon"),
    )
    at_rest = halts.select("user_id", F.lit("stay").alias("kind"), "start_s", "end_s", F.lit(0.0).alias("distance_m"), "lat", "lon")
    return at_rest.unionByName(travelled).withColumn("duration_s", F.col("end_s") - F.col("start_s"))
