"""Readings a vessel cannot have had: out of bounds, leaping away and back, or stuck while under way.

Each field is judged against the vessel's own readings: a Hampel filter (rolling median and median absolute
deviation) proposes leaps, which are then held against where the positions say the vessel went; stuck values
are runs of equal readings under way, by the path sailed and not by how far apart its ends are; bounds are physical.

Defined cases: nulls are no readings; a reading out of bounds needs no time; reports without a time are
judged by bounds alone; a report delivered twice is judged once and flagged under every id; reports of
sources that aren't nine-digit numbers are left out. Histories are worked on in stretches of BUCKET_S with
HALO_S to either side, so a source's size is no task's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelorus.operators.grouped import in_time_buckets, masked_median, over_groups, runs, windows

BUCKET_S = 7 * 86_400.0
HALO_S = 6 * 3_600.0
KNOT = 1852.0 / 3600.0
METRES_A_DEGREE = 111_195.0
HALF = 4
STUCK = 10
LEAP = 3
UNDER_WAY = 0.8
#: Legs of a path are at least this long, so that the noise of positions at anchor adds up to none.
LEG_M = 50.0
#: A report this long before or after is no neighbour.
NEAR_S = 1800.0
FIELDS = ("sog", "cog", "latitude")
BOUNDS = {"sog": (0.0, 102.2), "cog": (0.0, 360.0), "latitude": (-90.0, 90.0)}


def nine_digit(user: str):
    return F.col(user).between(100_000_000, 999_999_999)


def out_of_bounds(reports: DataFrame) -> DataFrame:
    """report_id, field of readings outside the physical bounds; no shuffle."""
    sog, cog, lat = F.col("sog"), F.col("cog"), F.col("latitude")
    wrong = F.array_compact(
        F.array(
            F.when((sog < 0) | (sog >= 102.2) | F.isnan(sog), "sog"),
            F.when((cog < 0) | (cog >= 360) | F.isnan(cog), "cog"),
            F.when((F.abs(lat) > 90) | F.isnan(lat), "latitude"),
        )
    )
    return reports.where(nine_digit("user_id")).select("report_id", F.explode(wrong).alias("field"))


def _hampel(x: np.ndarray, group: np.ndarray, floor: float, k: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Which readings are farther from the rolling median than k scaled deviations and the floor; the median."""
    around, _ = windows(x, group, HALF)
    median = masked_median(around)
    spread = 1.4826 * masked_median(np.abs(around - median[:, None]))
    return np.abs(x - median) > np.maximum(k * spread, floor), median


def _turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs((a - b + 180.0) % 360.0 - 180.0)


def _fill(t: np.ndarray, x: np.ndarray, group: np.ndarray, good: np.ndarray) -> np.ndarray:
    """x where good, else between the nearest good readings of the group, by time; NaN in a group without."""
    n = len(x)
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(good, at, -1))
    after = np.minimum.accumulate(np.where(good, at, n)[::-1])[::-1]
    has_b = (before >= 0) & (group[np.maximum(before, 0)] == group)
    has_a = (after < n) & (group[np.minimum(after, n - 1)] == group)
    before, after = np.where(has_b, before, np.minimum(after, n - 1)), np.where(has_a, after, np.maximum(before, 0))
    span = t[after] - t[before]
    share = np.where(span > 0, (t - t[before]) / np.where(span > 0, span, 1), 0)
    out = x[before] + (x[after] - x[before]) * share
    return np.where(good, x, np.where(has_a | has_b, out, np.nan))


def _latitude_leaps(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Latitudes that leave the track by 0.05 degrees or more, for at most three readings, and return."""
    n = len(t)
    residuals = np.full((n, 7), np.nan)
    at = np.arange(n)
    for k in range(1, 8):
        a, b = at - k, at + k
        ok = (a >= 0) & (b < n)
        a, b = np.maximum(a, 0), np.minimum(b, n - 1)
        ok &= (group[a] == group) & (group[b] == group)
        span = t[b] - t[a]
        guess = lat[a] + (lat[b] - lat[a]) * np.where(span > 0, (t - t[a]) / np.where(span > 0, span, 1), 0.5)
        residuals[:, k - 1] = np.where(ok, lat - guess, np.nan)
    residual = masked_median(residuals)
    flagged, median = _hampel(lat, group, 0.02)
    edge = np.isnan(residual)
    candidate = np.where(edge, flagged & (np.abs(lat - median) >= 0.04), np.abs(residual) >= 0.03)
    clean = _fill(t, lat, group, ~candidate)
    leap = candidate & (np.abs(lat - clean) >= 0.045)
    # a second look with all leaps out: what lies on the line between good neighbours is good
    clean = _fill(t, lat, group, ~leap)
    leap &= np.abs(lat - clean) >= 0.045
    return leap & (runs(leap, group) <= LEAP)


def judge(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    """The flagged readings of whole groups sorted by time."""
    n = len(frame)
    group_all = np.zeros(n, int)
    group_all[starts] = 1
    group_all = np.cumsum(group_all)
    t_all = frame["t"].to_numpy(float)
    cols = {c: frame[c].to_numpy(float) for c in ("latitude", "longitude", "sog", "cog")}
    same = np.zeros(n, bool)
    same[1:] = (group_all[1:] == group_all[:-1]) & (t_all[1:] == t_all[:-1])
    for v in cols.values():
        same[1:] &= (v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1]))
    of = np.cumsum(~same) - 1  # the judged report behind each delivered one
    pick = np.flatnonzero(~same)
    t, group = t_all[pick], group_all[pick]
    lat, lon, sog, cog = (cols[c][pick] for c in ("latitude", "longitude", "sog", "cog"))
    flags = {f: np.zeros(len(pick), bool) for f in FIELDS}

    placed = (np.abs(lat) <= 90) & (np.abs(lon) <= 180.0)
    p = np.flatnonzero(placed)
    if len(p):
        flags["latitude"][p] = _latitude_leaps(t[p], lat[p], lon[p], group[p])
    good = placed & ~flags["latitude"]
    y, x = _fill(t, lat, group, good), _fill(t, lon, group, placed)
    scale = np.cos(np.radians(np.clip(np.nan_to_num(y), -89.9, 89.9)))

    def speed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Knots between two reports of a group by position; NaN without both."""
        dx = ((x[b] - x[a] + 180.0) % 360.0 - 180.0) * scale[a]
        dt = t[b] - t[a]
        v = np.hypot(y[b] - y[a], dx) * METRES_A_DEGREE / np.where(dt > 0, dt, np.nan) / KNOT
        return np.where(group[a] == group[b], v, np.nan)

    at = np.arange(len(t))
    before, after = np.maximum(at - 1, 0), np.minimum(at + 1, len(t) - 1)
    legs = np.stack([speed(before, at), speed(at, after), speed(before, after)], axis=1)
    legs[(t - t[before] > NEAR_S) | (t[after] - t > NEAR_S)] = np.nan
    with np.errstate(all="ignore"):
        slowest = np.where(np.isnan(legs).all(1), np.nan, np.nanmin(np.where(np.isnan(legs), np.inf, legs), axis=1))
        fastest = np.where(np.isnan(legs).all(1), np.nan, np.nanmax(np.where(np.isnan(legs), -np.inf, legs), axis=1))

    flags["sog"] |= _sog_leaps(sog, group, legs, slowest, fastest)
    flags["cog"] |= _cog_leaps(cog, sog, flags["sog"], group, x, y, scale, legs, slowest)
    for f, v in (("sog", sog), ("cog", cog), ("latitude", lat)):
        flags[f] |= _stuck(f, v, t, group, x, y, scale, np.where(_in_bounds("sog", sog) & ~flags["sog"], sog, np.nan))

    out = []
    core = frame["core"].to_numpy(bool)
    ids = frame["report_id"].to_numpy()
    for f in FIELDS:
        hit = flags[f][of] & core
        out.append(pd.DataFrame({"report_id": ids[hit], "field": f}))
    return pd.concat(out, ignore_index=True)


def _in_bounds(f: str, v: np.ndarray) -> np.ndarray:
    low, high = BOUNDS[f]
    return (v >= low) & ((v <= high) if f == "latitude" else (v < high))


def _sog_leaps(sog, group, legs, slowest, fastest) -> np.ndarray:
    out = np.zeros(len(sog), bool)
    r = np.flatnonzero(_in_bounds("sog", sog))
    if not len(r):
        return out
    v, g = sog[r], group[r]
    moved = legs[r, 2]
    away, median = _hampel(v, g, 3.0)
    # the vessel's usual top speed: readings that its positions bear out
    borne = (v > 0.5) & (np.nan_to_num(fastest[r]) >= 0.6 * v)
    top = np.zeros(g.max() + 1)
    order = np.lexsort((v[borne], g[borne]))
    gb, vb = g[borne][order], v[borne][order]
    if len(gb):
        first = np.flatnonzero(np.r_[True, gb[1:] != gb[:-1]])
        count = np.diff(np.r_[first, len(gb)])
        top[gb[first]] = vb[first + ((count - 1) * 0.98).astype(int)]
    high = away & (v > median) & (v > 1.1 * top[g] + 1.0) & ~(np.nan_to_num(fastest[r]) >= 0.8 * v)
    # standing still between reports under way, though the positions went on
    still = (v < 0.35 * median) & (median > 2.0)
    low = away & still & ((np.nan_to_num(slowest[r], nan=np.inf) > 0.6 * median) | np.isnan(moved))
    leap = high | low
    out[r] = leap & (runs(leap, g) <= LEAP)
    return out


def _cog_leaps(cog, sog, false_sog, group, x, y, scale, legs, slowest) -> np.ndarray:
    """Courses 60 degrees or more off a straight one, for at most three readings under way."""
    out = np.zeros(len(cog), bool)
    r = np.flatnonzero(_in_bounds("cog", cog))
    if not len(r):
        return out
    v, g = cog[r], group[r]
    around, _ = windows(v, g, HALF)
    moving, _ = windows(np.nan_to_num(legs[r, 2]), g, HALF)
    around = np.where(moving > 1.5, around, np.nan)
    around[:, HALF] = np.nan
    known = np.sum(~np.isnan(around), axis=1)
    # median of directions: unwrapped about their mean
    rad = np.radians(around)
    centre = np.degrees(np.arctan2(np.nansum(np.sin(rad), axis=1), np.nansum(np.cos(rad), axis=1)))
    turned = (around - centre[:, None] + 180.0) % 360.0 - 180.0
    median = masked_median(turned)
    spread = masked_median(np.abs(turned - median[:, None]))
    course = (centre + median) % 360.0
    off = _turn(v, course)
    # the leg by position, from the report before to the one after
    a, b = np.maximum(r - 1, 0), np.minimum(r + 1, len(cog) - 1)
    dx = ((x[b] - x[a] + 180.0) % 360.0 - 180.0) * scale[r]
    track = np.degrees(np.arctan2(dx, y[b] - y[a])) % 360.0
    stands = (sog[r] < 1.0) & ~false_sog[r]
    went = (np.nan_to_num(slowest[r]) > 1.5) & ~stands
    off_track = _turn(v, track)
    straight = (known >= 4) & (spread <= 12.0) & (_turn(course, track) <= 35.0)
    leap = straight & went & (off >= 50.0) & (off_track >= 40.0)
    out[r] = leap & (runs(leap, g) <= LEAP)
    return out


def _path_m(x: np.ndarray, y: np.ndarray, scale: float) -> float:
    """Metres sailed along a run of positions, in legs of LEG_M or more; single wrong positions are smoothed out."""
    x = (x - x[0] + 180.0) % 360.0 - 180.0
    one = np.zeros(len(x), int)
    east = masked_median(windows(x, one, 2)[0]) * scale * METRES_A_DEGREE
    north = masked_median(windows(y - y[0], one, 2)[0]) * METRES_A_DEGREE
    path, k = 0.0, 0
    for i in range(1, len(x)):
        leg = np.hypot(east[i] - east[k], north[i] - north[k])
        if leg >= LEG_M:
            path, k = path + leg, i
    return path


def _stuck(field: str, value, t, group, x, y, scale, sog) -> np.ndarray:
    """Ten or more equal readings in a row while the vessel is under way.

    That is so by the positions, from end to end or along the path. A stuck latitude hides the way north and south,
    so there the speeds reported count too (sog, NaN where unusable), or if there are few or all are one, the way
    from the report before the run to the one after.
    """
    out = np.zeros(len(value), bool)
    r = np.flatnonzero(_in_bounds(field, value))
    if len(r) < STUCK:
        return out
    v, g = value[r], group[r]
    new = np.ones(len(r), bool)
    new[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.r_[first, len(r)])
    long = length >= STUCK
    stuck = np.zeros(len(first), bool)
    for k in np.flatnonzero(long):
        run = r[first[k] : first[k] + length[k]]
        a, b = run[0], run[-1]

        def knots(a: int, b: int, north: bool = True) -> float:
            dx = ((x[b] - x[a] + 180.0) % 360.0 - 180.0) * scale[a]
            return np.hypot(dx, y[b] - y[a] if north else 0.0) * METRES_A_DEGREE / max(t[b] - t[a], 1.0) / KNOT

        ahead = field != "latitude"
        under_way = knots(a, b, ahead) > UNDER_WAY
        under_way |= _path_m(x[run], y[run] if ahead else np.zeros(len(run)), scale[a]) / max(t[b] - t[a], 1.0) / KNOT > UNDER_WAY
        if not ahead and not under_way:
            told = sog[run][~np.isnan(sog[run])]
            if 2 * len(told) >= len(run) and told.min() < told.max():
                under_way = np.median(told) > UNDER_WAY
            else:
                before, after = first[k] - 1, first[k] + length[k]
                if before >= 0 and g[before] == g[first[k]] and t[a] - t[r[before]] <= NEAR_S:
                    a = r[before]
                if after < len(r) and g[after] == g[first[k]] and t[r[after]] - t[b] <= NEAR_S:
                    b = r[after]
                under_way = knots(a, b) > UNDER_WAY
        stuck[k] = under_way
    out[r] = np.repeat(stuck, length)
    return out


def implausible(reports: DataFrame) -> DataFrame:
    """report_id, field of every reading that its vessel cannot have had."""
    timed = reports.where(nine_digit("user_id") & F.col("time_utc").isNotNull()).select(
        "report_id", "user_id", "latitude", "longitude", "sog", "cog", (F.unix_micros("time_utc") / 1e6).alias("t")
    )
    spread = in_time_buckets(timed, "t", BUCKET_S, HALO_S)
    judged = over_groups(
        spread, ["user_id", "bucket"], ["t", "latitude", "longitude", "sog", "cog"], judge, "report_id bigint, field string"
    )
    return out_of_bounds(reports).unionByName(judged)
