"""Vessels at scenes held against targets, place by place: pairs within gates and who belongs to whom.

A vessel's way between two reports travels as one row, to the cells of the grid that it may reach, and so do an hour's scenes; targets lie in one
cell. So all vessels that may reach a target meet it in one group, and most choices are settled there: only what may depend on
another cell is moved once more, by scene. No side is broadcast, and pairs are not moved but for those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelorus.functions.geo import EARTH_RADIUS_M
from pelorus.functions.geodesy import A_M, ECC2, forward
from pelorus.operators import alignment, proximity
from pelorus.operators.alignment import ABSTAIN, AGE_S, BASE_M, DRIFT_M_S, GATE_D2, GATE_M, KNOT, PLAUSIBLE_KNOTS, PROPAGATE_S, STILL_S
from pelorus.operators.grouped import over_groups

#: Degrees of a cell, so that no band of them holds nearly a whole number of columns, which two libraries may round apart; and over how many groups the
#: hours of a cell are spread, to each of which its targets go.
STEP, SPREAD = 0.57, 32
#: Instants of vessels that are worked on at a time (an hour's at least), and pairs of them with targets (a scene's at least).
TRACKS, PAIRS = 50_000, 500_000
#: A vessel may be this far from a target besides its own uncertainty.
NEAR_M = 500.0
#: Height of the rows in which a cell's targets are looked up, in degrees.
_ROW = 0.01
#: Metres of a radius are so many more at most where the ellipsoid is measured on the sphere.
_SLACK = 1.01 / EARTH_RADIUS_M

_RUN = "cell bigint, kind int, bucket bigint, user_id bigint, lat double, lon double, t0 bigint, lo bigint, hi bigint, begin bigint, end bigint, speed double, course double, moves boolean, ids binary, instants binary, again binary"
_STATES = ("same", "different", "first_only", "second_only")


def _spread(speed: np.ndarray, course: np.ndarray, age: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variances along and across the course as alignment.covariance() has them, and the course in radians."""
    known = ~np.isnan(speed) & ~np.isnan(course)
    s, anywhere = np.where(known, speed, 0.0) * age, (age * (PLAUSIBLE_KNOTS * KNOT)) ** 2 + BASE_M**2
    return np.where(known, (s * 0.15) ** 2 + BASE_M**2, anywhere), np.where(known, (s * 0.05) ** 2 + BASE_M**2, anywhere), np.radians(np.where(known, course, 0.0))


def _radius(along: np.ndarray, across: np.ndarray, age: np.ndarray, near: bool) -> np.ndarray:
    """Metres within which a vessel may have targets inside the gates."""
    reach = np.minimum(GATE_M, np.sqrt(GATE_D2 * np.maximum(along, across)))
    return np.maximum(reach, NEAR_M + BASE_M + DRIFT_M_S * age) if near else reach


def _cells_about(lat: np.ndarray, lon: np.ndarray, far_m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which place reaches which cell of proximity.cell() within far_m, as proximity.reach() has it; lon in [0, 360)."""
    dlat, dlon = _box(lat, far_m * _SLACK)
    low, high = (np.floor((np.clip(lat + d, -90.0, 90.0) + 90.0) / STEP).astype(int) for d in (-dlat - 1e-9, dlat + 1e-9))
    place, row = _ranges(low, high)
    edge = np.minimum(90.0, np.maximum(np.abs(row * STEP - 90.0), np.abs((row + 1) * STEP - 90.0)))
    columns = np.maximum(1, np.floor(360.0 * np.cos(np.radians(edge)) / STEP)).astype(int)
    first, last = (np.floor((lon[place] + d[place]) / 360.0 * columns).astype(int) for d in (-dlon - 1e-9, dlon + 1e-9))
    which, col = _ranges(first, np.minimum(last, first + columns - 1))
    return place[which], (row[which] << 31) + col % columns[which]


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number from first to last, and whose it is."""
    n = np.maximum(0, last - first + 1)
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(first - np.r_[0, np.cumsum(n)[:-1]].astype(int), n)


def _box(lat: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Degrees of latitude and longitude within which all lies that is within an angle of places."""
    dlat = np.degrees(angle)
    width = np.sin(angle) / np.maximum(np.cos(np.radians(lat)), 1e-15)
    polar = (np.abs(lat) + dlat >= 90.0) | (width >= 1.0)
    return dlat, np.where(polar, 180.0, np.degrees(np.arcsin(np.minimum(width, 1.0))))


def _runs(scenes: DataFrame, reports: DataFrame, near: bool) -> DataFrame:
    """The positions of alignment.aligned(), those of a vessel from the same reports in one row (kind 2): where it is at t0, how it moves.

    Once for each cell in which it may have targets. Its scenes are all from begin to end; a report's age at one is the larger of those
    of lo and hi. And by cell the scenes of the hour (kind 1), in order of time, once or more.
    """
    half = int(AGE_S * 1e6)

    def work(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pa.Table]:
        for told, asked in alignment._parts(frame, starts):
            at, name, again = asked["t"].to_numpy(), asked["id"].to_numpy(), asked["again"].to_numpy(bool)
            met = set()
            for j, user, _, left, right, has_left, has_right, column, way in alignment.around(told, asked, half):
                t, when = column["t_us"], at[j]
                before, after = (t[left] - when) / 1e6, (t[right] - when) / 1e6
                first = has_left & (~has_right | (np.abs(before) <= np.abs(after)))
                close = np.where(first, left, right)
                exact = t[close] == when
                both = has_left & has_right & ~exact
                with np.errstate(all="ignore"):
                    chord = way[0][left] / (after - before)
                lo, hi = np.where(both, t[left], t[close]), np.where(both, t[right], t[close])
                age = np.maximum(when - lo, hi - when) / 1e6
                speed, course = column["speed_knots"][close], column["course_deg"][close]
                known = (speed <= PLAUSIBLE_KNOTS) & ~np.isnan(course)
                inter = both & (chord <= PLAUSIBLE_KNOTS * KNOT)
                moved = ~exact & ~both & (age <= PROPAGATE_S) & known
                kept = np.flatnonzero(exact | inter | moved | (~both & (age <= STILL_S)))
                if not len(kept):
                    continue
                speed = np.where(inter, chord, np.where(known, speed * KNOT, np.nan))
                course = np.where(inter, way[1][left], np.where(known, course, np.nan))
                start, moves = np.where(inter, left, close), inter | moved
                along, across, _ = _spread(speed, course, age)
                far = np.abs(when - t[start]) / 1e6 * np.where(moves, speed, 0.0) + _radius(along, across, age, near)
                new = np.ones(len(kept), bool)
                new[1:] = j[kept][1:] != j[kept][:-1] + 1
                for x in (user, start, lo, hi, inter.astype(int) + 2 * moved):
                    new[1:] |= x[kept][1:] != x[kept][:-1]
                head = np.flatnonzero(new)
                k, last = kept[head], kept[np.r_[head[1:], len(kept)] - 1]
                lat, lon = column["lat"][start], column["lon"][start] % 360.0 % 360.0
                of, cell = _cells_about(lat[k], lon[k], np.maximum.reduceat(far[kept], head))
                met |= set(np.unique(cell).tolist())
                k, last = k[of], last[of]
                out = {"cell": cell, "user_id": user[k], "lat": lat[k], "lon": lon[k], "t0": t[start[k]], "lo": lo[k], "hi": hi[k], "begin": when[k], "end": when[last], "speed": speed[k], "course": course[k], "moves": moves[k]}
                yield filled(2, asked, out)
            packed = {"ids": name.tobytes(), "instants": at.tobytes(), "again": again.tobytes()}
            if met:
                yield filled(1, asked, {"cell": np.array(sorted(met))} | {k: [x] * len(met) for k, x in packed.items()})

    def filled(kind: int, asked: pd.DataFrame, out: dict) -> pa.Table:
        n = len(out["cell"])
        out |= {"kind": np.full(n, kind), "bucket": np.full(n, asked["bucket"].iloc[0])}
        none = {"binary": b"", "boolean": False}
        return pa.table(out | {k: pa.array([none.get(x, 0)] * n) for k, x in (c.split() for c in _RUN.split(", ")) if k not in out})

    named = scenes.select("scene_id", "at_us").distinct().withColumn("again", F.count("*").over(Window.partitionBy("scene_id")) > 1)
    met = alignment._met(named, reports, AGE_S, *alignment.FIELDS)
    return over_groups(met, ["bucket", "_salt"], ["kind", "user_id", "t", "id"], work, _RUN)


def _placed(scenes: DataFrame, reports: DataFrame, targets: DataFrame, near: bool) -> DataFrame:
    """_runs() (kind 1, 2) and by their cells targets (target_id, lat, lon; kind 0), as rows of one table by cell and _salt."""
    step = F.lit(STEP)
    runs = _runs(scenes, reports, near)
    runs = runs.withColumns({"_salt": F.pmod(F.col("bucket"), F.lit(SPREAD)).cast("int"), "columns": F.lit(0).cast("bigint"), "twice": F.lit(False)})
    named = F.coalesce(F.col("target_id"), F.lit(alignment._NAMELESS)).cast("bigint")
    sites = proximity.points(targets, named, F.col("lat"), F.col("lon"), "l").withColumn("twice", F.count("*").over(Window.partitionBy("l_id")) > 1)
    sites = sites.select(
        F.lit(0).alias("kind"), proximity.cell(F.col("l_lat"), F.col("l_lon"), step).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_salt"), F.col("l_id").alias("user_id"),
        F.col("l_lat").alias("lat"), F.col("l_lon").alias("lon"), proximity._columns_in(F.floor((F.col("l_lat") + 90.0) / step).cast("long"), step).alias("columns"), "twice",
    )
    rest = {f.name: F.lit(False if f.name == "moves" else b"" if f.dataType.typeName() == "binary" else 0).cast(f.dataType) for f in runs.schema.fields if f.name not in sites.columns}
    return runs.unionByName(sites.withColumns(rest))


def _wrapped(degrees: np.ndarray) -> np.ndarray:
    return (degrees + 180.0) % 360.0 - 180.0


def _instants(runs: pd.DataFrame, asked: dict[str, np.ndarray], first: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
    """The instants of runs at the scenes asked from first to last, in order of these: scene (its place in asked), id, user, again, age, lat, lon, speed, course."""
    of, scene = _ranges(first, last)
    order = np.argsort(scene, kind="stable")
    of, scene = of[order], scene[order]
    v = {k: runs[k].to_numpy()[of] for k in ("user_id", "lat", "lon", "t0", "lo", "hi", "speed", "course", "moves")}
    when = asked["instants"][scene]
    to = forward(v["lat"], v["lon"], np.where(v["moves"], v["course"], 0.0), np.where(v["moves"], v["speed"] * ((when - v["t0"]) / 1e6), 0.0))
    lat, lon = np.where(v["moves"], to[0], v["lat"]), np.where(v["moves"], to[1] % 360.0, v["lon"])
    age = np.maximum(when - v["lo"], v["hi"] - when) / 1e6
    return {"scene": scene, "id": asked["ids"][scene], "again": asked["again"][scene], "user": v["user_id"], "age": age, "lat": lat, "lon": lon, "speed": v["speed"], "course": v["course"]}


def _pairs_in(cell: int, sites: pd.DataFrame, asked: dict[str, np.ndarray], runs: pd.DataFrame, near: bool) -> Iterator[dict[str, np.ndarray]]:
    """The pairs of a cell, of some scenes at a time: scene (a number), track (one), target (a place in sites), id, user, east, north, near_m, d2, distance_m, cost, held, shared.

    shared: the scene may have other instants, or the target's id other places; held: so, or the vessel may have targets in another cell.
    A near_m or cost outside its gates is none.
    """
    s_lat, s_lon, columns = sites["lat"].to_numpy(), sites["lon"].to_numpy(), int(sites["columns"].iloc[0])
    twice = sites["twice"].to_numpy(bool)
    s_rad = np.radians(s_lat)
    scale = math.radians(1.0) * A_M / np.sqrt(1 - ECC2 * np.sin(s_rad) ** 2) * np.cos(s_rad)
    row, col = cell >> 31, cell & ((1 << 31) - 1)
    south, north, middle, half = row * STEP - 90.0, (row + 1) * STEP - 90.0, (col + 0.5) * 360.0 / columns, 180.0 / columns
    x = _wrapped(s_lon - middle)
    line = np.floor((s_lat - south) / _ROW)
    key = np.concatenate([line * 2048 + x + turn for turn in (-360.0, 0.0, 360.0)])
    site = np.argsort(key, kind="stable")
    key, site = key[site], site % len(sites)
    lines = int(line.max()) + 1
    hours = np.flatnonzero(np.r_[True, np.diff(runs["bucket"].to_numpy()) != 0])
    first, last = np.searchsorted(asked["instants"], runs["begin"].to_numpy(), "left"), np.searchsorted(asked["instants"], runs["end"].to_numpy(), "right") - 1
    upto = np.r_[0, np.cumsum(last - first + 1)]
    part = np.r_[hours[np.r_[True, np.diff(upto[hours] // TRACKS) != 0]], len(runs)]
    for begin, end in zip(part[:-1], part[1:], strict=True):
        v = _instants(runs.iloc[begin:end], asked, first[begin:end], last[begin:end])
        along, across, rad = _spread(v["speed"], v["course"], v["age"])
        angle = _radius(along, across, v["age"], near) * _SLACK
        (dlat, dlon), c_lat = _box(v["lat"], angle), np.cos(np.radians(v["lat"]))
        y = _wrapped(v["lon"] - middle)
        over = (v["lat"] - dlat <= south + 1e-9) | (v["lat"] + dlat >= north - 1e-9) | (np.abs(y) + dlon >= half - 1e-9)
        low, high = np.maximum(0, np.floor((v["lat"] - dlat - south) / _ROW)).astype(int), np.minimum(lines - 1, np.floor((v["lat"] + dlat - south) / _ROW)).astype(int)
        found = []
        for k in range(max(0, int((high - low).max(initial=-1)) + 1)):
            on = np.flatnonzero(low + k <= high)
            base = (low[on] + k) * 2048.0 + y[on]
            a, b = np.searchsorted(key, base - dlon[on]), np.searchsorted(key, base + dlon[on])
            hit = b > a
            found.append((on[hit], a[hit], b[hit]))
        if not found:
            continue
        on, a, b = (np.concatenate(z) for z in zip(*found, strict=True))
        order = np.argsort(on, kind="stable")  # tracks are in order of scenes
        on, a, b = on[order], a[order], b[order]
        if not len(on):
            continue
        scene = v["scene"]
        fresh = np.flatnonzero(np.r_[True, np.diff(scene[on]) != 0])
        upto_pairs = np.r_[0, np.cumsum(b - a)]
        cut = np.r_[fresh[np.r_[True, np.diff(upto_pairs[fresh] // PAIRS) != 0]], len(on)]
        ee = along * np.sin(rad) ** 2 + across * np.cos(rad) ** 2
        en = (along - across) * np.sin(rad) * np.cos(rad)
        nn = along * np.cos(rad) ** 2 + across * np.sin(rad) ** 2
        det = ee * nn - en * en
        log = np.log(det / 1e8)
        for p, q in zip(cut[:-1], cut[1:], strict=True):
            n = b[p:q] - a[p:q]
            e = np.repeat(on[p:q], n)
            t = site[np.arange(n.sum()) + np.repeat(a[p:q] - np.r_[0, np.cumsum(n)[:-1]], n)]
            up = s_lat[t] - v["lat"][e]
            inside = np.abs(up) <= dlat[e]
            e, t, up = e[inside], t[inside], up[inside]
            aside = s_lon[t] - v["lon"][e]
            h = np.sin(np.radians(up) / 2) ** 2 + c_lat[e] * np.cos(s_rad[t]) * np.sin(np.radians(aside) / 2) ** 2
            near_m = 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))
            w2 = 1 - ECC2 * np.sin(np.radians((v["lat"][e] + s_lat[t]) / 2)) ** 2
            to_north, to_east = np.radians(up) * A_M * (1 - ECC2) / (w2 * np.sqrt(w2)), _wrapped(aside) * scale[t]
            d2 = (to_east**2 * nn[e] - 2 * to_east * to_north * en[e] + to_north**2 * ee[e]) / det[e]
            away, cost = np.hypot(to_east, to_north), 0.5 * (d2 + log[e])
            cost = np.where((d2 <= GATE_D2) & (away <= GATE_M) & (near_m <= GATE_M * 1.01) & (cost < ABSTAIN), cost, np.nan)
            gate = NEAR_M + BASE_M + DRIFT_M_S * v["age"][e]
            out = {"scene": scene[e], "target": t, "track": e, "id": v["id"][e], "user": v["user"][e], "shared": v["again"][e] | twice[t], "held": over[e] | v["again"][e] | twice[t], "east": to_east, "north": to_north}
            out |= {"near_m": np.where(near_m <= gate, near_m, np.nan), "d2": d2, "distance_m": away, "cost": cost}
            yield out


def settle(left: np.ndarray, right: np.ndarray, cost: np.ndarray, tie: np.ndarray, held: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges left to right, numbered from 0: which a best choice takes for sure, and which remain to choose among.

    Who likes best what nobody else may have, takes it and leaves, which may leave others so in turn; that loses neither pairs nor cost. Of
    what only one may have, but the cheapest remains to it. Of equal costs the first by tie. held: edges of who may have others
    besides, and so stays; shared: of them those to what others may have besides.
    """
    chosen, rest = np.zeros(len(left), bool), np.zeros(len(left), bool)
    edge = np.lexsort((tie, cost, right))
    stays = np.zeros(int(right.max(initial=-1)) + 1, bool)
    stays[right[held]] = True
    while len(edge):
        a, b = left[edge], right[edge]
        alone = np.bincount(a)[a] == 1
        take = np.r_[True, b[1:] != b[:-1]] & alone & ~stays[b]
        if not take.any():
            own = np.flatnonzero(alone & ~shared[edge])
            rest[edge] = True
            rest[edge[own[1:][b[own[1:]] == b[own[:-1]]]]] = False
            break
        chosen[edge[take]] = True
        gone = np.zeros(len(stays), bool)
        gone[b[take]] = True
        edge = edge[~gone[b]]
    return chosen, rest


def _joined(left: np.ndarray, right: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which edges hang together with held ones."""
    a, b = np.unique(left, return_inverse=True)[1], np.unique(right, return_inverse=True)[1]
    while True:
        of_left = np.bincount(a, held) > 0
        more = of_left[a]
        of_right = np.bincount(b, more) > 0
        more = of_right[b]
        if more.sum() == held.sum():
            return more
        held = more


def choose(block: np.ndarray, left: np.ndarray, right: np.ndarray, cost: np.ndarray, alone: float | None) -> np.ndarray:
    """Which edges alignment.best_pairs() takes in each block; edges in order of block."""
    chosen = np.zeros(len(block), bool)
    ends = np.flatnonzero(np.r_[block[1:] != block[:-1], True][: len(block)]) + 1
    for lo, hi in zip(np.r_[0, ends], ends, strict=False):
        chosen[lo + alignment.best_pairs(left[lo:hi], right[lo:hi], cost[lo:hi], alone)] = True
    return chosen


def _numbered(block: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A number from 0 for each different pair of block (a number from 0) and of."""
    n, values = pd.factorize(of)
    return pd.factorize(block.astype(np.int64) * len(values) + n)[0]


def _settled(pairs: dict[str, np.ndarray], left: np.ndarray, cost: np.ndarray, alone: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of _pairs_in() with a cost: those chosen, and those that only all cells of a scene together can tell."""
    on = np.flatnonzero(~np.isnan(cost))
    a, b, c, held, shared = left[on], pairs["track"][on], cost[on], pairs["held"][on], pairs["shared"][on]
    took, rest = settle(a, b, c, pairs["tie"][on], held, shared)
    rest = np.flatnonzero(rest)
    wide = _joined(a[rest], b[rest], held[rest])
    inner = rest[~wide]
    inner = inner[np.lexsort((b[inner], pairs["tie"][on][inner], pairs["scene"][on][inner]))]
    took[inner] = choose(pairs["scene"][on][inner], a[inner], b[inner], c[inner], alone)
    return on[took], on[rest[wide]]


def _cells(frame: pd.DataFrame, starts: np.ndarray, near: bool) -> Iterator[Iterator[dict[str, np.ndarray]]]:
    """_pairs_in() of each group of _placed() with targets and runs, the targets by their ids."""
    for lo, hi in zip(starts, np.r_[starts[1:], len(frame)], strict=True):
        mid, run = lo + np.searchsorted(frame["kind"].to_numpy()[lo:hi], [1, 2])
        if lo < mid < run < hi:
            sites, hours = frame.iloc[lo:mid], frame.iloc[mid:run].drop_duplicates("bucket")
            name = sites["user_id"].to_numpy()
            asked = {k: np.frombuffer(b"".join(hours[k]), kind) for k, kind in (("ids", np.int64), ("instants", np.int64), ("again", bool))}
            yield ({**p, "target": name[p["target"]], "tie": name[p["target"]]} for p in _pairs_in(int(frame["cell"].iloc[lo]), sites, asked, frame.iloc[run:hi], near))


def _among(frame: pd.DataFrame, block: np.ndarray, alone: float | None) -> np.ndarray:
    """Which rows (target_id, user_id, cost) best_pairs() takes in each block; rows in order of block, target_id, user_id, cost."""
    left, right = _numbered(block, frame["target_id"].to_numpy()), _numbered(block, frame["user_id"].to_numpy())
    on = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])][: len(frame)])  # of several the cheapest
    cost, none = frame["cost"].to_numpy()[on], np.zeros(len(on), bool)
    took, rest = settle(left[on], right[on], cost, frame["target_id"].to_numpy()[on], none, none)
    took[rest] = choose(block[on][rest], left[on][rest], right[on][rest], cost[rest], alone)
    chosen = np.zeros(len(frame), bool)
    chosen[on[took]] = True
    return chosen


def _block(frame: pd.DataFrame, starts: np.ndarray) -> np.ndarray:
    block = np.zeros(len(frame), np.int64)
    block[starts[1:]] = 1
    return np.cumsum(block)


def uncertain_pairs(scenes: DataFrame, reports: DataFrame, targets: DataFrame) -> DataFrame:
    """alignment.uncertain_pairs() of the vessels of alignment.aligned() and targets (target_id, lat, lon).

    Pairs go from where they are made into the result; those that a cell can't settle are made a second time, and moved.
    """
    kinds = "scene_id bigint, target_id bigint, user_id bigint, east_m double, north_m double, d2 double, distance_m double, cost double, selected boolean"

    def pairs(settled: bool):
        def work(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pa.Table]:
            for cell in _cells(frame, starts, near=False):
                for p in cell:
                    took, wide = _settled(p, _numbered(p["scene"], p["target"]), p["cost"], ABSTAIN)
                    selected, out = np.zeros(len(p["id"]), bool), np.isnan(p["cost"])
                    selected[took] = True
                    out[wide] = True
                    kept = np.flatnonzero(~out) if settled else wide
                    names = {"scene_id": "id", "target_id": "target", "user_id": "user", "east_m": "east", "north_m": "north", "d2": "d2", "distance_m": "distance_m", "cost": "cost"}
                    yield pa.table({name: p[k][kept] for name, k in names.items()} | {"selected": selected[kept]})

        return over_groups(placed, ["cell", "_salt"], ["kind", "bucket"], work, kinds)

    def solve(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        return frame.assign(selected=_among(frame, _block(frame, starts), ABSTAIN))

    placed = _placed(scenes, reports, targets, near=False)
    across = over_groups(pairs(False), ["scene_id"], ["target_id", "user_id", "cost"], solve, kinds)
    return pairs(True).unionByName(across).withColumns({k: F.nullif(k, F.lit(alignment._NAMELESS)) for k in ("scene_id", "target_id")})


def compared(scenes: DataFrame, reports: DataFrame, targets: DataFrame) -> DataFrame:
    """state, targets: how the vessels agree that the matcher by distance and the one by uncertainty choose for a target at a scene.

    As alignment.compared_choices() of both, counted where both choices are settled; pairs leave a cell only for those that it can't settle.
    """
    kinds = "scene_id bigint, matcher int, target_id bigint, user_id bigint, cost double, n bigint"

    def counted(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """How many of each of _STATES; -1 is nobody."""
        one, two = first >= 0, second >= 0
        return np.array([(one & (first == second)).sum(), (one & two & (first != second)).sum(), (one & ~two).sum(), (two & ~one).sum()])

    def work(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pa.Table]:
        for cell in _cells(frame, starts, near=True):
            total = np.zeros(4, np.int64)
            for p in cell:
                left = _numbered(p["scene"], p["target"])
                open_, who, parts = np.zeros(left.max(initial=-1) + 1, bool), [], []
                for cost, alone in ((p["near_m"], None), (p["cost"], ABSTAIN)):
                    took, wide = _settled(p, left, cost, alone)
                    open_[left[wide]] = True
                    who.append(np.full(len(open_), -1))
                    who[-1][left[took]] = p["user"][took]
                    parts.append((took, wide, cost))
                total += counted(who[0][~open_], who[1][~open_])
                for matcher, (took, wide, cost) in enumerate(parts, 1):
                    took = took[open_[left[took]]]
                    kept = np.r_[took, wide]
                    yield pa.table({
                        "scene_id": p["id"][kept], "matcher": np.full(len(kept), matcher), "target_id": p["target"][kept], "user_id": p["user"][kept],
                        "cost": np.r_[np.full(len(took), -np.inf), cost[wide]], "n": np.zeros(len(kept), int),
                    })
            yield pa.table({"scene_id": total * 0 + int(frame["cell"].iloc[0]), "matcher": total * 0, "target_id": np.arange(4), "user_id": total * 0, "cost": total * 0.0, "n": total})

    def solve(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        block, matcher, cost = _block(frame, starts), frame["matcher"].to_numpy(), frame["cost"].to_numpy()
        left, user = _numbered(block, frame["target_id"].to_numpy()), frame["user_id"].to_numpy()
        who = []
        for k, alone in ((1, None), (2, ABSTAIN)):
            who.append(np.full(left.max(initial=-1) + 1, -1))
            took = np.flatnonzero((matcher == k) & np.isinf(cost))  # settled before
            free = np.flatnonzero((matcher == k) & ~np.isinf(cost))
            took = np.r_[took, free[_among(frame.iloc[free], block[free], alone)]]
            who[-1][left[took]] = user[took]
        before = np.bincount(frame["target_id"].to_numpy()[matcher == 0], frame["n"].to_numpy()[matcher == 0], minlength=4).astype(np.int64)
        return pd.DataFrame({"state": _STATES, "n": before + counted(*who)})

    cells = over_groups(_placed(scenes, reports, targets, near=True), ["cell", "_salt"], ["kind", "bucket"], work, kinds)
    states = over_groups(cells, ["scene_id"], ["matcher", "target_id", "user_id", "cost"], solve, "state string, n bigint")
    return states.groupBy("state").agg(F.sum("n").alias("targets")).where("targets > 0")
