"""Where each vessel was at an instant, from its reports around it; and who belongs to which target."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from pelorus.functions.geodesy import destination, geodesic, inverse
from pelorus.operators.grouped import in_time_buckets, over_groups

AGE_S, PROPAGATE_S, STILL_S = 300.0, 120.0, 60.0
PLAUSIBLE_KNOTS = 60.0
KNOT = 1852.0 / 3600.0
BASE_M, DRIFT_M_S = 100.0, 2.0


#: Scenes are held against reports by hours, the vessels of an hour spread over so many keys.
HOUR_S, SPREAD = 3600.0, 4
#: Stands for a scene without a name, as numbers beside a null would lose digits on the way to Python.
_NAMELESS = -(2**63)
#: What is told of a report.
FIELDS = ("lat", "lon", "speed_knots", "course_deg")
#: Cells of a table of vessels by scenes that are worked on at a time.
CELLS = 250_000
#: Pairs of a vessel and a scene that leave a task, about: a writer keeps up to 128 MB of a file in memory, so many tasks' small files instead of few large ones.
PAIRS = 500_000


def _met(scenes: DataFrame, reports: DataFrame, half_s: float, *fields: str) -> DataFrame:
    """Scenes (scene_id, at_us and what else they have) and the reports within half_s of any that may be, as rows of one table by bucket and _salt.

    kind 0: a report (user_id, t, id: its report_id, fields); kind 1: a scene (t: its instant, id). A report close to an hour's
    edge is in both, a scene once for each salt. Nothing is joined: pairs are made where they are met, and no side is broadcast.
    """
    told = reports.select(F.lit(0).alias("kind"), "user_id", F.unix_micros("time_utc").alias("t"), F.coalesce("report_id", F.lit(2**63 - 1)).cast("bigint").alias("id"), *fields)
    told = in_time_buckets(told.withColumn("_s", F.col("t") / 1e6), "_s", HOUR_S, half_s + 1.0).drop("_s", "core")
    told = told.withColumn("_salt", F.pmod(F.xxhash64("user_id"), F.lit(SPREAD)).cast("int"))
    more = [c for c in scenes.columns if c not in ("scene_id", "at_us")]
    told = told.withColumns({c: F.lit(False) for c in more})
    asked = scenes.where("at_us is not null").select(
        F.lit(1).alias("kind"), F.lit(0).cast(told.schema["user_id"].dataType).alias("user_id"), F.col("at_us").alias("t"), F.coalesce("scene_id", F.lit(_NAMELESS)).cast("bigint").alias("id"),
        *[F.lit(None).cast(told.schema[c].dataType).alias(c) for c in fields], F.floor(F.col("at_us") / 1e6 / HOUR_S).alias("bucket"), *more, F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_salt"),
    )
    return told.unionByName(asked)


def _parts(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """The reports and the scenes of each group of _met() that has both; of either kind in the order they come."""
    kind = frame["kind"].to_numpy()
    for lo, hi in zip(starts, np.r_[starts[1:], len(frame)], strict=True):
        mid = lo + int(np.searchsorted(kind[lo:hi], 1))
        if lo < mid < hi:
            yield frame.iloc[lo:mid], frame.iloc[mid:hi]


def _tasks(met: DataFrame) -> int:
    """How many tasks share the groups of _met() so that about PAIRS leave each, if each vessel of a group is seen at each of its scenes.

    What goes into a task says little on that: reports and scenes add up, pairs are their product.
    """
    size = met.groupBy("bucket", "_salt", "kind", "user_id").count().groupBy("bucket", "_salt").agg(F.count_if(F.col("kind") == 0).alias("vessels"), F.sum(F.when(F.col("kind") == 1, F.col("count"))).alias("scenes"))
    pairs = size.agg(F.sum(F.col("vessels") * F.col("scenes"))).first()[0] or 0
    return max(met.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS))


def _steps(n: int, width: int, row: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A table of n rows: how many of the spans first to end (without it) in its row hold each of width columns."""
    at = row * (width + 1)
    change = np.bincount(at + first, minlength=n * (width + 1)) - np.bincount(at + end, minlength=n * (width + 1))
    return np.cumsum(change.reshape(n, width + 1), axis=1)[:, :width]


def support_counts(scenes: DataFrame, reports: DataFrame, half_s: float) -> DataFrame:
    """scene_id, reports, vessels, nearest_s of the reports within half_s of a scene (scene_id, at_us), wherever they are.

    Counted on the ordered instants of an hour without a pair of a report and a scene; scenes without any are left out. A
    vessel is counted by its reports' merged windows. Only of a scene_id with several instants the vessels are gathered.
    """
    half = int(half_s * 1e6)

    def work(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pa.Table]:
        for told, asked in _parts(frame, starts):
            at, t, user = asked["t"].to_numpy(), told["t"].to_numpy(), told["user_id"].to_numpy()
            new = np.ones(len(t), bool)
            new[1:] = (user[1:] != user[:-1]) | (t[1:] - t[:-1] > 2 * half)
            opens, closes = np.sort(t[new] - half), np.sort(t[np.r_[new[1:], True]] + half)
            vessels = np.searchsorted(opens, at, "right") - np.searchsorted(closes, at, "left")
            order = np.argsort(t, kind="stable")
            t, user = t[order], user[order]
            lo, hi = np.searchsorted(t, at - half, "left"), np.searchsorted(t, at + half, "right")
            after = np.searchsorted(t, at, "left")
            away = np.minimum(np.abs(t[np.clip(after, 0, len(t) - 1)] - at), np.abs(t[np.clip(after - 1, 0, len(t) - 1)] - at))
            again = asked["again"].to_numpy(bool)
            users = [np.unique(user[a:b]) if x else None for x, a, b in zip(again, lo, hi, strict=True)]
            kept = hi > lo
            table = {"id": asked["id"].to_numpy(), "reports": hi - lo, "vessels": np.where(again, 0, vessels), "away": away, "users": pa.array(users, pa.list_(pa.int64()))}
            yield pa.table(table).filter(pa.array(kept))

    named = scenes.select("scene_id", "at_us", (F.count("*").over(Window.partitionBy("scene_id")) > 1).alias("again"))
    found = over_groups(_met(named, reports, half_s), ["bucket", "_salt"], ["kind", "user_id", "t"], work, "id bigint, reports bigint, vessels bigint, away bigint, users array<bigint>")
    total = found.groupBy(F.nullif("id", F.lit(_NAMELESS)).alias("scene_id")).agg(
        F.sum("reports").alias("reports"), (F.sum("vessels") + F.size(F.array_distinct(F.flatten(F.collect_list("users"))))).alias("vessels"), (F.min("away") / 1e6).alias("nearest_s")
    )
    return total


def _settled(df: DataFrame) -> DataFrame:
    """df with its columns worked out once: a generator of one row, into which nothing above is written.

    Else every use of a column repeats the whole expression behind it, and the generated code outgrows the compiler.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def asof(wanted: DataFrame, reports: DataFrame, half_s: float, reach_s: float | None = None, bucket_s: float = 86_400.0) -> DataFrame:
    """wanted (scene_id, at_us, user_id) with the vessel's last report not after and first one after the instant (left, right).

    Also whether any instant within half_s holds several places (torn), and the instants with reports within half_s (reports). Rows
    with none of it within reach_s (half_s if not given) are left out. Both sides are put in order of time once, by vessel and
    day; a report close to a day's edge is in both. No pair of a report and a scene is made.
    """
    half, reach = int(half_s * 1e6), int((reach_s or half_s) * 1e6)
    row = F.struct("report_id", "lat", "lon", "speed_knots", "course_deg", F.unix_micros("time_utc").alias("t_us"))
    told = reports.select("user_id", F.unix_micros("time_utc").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("scene_id"), row.alias("r")).withColumn("_s", F.col("t") / 1e6)
    told = in_time_buckets(told, "_s", bucket_s, reach / 1e6).drop("_s", "core")
    asked = wanted.select("user_id", F.col("at_us").alias("t"), F.lit(1).alias("kind"), "scene_id", F.lit(None).cast(told.schema["r"].dataType).alias("r"), F.floor(F.col("at_us") / 1e6 / bucket_s).alias("bucket"))
    key = ["user_id", "bucket"]
    by_time = Window.partitionBy(*key).orderBy("t")
    peers, around = by_time.rangeBetween(0, 0), by_time.rangeBetween(-half, half)
    rows = told.unionByName(asked).withColumn("_torn", (F.min("r.lat").over(peers) < F.max("r.lat").over(peers)) | (F.min("r.lon").over(peers) < F.max("r.lon").over(peers)))
    rows = rows.withColumn("r", F.when(F.col("r.report_id") == F.min("r.report_id").over(peers), F.col("r")))  # the first of each instant
    rows = rows.withColumn("torn", F.max("_torn").over(around)).withColumn("reports", F.count("r").over(around))
    rows = rows.withColumn("left", F.last("r", ignorenulls=True).over(Window.partitionBy(*key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("right", F.last("r", ignorenulls=True).over(Window.partitionBy(*key).orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.where("kind = 1").withColumnRenamed("t", "at_us")
    close = lambda c, most: F.when(F.abs(F.col(f"{c}.t_us") - F.col("at_us")) <= most, F.col(c))
    out = out.withColumn("left", close("left", reach)).withColumn("right", close("right", reach)).where("left is not null or right is not null")
    return out.select("scene_id", "at_us", "user_id", "left", "right", F.coalesce("torn", F.lit(False)).alias("torn"), "reports")


def around(told: pd.DataFrame, asked: pd.DataFrame, half: int) -> Iterator[tuple]:
    """The vessels of told (reports) with any within half microseconds of the scenes asked, a part of them at a time, by vessel and instant.

    Arrays by pair: the scene's place in asked, the vessel, how many reports, the reports on both sides as places in column (FIELDS, t_us) and
    whether there are any. Of these column, and way: distance and azimuth from each to the next one.
    """
    at = asked["t"].to_numpy()
    user, t = told["user_id"].to_numpy(), told["t"].to_numpy()
    lat, lon = told["lat"].to_numpy(), told["lon"].to_numpy()
    first = np.ones(len(t), bool)  # of each instant
    first[1:] = (user[1:] != user[:-1]) | (t[1:] != t[:-1])
    head = np.flatnonzero(first)
    several = np.add.reduceat((lat != lat[head][np.cumsum(first) - 1]) | (lon != lon[head][np.cumsum(first) - 1]), head) > 0
    user, t, n = user[head], t[head], len(at)
    column = {c: told[c].to_numpy()[head] for c in FIELDS} | {"t_us": t}
    vessel = np.cumsum(np.r_[False, user[1:] != user[:-1]])
    opens = np.r_[np.flatnonzero(np.r_[True, user[1:] != user[:-1]]), len(t)]
    follows = np.flatnonzero((user[1:] == user[:-1]) & (t[1:] - t[:-1] <= 2 * half))
    way = np.full((2, len(t)), np.nan)
    way[:, follows] = inverse(*[column[k][follows + d] for d in (0, 1) for k in ("lat", "lon")])
    a, b, c = np.searchsorted(at, t - half, "left"), np.searchsorted(at, t + half, "right"), np.searchsorted(at, t, "left")
    step = max(1, CELLS // (n + 1))
    for v in range(0, len(opens) - 1, step):
        m = min(step, len(opens) - 1 - v)
        own = slice(opens[v], opens[v + m])
        row = vessel[own] - v
        count = _steps(m, n, row, a[own], b[own])
        fit = count > 0
        if several[own].any():
            bad = several[own]
            fit &= _steps(m, n, row[bad], a[own][bad], b[own][bad]) == 0
        last = np.full((m, n + 1), -1)
        last[row, c[own]] = np.arange(opens[v], opens[v + m])  # of several the latest, as they come in order
        last[:, 0] = np.maximum(last[:, 0], opens[v : v + m] - 1)
        last = np.maximum.accumulate(last, axis=1)[:, :n]
        i, j = np.nonzero(fit)
        left = last[i, j]
        right, when = left + 1, at[j]
        has_left, has_right = left >= opens[v + i], right < opens[v + i + 1]
        left, right = np.where(has_left, left, 0), np.where(has_right, right, 0)
        has_left &= when - t[left] <= half
        has_right &= t[right] - when <= half
        yield j, user[opens[v + i]], count[i, j], left, right, has_left, has_right, column, way


def seen(scenes: DataFrame, reports: DataFrame, half_s: float, written: bool = False) -> DataFrame:
    """scene_id, at_us, user_id, left, right, torn, reports as asof() has them, of every vessel and every scene it has reports around.

    Also g, the geodesic from left to right, which is worked out once for two reports and not for each scene between them. Left and right lie within half_s. Vessels of which an instant within half_s holds several places are left out. The
    pairs are the result itself: they are made where an hour's reports and scenes meet, after the only shuffle. written: they go
    from there into files, so the tasks are as many as the pairs ask for, which are counted in a job of its own.
    """
    half = int(half_s * 1e6)

    def work(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pa.Table]:
        for told, asked in _parts(frame, starts):
            at, name = asked["t"].to_numpy(), asked["id"].to_numpy()
            for j, user, count, left, right, has_left, has_right, column, way in around(told, asked, half):
                out = {"id": name[j], "at_us": at[j], "user_id": user, "reports": count}
                for side, which, has in (("l", left, has_left), ("r", right, has_right)):
                    out |= {f"{side}_{k}": pa.array(x[which], mask=~has | np.isnan(x[which])) for k, x in column.items()}
                out |= {k: pa.array(x[left], mask=~(has_left & has_right)) for k, x in zip(("distance_m", "azimuth_deg"), way, strict=True)}
                yield pa.table(out)

    flat = [f"{side}_{k} {'bigint' if k == 't_us' else 'double'}" for side in "lr" for k in (*FIELDS, "t_us")]
    met = _met(scenes.select("scene_id", "at_us").distinct(), reports, half_s, *FIELDS)
    found = over_groups(met, ["bucket", "_salt"], ["kind", "user_id", "t", "id"], work, f"id bigint, at_us bigint, user_id bigint, reports bigint, distance_m double, azimuth_deg double, {', '.join(flat)}", _tasks(met) if written else None)
    side = lambda s: F.when(F.col(f"{s}_t_us").isNotNull(), F.struct(*[F.col(f"{s}_{k}").alias(k) for k in (*FIELDS, "t_us")]))
    return found.select(F.nullif("id", F.lit(_NAMELESS)).alias("scene_id"), "at_us", "user_id", side("l").alias("left"), side("r").alias("right"), F.lit(False).alias("torn"), "reports", F.struct("distance_m", "azimuth_deg").alias("g"))


def aligned(scenes: DataFrame, reports: DataFrame, written: bool = False) -> DataFrame:
    """At most one position of each vessel at each scene's instant.

    scenes: scene_id, at_us. reports: cleaned ones, with report_id for the order of arrival. A track with two
    positions at one instant is left out. Observed exactly, else between the reports on both sides along the
    geodesic if no more than PLAUSIBLE_KNOTS were needed, else carried on from one side for at most
    PROPAGATE_S with its motion, or unmoved for STILL_S. written: as for seen().
    """
    return placed(seen(scenes, reports, AGE_S, written))


def placed(found: DataFrame, *carried: str) -> DataFrame:
    """The positions at the instants of asof() or seen(), with columns carried along."""
    late = lambda c: (F.col(f"{c}.t_us") - F.col("at_us")) / 1e6
    near = lambda c: F.when(F.abs(late(c)) <= AGE_S, F.struct(*[F.col(f"{c}.{k}").alias(k) for k in ("lat", "lon", "speed_knots", "course_deg", "t_us")], late(c).alias("dt")))
    tracks = found.where(~F.col("torn")).withColumn("left", near("left")).withColumn("right", near("right")).where("left is not null or right is not null")
    first = F.col("right").isNull() | (F.abs("left.dt") <= F.abs("right.dt"))
    tracks = _settled(_settled(tracks).withColumn("near", F.when(F.col("left").isNotNull() & first, F.col("left")).otherwise(F.col("right"))))
    exact = F.col("near.dt") == 0
    both = F.col("left").isNotNull() & F.col("right").isNotNull() & ~exact
    g = F.col("g") if "g" in found.columns else geodesic(F.col("left.lat"), F.col("left.lon"), F.col("right.lat"), F.col("right.lon"))
    tracks = tracks.withColumn("_g", F.when(both, g))
    span = F.col("right.dt") - F.col("left.dt")
    chord_m_s = F.col("_g.distance_m") / span
    age = F.when(both, F.greatest(-F.col("left.dt"), F.col("right.dt"))).otherwise(F.abs(F.col("near.dt")))
    known = (F.col("near.speed_knots") <= PLAUSIBLE_KNOTS) & F.col("near.course_deg").isNotNull()
    known = F.coalesce(known, F.lit(False))
    method = (
        F.when(exact, "observed")
        .when(both, F.when(chord_m_s <= PLAUSIBLE_KNOTS * KNOT, "interpolated"))
        .when((age <= PROPAGATE_S) & known, "velocity_propagated")
        .when(age <= STILL_S, "nearest")
    )
    tracks = tracks.withColumn("age", age).withColumn("method", method).withColumn("known", known).where("method is not null")
    tracks = tracks.withColumn("chord", chord_m_s)
    inter, moved = F.col("method") == "interpolated", F.col("method") == "velocity_propagated"
    start = F.when(inter, F.col("left")).otherwise(F.col("near"))
    azimuth = F.when(inter, F.col("_g.azimuth_deg")).when(moved, F.col("near.course_deg")).otherwise(0.0)
    metres = F.when(inter, -F.col("left.dt") * F.col("chord")).when(moved, -F.col("near.dt") * F.col("near.speed_knots") * KNOT).otherwise(0.0)
    tracks = tracks.withColumn("_to", destination(start["lat"], start["lon"], azimuth, metres))
    still = ~inter & ~moved
    return tracks.select(
        "scene_id", "user_id", "method", "reports",
        F.when(still, F.col("near.lat")).otherwise(F.col("_to.lat")).alias("lat"), F.when(still, F.col("near.lon")).otherwise(F.col("_to.lon")).alias("lon"),
        F.col("age").alias("report_age_s"), (F.lit(BASE_M) + DRIFT_M_S * F.col("age")).alias("uncertainty_m"),
        F.when(inter, F.col("chord")).when(F.col("known"), F.col("near.speed_knots") * KNOT).alias("speed_m_s"),
        F.when(inter, F.col("_g.azimuth_deg")).when(F.col("known"), F.col("near.course_deg")).alias("course_deg"), *carried,
    )


def flagged(pairs: DataFrame) -> DataFrame:
    """Candidate pairs (scene_id, target_id, user_id) with `ambiguous`: the target has another candidate, or

    a candidate of it has another target.
    """
    of_target, of_vessel = Window.partitionBy("scene_id", "target_id"), Window.partitionBy("scene_id", "user_id")
    pairs = pairs.repartition("scene_id")  # serves both windows, so pairs move once
    pairs = pairs.withColumn("_t", F.count("*").over(of_target)).withColumn("_v", F.count("*").over(of_vessel))
    return pairs.withColumn("ambiguous", (F.col("_t") > 1) | (F.max("_v").over(of_target) > 1)).drop("_t", "_v")


def best_pairs(left: np.ndarray, right: np.ndarray, cost: np.ndarray, alone: float | None = None) -> np.ndarray:
    """Indices of edges that pair the most, and of those the cheapest, by shortest augmenting paths.

    With a price for staying alone instead the cheapest choice of all: pairs and those who stay.

    Every left vertex has a place of its own besides, dearer than all pairs together, so that each search
    ends; who takes it stays alone. Prices keep the reduced costs non-negative.
    """
    edges: dict[int, list[tuple[int, float, int]]] = defaultdict(list)
    for e, (a, b, c) in enumerate(zip(left, right, cost, strict=True)):
        edges[int(a)].append((int(b), float(c), e))
    dear = alone if alone is not None else (float(np.max(cost)) + 1.0) * (len(edges) + 1) if len(cost) else 1.0
    for a in edges:
        edges[a].append((-1 - a, dear, -1))
    owner: dict[int, int] = {}
    taken: dict[int, tuple[int, int]] = {}
    price_l: dict[int, float] = defaultdict(float)
    price_r: dict[int, float] = defaultdict(float)
    for root in sorted(edges):
        price_l[root] = min(c - price_r[b] for b, c, _ in edges[root])
        dist: dict[int, float] = {}  # of right vertices
        via: dict[int, tuple[int, int]] = {}
        settled: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        reach, at = {root: 0.0}, root
        while True:
            for b, c, e in edges[at]:
                d = reach[at] + c - price_l[at] - price_r[b]
                if b not in settled and d < dist.get(b, float("inf")):
                    dist[b], via[b] = d, (at, e)
                    heapq.heappush(heap, (d, b))
            d, b = heapq.heappop(heap)
            while b in settled or d > dist[b]:
                d, b = heapq.heappop(heap)
            settled[b] = d
            if b not in owner:
                break
            at = owner[b]
            reach[at] = d
        for a, r in reach.items():
            price_l[a] += d - r
        for x, r in settled.items():
            price_r[x] -= d - r
        while True:
            a, e = via[b]
            before = taken.get(a)
            owner[b], taken[a] = a, (b, e)
            if a == root:
                break
            b = before[0]
    return np.array(sorted(e for _, e in taken.values() if e >= 0), dtype=int)


def _contested(block: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """flagged() for edges a to b, both numbered from 0, of blocks numbered so."""
    left = np.unique(block * (np.max(a, initial=0) + 1) + a, return_inverse=True)[1]
    right = np.unique(block * (np.max(b, initial=0) + 1) + b, return_inverse=True)[1]
    rival = np.zeros(len(a), int)
    np.maximum.at(rival, left, np.bincount(right)[right])
    return (np.bincount(left)[left] > 1) | (rival[left] > 1)


def one_to_one(pairs: DataFrame, block: list[str], left: str, right: str, cost: str, alone: float | None = None, flags: bool = False) -> DataFrame:
    """pairs with `selected`: within each block as many as can be, each row and column once, least total cost.

    flags: with `ambiguous` before it, as flagged() has it, without moving the pairs once more. A block is a scene: its size is that of what one image shows, not of the tables.
    """

    def solve(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        a, b = pd.factorize(frame[left])[0], pd.factorize(frame[right])[0]
        c = frame[cost].to_numpy(float)
        chosen = np.zeros(len(frame), bool)
        for lo, hi in zip(starts, np.r_[starts[1:], len(frame)], strict=True):
            if hi - lo == 1:
                chosen[lo] = alone is None or c[lo] < alone
            else:
                chosen[lo + best_pairs(a[lo:hi], b[lo:hi], c[lo:hi], alone)] = True
        if flags:
            number = np.zeros(len(frame), int)
            number[starts[1:]] = 1
            frame = frame.assign(ambiguous=_contested(np.cumsum(number), a, b))
        return frame.assign(selected=chosen)

    fields = [*pairs.schema.fields, *[StructField("ambiguous", BooleanType())] * flags, StructField("selected", BooleanType())]
    return over_groups(pairs, block, [left, right], solve, StructType(fields))


def covariance(speed_m_s: Column, course_deg: Column, age_s: Column, base_m: float = 100.0, along: float = 0.15, across: float = 0.05) -> Column:
    """East-north covariance of an aligned position: a base, and growth with age along and across the course.

    Where speed or course is unknown the vessel may have gone anywhere at PLAUSIBLE_KNOTS.
    """
    known = speed_m_s.isNotNull() & course_deg.isNotNull()
    s, rad = F.coalesce(speed_m_s, F.lit(0.0)) * age_s, F.radians(F.coalesce(course_deg, F.lit(0.0)))
    anywhere = F.pow(age_s * (PLAUSIBLE_KNOTS * KNOT), 2) + base_m**2
    a2, c2 = F.when(known, F.pow(s * along, 2) + base_m**2).otherwise(anywhere), F.when(known, F.pow(s * across, 2) + base_m**2).otherwise(anywhere)
    sin, cos = F.sin(rad), F.cos(rad)
    return F.struct((a2 * sin * sin + c2 * cos * cos).alias("ee"), ((a2 - c2) * sin * cos).alias("en"), (a2 * cos * cos + c2 * sin * sin).alias("nn"))


def _state() -> Column:
    return F.when(F.col("second").isNull(), "first_only").when(F.col("first").isNull(), "second_only").when(F.col("first") == F.col("second"), "same").otherwise("different")


def compared_choices(one: DataFrame, two: DataFrame) -> DataFrame:
    """By target (scene_id, target_id) the vessel either matcher chose, and how they agree; targets that neither pairs are left out."""
    a = one.where("selected").select("scene_id", "target_id", F.col("user_id").alias("first"))
    b = two.where("selected").select("scene_id", "target_id", F.col("user_id").alias("second"))
    return a.join(b, ["scene_id", "target_id"], "full").withColumn("state", _state())


#: Gates of the uncertain association: squared statistical distance, metres, and the price of no pair.
GATE_D2, GATE_M, ABSTAIN = 9.21, 2000.0, 20.0


def uncertain_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (scene_id, target_id, user_id, east_m, north_m, c: covariance) within both gates, with d2, cost, selected.

    The cost weighs the distance in units of its own uncertainty, so that a vague position does not win by
    its vagueness; who has only dear partners stays without.
    """
    rows = priced(pairs).where("cost is not null").drop("c")
    return one_to_one(rows, ["scene_id"], "target_id", "user_id", "cost", ABSTAIN)


def priced(pairs: DataFrame) -> DataFrame:
    """pairs as for uncertain_pairs() with d2, distance_m, and the cost of those within both gates and below ABSTAIN."""
    det = F.col("c.ee") * F.col("c.nn") - F.col("c.en") * F.col("c.en")
    d2 = (F.col("east_m") ** 2 * F.col("c.nn") - 2 * F.col("east_m") * F.col("north_m") * F.col("c.en") + F.col("north_m") ** 2 * F.col("c.ee")) / det
    rows = pairs.withColumn("d2", d2).withColumn("distance_m", F.hypot("east_m", "north_m"))
    cost = 0.5 * (F.col("d2") + F.ln(det / 1e8))
    return rows.withColumn("cost", F.when((F.col("d2") <= GATE_D2) & (F.col("distance_m") <= GATE_M) & (cost < ABSTAIN), cost))
