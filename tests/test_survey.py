"""The survey's operators that no SQL checks, and the rules they must keep."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelorus.functions import geodesy, radar
from pelorus.operators import alignment, catalogue, detection, reports, statistics
from pelorus.plans import survey_queries

T = dt.datetime(2017, 1, 2, 12, tzinfo=dt.UTC)
CLEAN = "report_id bigint, user_id bigint, lat double, lon double, speed_knots double, course_deg double, time_utc timestamp"


def align(spark, rows):
    """rows: (user, seconds, lat, lon, speed, course)."""
    data = [(i, u, float(la), float(lo), None if s is None else float(s), None if c is None else float(c), T + dt.timedelta(seconds=x)) for i, (u, x, la, lo, s, c) in enumerate(rows)]
    scenes = spark.createDataFrame([(1, int(T.timestamp() * 1e6))], "scene_id bigint, at_us bigint")
    return {r.user_id: r for r in alignment.aligned(scenes, spark.createDataFrame(data, CLEAN)).collect()}


def test_alignment_rules(spark):
    got = align(spark, [
        (1, 0, 47, -51, 5, 10), (2, -60, 47, -51, 5, 0), (2, 60, 47.01, -51, 5, 0), (3, -60, 47, -51, 5, 0), (3, 60, 47.2, -51, 5, 0),
        (4, -120, 47, -51, 10, 90), (5, -121, 47, -51, 10, 90), (6, 60, 47, -51, None, None), (7, 61, 47, -51, None, None),
        (8, -30, 47, -51, 5, 0), (8, -30, 47.001, -51, 5, 0), (9, -301, 47, -51, 5, 0), (10, -30, 47, -51, 61, 0), (10, -30, 47, -51, 5, 0),
    ])
    methods = {u: r.method for u, r in got.items()}
    assert methods == {1: "observed", 2: "interpolated", 4: "velocity_propagated", 6: "nearest", 10: "nearest"}
    assert abs(got[2].lat - 47.005) < 1e-6 and got[2].report_age_s == 60 and got[2].uncertainty_m == 220
    d, az = geodesy.inverse(47, -51, got[4].lat, got[4].lon)
    assert abs(d - 120 * 10 * 1852 / 3600) < 1e-3 and abs(az - 90) < 1e-6
    assert got[6].lat == 47 and got[6].speed_m_s is None


def test_geodesics():
    d, az = geodesy.inverse([0, 47.0, 10], [0, -51.0, 179.9], [1, 47.0, 10], [1, -51.0, -179.9])
    assert abs(d[0] - 156899.568) < 1e-2 and d[1] == 0 and abs(d[2] - 21924) < 10
    rng = np.random.default_rng(1)
    la, lo, a, s = rng.uniform(-80, 80, 50), rng.uniform(-180, 180, 50), rng.uniform(0, 360, 50), rng.uniform(1, 5e5, 50)
    la2, lo2 = geodesy.forward(la, lo, a, s)
    back, az = geodesy.inverse(la, lo, la2, lo2)
    assert np.allclose(back, s, atol=1e-4) and np.allclose((az - a + 180) % 360, 180, atol=1e-5)
    x, y = geodesy.lambert(63.390675, -91.8666666667)
    assert abs(x - 6_200_000) < 1e-6 and abs(y - 3_000_000) < 1e-6


def test_assignment_equals_brute_force_and_flags(spark):
    rng = np.random.default_rng(2)
    for _ in range(60):
        edges = [(a, b) for a in range(4) for b in range(4) if rng.random() < 0.5]
        if not edges:
            continue
        left, right = np.array(edges).T
        cost = np.round(rng.random(len(edges)) * 10, 2)
        got = alignment.best_pairs(left, right, cost)
        size, total = next(
            (k, min(o)) for k in range(4, 0, -1)
            if (o := [cost[list(s)].sum() for s in itertools.combinations(range(len(edges)), k) if len(set(left[list(s)])) == k == len(set(right[list(s)]))])
        )
        assert len(got) == size and abs(cost[got].sum() - total) < 1e-9
    pairs = spark.createDataFrame([(1, 1, 7, 5.0), (1, 2, 7, 1.0), (1, 3, 8, 2.0)], "scene_id bigint, target_id bigint, user_id bigint, distance_m double")
    rows = {r.target_id: r for r in alignment.one_to_one(alignment.flagged(pairs), ["scene_id"], "target_id", "user_id", "distance_m").collect()}
    assert [rows[k].ambiguous for k in (1, 2, 3)] == [True, True, False]
    assert [rows[k].selected for k in (1, 2, 3)] == [False, True, True]


def test_intervals_at_their_edges(spark):
    i = spark.createDataFrame([("a", 0.0, 10.0), ("a", 10.0, 20.0), ("a", 20.5, 30.0), ("a", 5.0, 6.0), ("b", 3.0, 2.0)], "k string, a double, b double")
    got = sorted((r.a, r.b, r.pieces) for r in reports.merged_intervals(i, "k", "a", "b").collect())
    assert got == [(0.0, 20.0, 3), (20.5, 30.0, 1)]
    c = reports.coverage(i, "k", "a", "b", F.lit(5.0), F.lit(25.0)).first()
    assert c.covered_s == 19.5 and c.share == 0.975


def test_health_order(spark):
    now = F.lit(T)
    rows = [("old", T - dt.timedelta(seconds=181), True, T, T), ("skew", T + dt.timedelta(seconds=61), True, T, T), ("none", None, True, T, T), ("off", T, False, T, T), ("unknown", T, None, T, T), ("quiet", T, True, T - dt.timedelta(seconds=601), T), ("ok", T, True, T - dt.timedelta(seconds=600), T)]
    s = spark.createDataFrame(rows, "k string, heartbeat_at timestamp, connected boolean, observed_at timestamp, received_at timestamp")
    got = {r.k: r.state for r in reports.health(s, now).collect()}
    assert got == {"old": "heartbeat_stale", "skew": "heartbeat_stale", "none": "heartbeat_stale", "off": "disconnected", "unknown": "disconnected", "quiet": "observations_stale", "ok": "fresh"}


def test_exact_intervals():
    low, high = statistics.binomial_interval([3, 0, 10, 0], [3, 10, 10, 0])
    assert np.allclose(low[:3], [0.2924018, 0, 0.6915029], atol=1e-6) and np.allclose(high[:3], [1, 0.3084971, 1], atol=1e-6)
    assert np.isnan(low[3]) and np.isnan(high[3])
    low, high = statistics.poisson_interval([0, 5], [2.0, 1.0])
    assert np.allclose(low, [0, 1.623486], atol=1e-5) and np.allclose(high, [3.688879 / 2, 11.668332], atol=1e-5)
    with pytest.raises(ValueError):
        statistics.poisson_interval([1], [0.0])


def test_bootstrap_and_greedy(spark):
    b = spark.createDataFrame([(float(i % 3), 3.0) for i in range(30)], "n double, d double")
    low, high = statistics.block_bootstrap(b, "n", "d", 500, seed=3)
    assert 0.2 < low < 1 / 3 < high < 0.45 and statistics.block_bootstrap(b.limit(4), "n", "d") is None
    out = catalogue.greedy([{"id": k, "g": k % 2} for k in range(6)], [("group_taken", lambda r, t: all(x["g"] != r["g"] for x in t))], 2)
    assert [r["reason"] for r in out] == [None, None, "batch_full", "batch_full", "batch_full", "batch_full"]


def test_components_of_a_long_chain(spark):
    e = spark.range(60).selectExpr("id a", "id + 1 b").unionByName(spark.createDataFrame([(100, 101), (5, 5)], "a bigint, b bigint"))
    labels = {r.v: r.label for r in catalogue.components(e).collect()}
    assert set(labels[k] for k in range(61)) == {0} and labels[101] == 100


def test_suppression_and_doubles(spark):
    x0, y0 = np.array([0.0, 1, 50, 0]), np.array([0.0, 1, 50, 0])
    keep = detection.keep_best(x0, y0, x0 + 10, y0 + 10, np.array([0.9, 0.8, 0.7, 0.9]), 0.5)
    assert keep.tolist() == [True, False, True, False]
    keep = detection.keep_apart(np.array([0.0, 3, 3, 20]), np.zeros(4), np.array([0.9, 0.8, 0.7, 0.1]), ["a", "a", "b", None], 6.0)
    assert keep.tolist() == [True, True, False, True]


def test_local_contrast_finds_the_bright_spot():
    rng = np.random.default_rng(4)
    db = rng.normal(-20, 0.3, (90, 90))
    db[45:47, 40:42] = -3
    db[50, 80] = np.nan
    c = detection.local_contrast(db)
    assert np.isnan(c[45, 60]) and not np.isnan(c[45, 45])
    found = detection.bright_regions([c, c], [8.0, 6.0])
    assert len(found) == 1 and found[0]["pixels"] == 4 and found[0]["row"] in (45, 46)


def test_calibration_table_and_rings(spark):
    at = radar.lookup(np.array([0.0, 10.0]), np.array([0.0, 5.0, 20.0]), np.array([[1.0, 2.0, 5.0], [3.0, 4.0, 7.0]]))
    import pandas as pd

    assert at(pd.Series([0, 5, 10, 99]), pd.Series([2.5, 5, 12.5, -3])).tolist() == [1.5, 3.0, 5.5, 3.0]
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    df = spark.createDataFrame([(ring,)], "r array<struct<x: double, y: double>>")
    assert df.select(radar.ring_area(F.col("r")).alias("a")).first().a == 2.0


def test_scenes_in_every_spelling_of_an_instant(spark):
    texts = ["2017-01-02T12:00:00.5Z", "2017-01-02T09:30:00.5-02:30", "2017-01-02 12:00:00.500000 +0000 UTC", "2017-01-02T12:00:00.5", "1483358400.5", "2017-01-02T12:00:00Z"]
    rows = list(enumerate([*texts, "unknown", "", None, "2017-13-02T12:00:00Z"]))
    m = spark.createDataFrame(rows, "area_id bigint, reference_midpoint_utc string")
    got = {r.scene_id: r.at_us for r in survey_queries.scenes(m).collect()}
    assert got == {0: 1483358400500000, 1: 1483358400500000, 2: 1483358400500000, 3: 1483358400500000, 4: 1483358400500000, 5: 1483358400000000}


def test_lambert_there_and_back_and_envelopes():
    rng = np.random.default_rng(3)
    la, lo = rng.uniform(42, 70, 40), rng.uniform(-140, -45, 40)
    back = geodesy.lambert_inverse(*geodesy.lambert(la, lo))
    assert np.allclose(back[0], la, atol=1e-9) and np.allclose(back[1], lo, atol=1e-9)
    ring = geodesy.envelope(47.5, -52.0, 2560.0)
    assert ring[0] == ring[-1] and len(ring) == 5
    x, y = geodesy.lambert([p[1] for p in ring], [p[0] for p in ring])
    assert np.allclose([np.ptp(x), np.ptp(y)], 5120, atol=1e-3)


def test_unknown_motion_may_go_anywhere_and_matchers_are_compared(spark):
    df = spark.createDataFrame([(5.0, 90.0, 10.0), (5.0, None, 10.0), (None, 3.0, 10.0)], "v double, c double, age double")
    a, b, c = [r.c for r in df.select(alignment.covariance(F.col("v"), F.col("c"), F.col("age")).alias("c")).collect()]
    assert abs(a.ee - (7.5**2 + 1e4)) < 1e-6 and abs(b.ee - b.nn) < 1e-6 and b == c or abs(b.ee - c.ee) < 1e-6
    assert abs(b.ee - ((60 * 1852 / 3600 * 10) ** 2 + 1e4)) < 1e-6 and abs(b.en) < 1e-6
    rows = lambda *x: spark.createDataFrame(x, "scene_id int, target_id int, user_id int, selected boolean")
    out = alignment.compared_choices(rows((1, 1, 7, True), (1, 2, 8, True), (1, 3, 9, True), (1, 4, 5, False)), rows((1, 1, 7, True), (1, 2, 9, True), (1, 5, 6, True)))
    assert {r.target_id: r.state for r in out.collect()} == {1: "same", 2: "different", 3: "first_only", 5: "second_only"}
