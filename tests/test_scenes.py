"""Scenes against reports at size: no side broadcast, counts and tracks as by brute force."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from pelorus.operators import alignment
from pelorus.plans import survey_queries

T = 1483358400000000  # an hour's edge, in microseconds
CLEAN = "report_id bigint, user_id bigint, lat double, lon double, speed_knots double, course_deg double, time_utc timestamp"
RAW = "report_id bigint, user_id bigint, latitude double, longitude double, time_utc timestamp, received_at timestamp, sog double, cog double, message_type string, timestamp_basis string"


def reports(spark, rows):
    """rows: (user, microseconds from T, lat, lon)."""
    at = lambda us: dt.datetime.fromtimestamp(0, dt.UTC) + dt.timedelta(microseconds=T + int(us))
    return spark.createDataFrame([(i, int(u), float(la), float(lo), 5.0, 10.0, at(us)) for i, (u, us, la, lo) in enumerate(rows)], CLEAN)


def drawn():
    """Reports about an hour's edge, with windows that end on scenes, equal instants and vessels in two places."""
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(1, 9)), int(rng.integers(-1500, 1500)) * 1_000_000, 47.0, -51.0) for _ in range(160)]
    return rows + [(20, -300_000_000, 47, -51), (21, 300_000_000, 47, -51), (22, 300_000_001, 47, -51), (23, 5, 47, -51), (23, 5, 48, -51), (24, 5, 47, -51), (24, 5, 47, -51)]


def test_support_is_counted_without_a_join(spark):
    rows, at = drawn(), [(1, 0), (2, 600_000_000), (3, -900_000_000), (4, 90_000_000_000), (5, 0), (5, 700_000_000), (5, 0), (None, 1)]
    got = alignment.support_counts(spark.createDataFrame([(s, T + x) for s, x in at], "scene_id bigint, at_us bigint"), reports(spark, rows), 300.0)
    got = {r.scene_id: (r.reports, r.vessels, r.nearest_s) for r in got.collect()}
    want = {}
    for s in {s for s, _ in at}:
        met = [(u, abs(us - x)) for k, x in at if k == s for u, us, _, _ in rows if abs(us - x) <= 300_000_000]
        if met:
            want[s] = (len(met), len({u for u, _ in met}), min(d for _, d in met) / 1e6)
    assert got == want and 4 not in got
    m = spark.createDataFrame([(1, "2017-01-02T12:00:00Z")], "area_id bigint, reference_midpoint_utc string")
    plan = survey_queries.scene_support(m, spark.createDataFrame([], RAW))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan  # scenes repeated by slices are more than their file's size says


def test_every_vessel_at_every_scene_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CELLS", 20)  # many parts of a group
    rows, at = drawn(), [(1, 0), (2, 600_000_000), (3, -900_000_000), (4, 90_000_000_000), (6, 30_000_000), (6, 30_000_000)]
    r, scenes = reports(spark, rows), spark.createDataFrame([(s, T + x) for s, x in at], "scene_id bigint, at_us bigint")
    half = 300_000_000
    want = {}
    for s, x in at:
        for u in {u for u, *_ in rows}:
            met = {us: (la, lo) for v, us, la, lo in reversed(rows) if v == u and abs(us - x) <= half}
            torn = any(len({(la, lo) for v, us, la, lo in rows if v == u and us == k}) > 1 for k in met)
            if met and not torn:
                want[s, u] = (len(met), max((k for k in met if k <= x), default=None), min((k for k in met if k > x), default=None))
    found = alignment.seen(scenes, r, 300.0).collect()
    got = {(f.scene_id, f.user_id): (f.reports, f.left and f.left.t_us - T, f.right and f.right.t_us - T) for f in found}
    assert got == want and len(found) == len(got)
    track = reports(spark, [(1, -200_000_000, 47, -51), (1, 200_000_000, 47.01, -51)])
    one, two = alignment.placed(alignment.seen(scenes, track, 300.0)), alignment.placed(alignment.seen(scenes, track, 300.0).drop("g"))
    same = lambda df: {f.scene_id: (f.method, round(f.lat, 9), round(f.lon, 9), round(f.speed_m_s, 9), f.course_deg) for f in df.collect()}
    assert same(one) == same(two) and same(one)[1][0] == "interpolated" and abs(same(one)[1][1] - 47.005) < 1e-6
    m = spark.createDataFrame([(1, "2017-01-02T12:00:00Z")], "area_id bigint, reference_midpoint_utc string")
    for query in (survey_queries.scene_alignment, survey_queries.scene_covariance):
        plan = query(m, spark.createDataFrame([], RAW))._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Join" not in plan


def test_few_pairs_leave_a_task_of_those_written_out(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS", 50, raising=False)
    at = [dt.datetime(2017, 1, 2, 0, 30, tzinfo=dt.UTC) + dt.timedelta(hours=h) for h in range(80)]
    m = spark.createDataFrame([(3 * h + k, f"{t:%Y-%m-%dT%H:%M}:0{k}Z") for h, t in enumerate(at) for k in range(3)], "area_id bigint, reference_midpoint_utc string")
    r = spark.createDataFrame([(5 * h + u, 100_000_000 + u, 47.0, -51.0, t, t, 5.0, 10.0, "a", "b") for h, t in enumerate(at) for u in range(5)], RAW)
    out = survey_queries.scene_covariance(m, r)
    assert sorted((f.scene_id, f.user_id) for f in out.collect()) == [(s, 100_000_000 + u) for s in range(240) for u in range(5)]
    left = [f["count"] for f in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(left) == 1200 and max(left) <= 150  # else a task writes as much as its reports and scenes multiply to


def test_flags_and_choices_in_one_pass_and_targets_not_broadcast(spark):
    rng = np.random.default_rng(6)
    edges = sorted({(int(s), int(t), int(u)) for s, t, u in rng.integers(0, 5, (60, 3))})
    pairs = spark.createDataFrame([(*e, float(k * 7 % 11)) for k, e in enumerate(edges)], "scene_id bigint, target_id bigint, user_id bigint, distance_m double")
    plain = alignment.one_to_one(alignment.flagged(pairs), ["scene_id"], "target_id", "user_id", "distance_m")
    assert sorted(alignment.one_to_one(pairs, ["scene_id"], "target_id", "user_id", "distance_m", flags=True).collect()) == sorted(plain.collect())
    m = spark.createDataFrame([(1, "2017-01-02T12:00:00Z")], "area_id bigint, reference_midpoint_utc string")
    a = spark.createDataFrame([(1, [-51.0, 47.0])], "annotation_id bigint, coordinates array<double>")
    for name in ("matcher_comparison", "scene_assignment", "scene_uncertain_pairs", "scene_candidates"):
        plan = getattr(survey_queries, name)(m, spark.createDataFrame([], RAW), a)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan, name
