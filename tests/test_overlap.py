import random

from pyspark.sql import functions as F

from pelorus.operators import overlap as O
from pelorus.operators import regions

RING = "array<struct<lon: double, lat: double>>"


def test_covers_equals_the_vectorised_test_and_keeps_edges(spark):
    import numpy as np

    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (2.0, 1.0), (0.0, 3.0), (0.0, 0.0)]
    r = random.Random(3)
    points = [(r.uniform(-1, 5), r.uniform(-1, 4)) for _ in range(300)] + [(0.0, 0.0), (2.0, 1.0), (4.0, 1.5), (2.0, 0.0), (2.0, 1.01)]
    df = spark.createDataFrame([(i, x, y, ring) for i, (x, y) in enumerate(points)], f"i int, x double, y double, ring {RING}")
    got = [row.c for row in df.select("i", O.covers(F.col("ring"), F.col("x"), F.col("y")).alias("c")).orderBy("i").collect()]
    xs, ys = np.array(points).T
    assert got == regions.covers(xs, ys, [np.array(ring[:-1])]).tolist() and got[-5:] == [True, True, True, True, False]


def test_footprints_that_are_none_let_nothing_pass(spark):
    whole = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    rows = [(1, 0, whole), (2, 0, whole[:3]), (3, 0, None), (4, None, whole), (5, 0, []), (6, 0, [(0.0, 0.0), (None, 0.0), (1.0, 1.0), (0.0, 0.0)])]
    scenes = spark.createDataFrame(rows, f"scene_id bigint, at_us bigint, ring {RING}")
    reports = spark.createDataFrame([(7, 0, 0.2, 0.6, "x"), (8, 2_000_000, 0.2, 0.6, "x"), (9, 0, 0.9, 0.1, "x")], "user_id bigint, t_us bigint, lat double, lon double, extra string")
    assert [(r.scene_id, r.user_id) for r in O.in_swath(scenes, reports, 1.0).collect()] == [(1, 7)]
    assert O.in_swath(scenes.limit(0), reports, 1.0).count() == 0


def test_brackets_keep_to_their_session_and_to_breaks_at_the_ends(spark):
    beats = spark.createDataFrame([("a", 10.0, True), ("a", 30.0, True), ("b", 10.0, True), ("b", 30.0, True), ("c", 20.0, True), ("d", 10.0, True), ("d", 30.0, False), ("e", 10.0, True)], "k string, t double, connected boolean")
    breaks = spark.createDataFrame([("b", 30.0), ("a", 31.0), (None, 15.0)], "k string, t double")
    got = sorted(tuple(r) for r in O.bracketing_beats(beats, breaks, "k", "t", 20.0, 20.0).collect())
    assert got == [("a", 10.0, 30.0), ("c", 20.0, 20.0)]


def test_repeats_meet_each_pair_once_over_slices(spark):
    rows = [(1, i, t * 1_000_000, 0.0, x) for i, (t, x) in enumerate([(0, 0.0), (99, 0.0), (101, 0.0), (150, 1.0), (150, 1.0)])] + [(None, 9, 0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k bigint, row bigint, t_us bigint, lat double, lon double")
    got = {r.row: (r.others, r.compatible) for r in O.repeats(df, "k", "row", 100.0, 300.0, 1.0).collect()}
    want = {}
    for _, i, t, _, x in rows[:5]:
        near = [(abs(t - u), y) for _, j, u, _, y in rows[:5] if j != i and abs(t - u) <= 100_000_000]
        want[i] = (len(near), sum(abs(x - y) * 111_195 <= 300 + d / 1e6 for d, y in near))
    assert got == {i: v for i, v in want.items() if v[0]}


def test_reasons_are_counted_each(spark):
    df = O.reasons_of(spark.createDataFrame([(1.0,), (5.0,), (None,)], "v double"), {"low": F.col("v") < 3, "odd": F.col("v") % 2 == 1})
    assert [r.reasons for r in df.collect()] == [["low", "odd"], ["odd"], []]
    assert {r.reason: r.n for r in O.counted_reasons(df).collect()} == {"low": 1, "odd": 2, "passed": 1}


def test_an_as_of_pass_equals_brute_force_over_days_ties_and_torn_instants(spark):
    import datetime as dt

    from pelorus.operators import alignment

    r = random.Random(9)
    t0 = dt.datetime(2017, 1, 2, tzinfo=dt.UTC)
    rows = []
    for i in range(600):
        s = r.choice([r.randrange(0, 200_000), 86_400 + r.randrange(-400, 400)])
        rows.append((i, r.randrange(1, 4), 47 + r.choice([0.0, 0.0, 0.001]), -52.0, 5.0, 10.0, t0 + dt.timedelta(seconds=s)))
    rows += [(1000 + k, *row[1:]) for k, row in enumerate(rows[:40])]
    reports = spark.createDataFrame(rows, "report_id bigint, user_id bigint, lat double, lon double, speed_knots double, course_deg double, time_utc timestamp")
    us = lambda t: int(t.timestamp() * 1e6)
    instants = [(k, us(t0) + s * 1_000_000) for k, s in enumerate([86_400, 86_399, 86_300, 86_500, *(r.randrange(0, 200_000) for _ in range(60))])]
    wanted = spark.createDataFrame([(k, at, u) for k, at in instants for u in (1, 2, 3, 4)], "scene_id bigint, at_us bigint, user_id bigint")
    got = {(x.scene_id, x.user_id): x for x in alignment.asof(wanted, reports, 300.0, 1800.0).collect()}
    for k, at in instants:
        for u in (1, 2, 3, 4):
            own = [(us(x[6]), x[0], x[2], x[3]) for x in rows if x[1] == u and abs(us(x[6]) - at) <= 1_800_000_000]
            before, after = [x for x in own if x[0] <= at], [x for x in own if x[0] >= at]
            if not own:
                assert (k, u) not in got
                continue
            x, close = got[k, u], [o for o in own if abs(o[0] - at) <= 300_000_000]
            if before:
                assert (x.left.t_us, x.left.report_id) == max((o[0], -o[1]) for o in before)[:1] + (min(o[1] for o in before if o[0] == max(b[0] for b in before)),)
            else:
                assert x.left is None
            if after and not (before and max(b[0] for b in before) == at):
                assert (x.right.t_us, x.right.report_id) == min((o[0], o[1]) for o in after)
            places = {}
            for o in close:
                places.setdefault(o[0], set()).add(o[2:])
            assert x.torn == any(len(p) > 1 for p in places.values()) and x.reports == len(places)
