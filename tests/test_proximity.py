import math

import numpy as np
from pyspark.sql import functions as F

from pelorus.operators import proximity as P

R = 6_371_008.8
SCHEMA = "id bigint, lat double, lon double, extra string"


def pts(spark, rows, prefix):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return P.points(df, F.col("id"), F.col("lat"), F.col("lon"), prefix)


def gap(a, b):
    s1, s2 = math.sin(math.radians(b[1] - a[1]) / 2), math.sin(math.radians(b[2] - a[2]) / 2)
    return 2 * R * math.asin(math.sqrt(min(1, s1 * s1 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * s2 * s2)))


def brute(left, right, radius):
    ok = [r for r in right if r[1] is not None and r[2] is not None and not math.isnan(r[1]) and abs(r[1]) <= 90]
    lk = [r for r in left if r[1] is not None and r[2] is not None and not math.isnan(r[1]) and abs(r[1]) <= 90]
    return sorted((a[0], b[0]) for a in lk for b in ok if gap(a, b) <= radius)


def test_within_distance_equals_brute_force_over_poles_and_antimeridian(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(47 + rng.normal(0, 0.02)), float(-51 + rng.normal(0, 0.02))) for i in range(120)]
    rows += [(200 + i, float(89.99 + rng.uniform(0, 0.01)), float(rng.uniform(-180, 540))) for i in range(40)]
    rows += [(300 + i, float(rng.normal(0, 0.01)), float(179.99 + rng.uniform(0, 0.02))) for i in range(40)]
    rows += [(400 + i, -90.0, float(i)) for i in range(3)]
    rows += [(500, None, 1.0), (501, 1.0, None), (502, float("nan"), 2.0), (503, 91.0, 181.0), (504, 47.0, float("nan"))]
    left, right = rows[::2], rows[1::2] + rows[:5]
    for radius in (300.0, 2500.0):
        got = P.within_distance(pts(spark, left, "l"), pts(spark, right, "r"), radius, len(right)).collect()
        assert sorted((r.l_id, r.r_id) for r in got) == brute(left, [r for r in right if r[0] != 504], radius)


def test_hot_cells_are_salted_and_keep_every_pair(spark):
    left = [(i, 47.0, -51.0) for i in range(3)]
    right = [(100 + i, 47.0001, -51.0001) for i in range(400)]
    got = P.within_distance(pts(spark, left, "l"), pts(spark, right, "r"), 300.0, 400, hot_rows=50).collect()
    assert len(got) == len({(r.l_id, r.r_id) for r in got}) == 1200


def test_empty_tables(spark):
    none = pts(spark, [], "l")
    assert P.within_distance(none, pts(spark, [(1, 1.0, 1.0)], "r"), 300.0, 1).count() == 0
    boxes = pts(spark, [], "r").withColumn("r_half_m", F.lit(1.0))
    assert P.inside_boxes(pts(spark, [(1, 1.0, 1.0)], "l"), boxes, 1).count() == 0


def test_inside_boxes_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    points = [(i, float(rng.uniform(46.9, 47.1)), float(rng.uniform(-51.1, -50.9))) for i in range(150)]
    boxes = [(i, float(rng.uniform(46.9, 47.1)), float(rng.uniform(-51.1, -50.9) + 360 * (i % 2)), float(rng.choice([0.0, 50, 700, 5000, 40000]))) for i in range(30)]
    df = spark.createDataFrame(boxes, "id bigint, lat double, lon double, half double")
    regions = P.points(df, F.col("id"), F.col("lat"), F.col("lon"), "r").join(df.select(F.col("id").alias("r_id"), F.col("half").alias("r_half_m")), "r_id")
    got = sorted((r.l_id, r.r_id) for r in P.inside_boxes(pts(spark, points, "l"), regions, 150).collect())
    want = []
    for p in points:
        for b in boxes:
            d = abs((p[2] - b[2] + 180) % 360 - 180)
            if R * math.radians(abs(p[1] - b[1])) <= b[3] and R * math.cos(math.radians(b[1])) * math.radians(d) <= b[3]:
                want.append((p[0], b[0]))
    assert got == sorted(want)
