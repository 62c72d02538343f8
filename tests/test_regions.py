import numpy as np
from pyspark.sql import functions as F

from pelorus.operators import alignment, regions as R

POLYGONS = f"r_id bigint, rings {R.RING}"


def ring(*points):
    return [{"lon": float(a), "lat": float(b)} for a, b in points]


def frame(spark, rows):
    return spark.createDataFrame(rows, "l_id bigint, l_lat double, l_lon double")


def test_edges_holes_and_the_antimeridian(spark):
    square, hole = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((1, 1), (3, 1), (3, 3), (1, 3), (1, 1))
    over = ring((179.9, 10), (180.1, 10), (180.1, 10.1), (179.9, 10.1))
    polygons = spark.createDataFrame([(1, [square, hole]), (2, [over]), (3, None), (4, [ring((0, 0), (1, 1))])], POLYGONS)
    points = frame(spark, [(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 0.0, 2.0), (4, 4.0, 4.0), (5, 1.0, 2.0), (6, 4.000001, 2.0), (7, 10.05, 180.05), (8, 10.05, 180.2), (9, 10.0, 179.95)])
    got = sorted((r.l_id, r.r_id) for r in R.containing(points, polygons).collect())
    assert got == [(1, 1), (3, 1), (4, 1), (5, 1), (7, 2), (9, 2)]
    assert R.containing(points.limit(0), polygons).count() == 0
    assert R.containing(points, polygons.limit(0)).count() == 0


def test_random_polygons_equal_a_winding_count(spark):
    rng = np.random.default_rng(8)
    shapes = []
    for k in range(12):
        a = np.sort(rng.uniform(0, 2 * np.pi, 9))
        r = rng.uniform(0.02, 0.3)
        c = rng.uniform(-1, 1, 2)
        shapes.append((k, c[0] + r * np.cos(a), c[1] + r * np.sin(a)))
    polygons = spark.createDataFrame([(k, [ring(*zip(x, y, strict=True))]) for k, x, y in shapes], POLYGONS)
    pts = rng.uniform(-1.2, 1.2, (300, 2))
    points = frame(spark, [(i, float(p[1]), float(p[0] % 360)) for i, p in enumerate(pts)])
    got = {(r.l_id, r.r_id) for r in R.containing(points, polygons).collect()}
    want = set()
    for k, x, y in shapes:
        for i, p in enumerate(pts):
            t = np.arctan2(y - p[1], x - p[0])
            d = (np.diff(np.r_[t, t[0]]) + np.pi) % (2 * np.pi) - np.pi
            if abs(d.sum()) > 3:
                want.add((i, k))
    assert got == want


def test_shore(spark):
    land = spark.createDataFrame([(1, [ring((0, 0), (1, 0), (1, 1), (0, 1))])], POLYGONS)
    got = {r.l_id: r for r in R.shore(frame(spark, [(1, 0.5, 0.999), (2, 0.5, 1.01), (3, 0.5, 3.0), (4, 0.5, 1.0)]), land, 5000.0).collect()}
    assert got[1].surface == "land" and abs(got[1].shore_m + 111.2) < 1
    assert got[2].surface == "water" and abs(got[2].shore_m - 1111.9) < 2
    assert got[3].surface == "water" and got[3].shore_m is None
    assert got[4].surface == "land" and abs(got[4].shore_m) < 1e-6


def test_a_dear_pair_is_left_alone(spark):
    c = F.struct(F.lit(1e4).alias("ee"), F.lit(0.0).alias("en"), F.lit(1e4).alias("nn"))
    rows = [(1, 1, 1, 10.0, 0.0), (1, 2, 1, 5.0, 0.0), (1, 2, 2, 250.0, 0.0), (1, 3, 3, 400.0, 0.0), (1, 4, 4, 0.0, 2500.0)]
    pairs = spark.createDataFrame(rows, "scene_id bigint, target_id bigint, user_id bigint, east_m double, north_m double").withColumn("c", c)
    got = {(r.target_id, r.user_id): r.selected for r in alignment.uncertain_pairs(pairs).collect()}
    assert got == {(1, 1): True, (2, 1): False, (2, 2): True}
