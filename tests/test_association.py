"""Vessels at scenes held against targets by cells: as by all pairs, wherever the cells end, and without a join."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelorus.functions import geodesy
from pelorus.functions.geo import haversine_m
from pelorus.operators import alignment, association
from pelorus.plans import survey_queries

T = 1483358400000000  # an hour's edge, in microseconds
CLEAN = "report_id bigint, user_id bigint, lat double, lon double, speed_knots double, course_deg double, time_utc timestamp"
RAW = "report_id bigint, user_id bigint, latitude double, longitude double, time_utc timestamp, received_at timestamp, sog double, cog double, message_type string, timestamp_basis string"


@pytest.fixture(scope="module", params=[(47.0, 0.0), (89.99, 10.0)], ids=["corner", "pole"])
def tables(spark, request):
    """Vessels crowded about a corner of cells (or a pole), some silent for long or of unknown motion; a scene of two instants, targets of one id."""
    rng = np.random.default_rng(5)
    la, lo = request.param
    wide = 1.0 if la < 80 else 60.0
    at = lambda us: dt.datetime.fromtimestamp(0, dt.UTC) + dt.timedelta(microseconds=T + int(us))
    rows = []
    for u in range(30):
        y, x = la + rng.normal(0, 0.004), lo + rng.normal(0, 0.006) * wide
        for s in np.sort(rng.integers(-900, 900, 14)):
            fast = None if u % 7 == 0 else float(rng.uniform(0, 20))
            rows.append((len(rows), u, min(90.0, y + rng.normal(0, 1e-4)), x + rng.normal(0, 1e-4), fast, float(rng.uniform(0, 360)), at(s * 1_000_000)))
    rows += [(9000, 50, la, lo, 5.0, 10.0, at(0)), (9001, 50, la - 1.0, lo, 5.0, 10.0, at(0))]  # in two places
    scenes = [(k, T + int(s) * 1_000_000) for k, s in enumerate(rng.integers(-900, 900, 12))] + [(3, T + 77_000_000), (20, T)]
    targets = [(k, min(90.0, la + rng.normal(0, 0.006)), lo + rng.normal(0, 0.009) * wide) for k in range(90)] + [(5, la, lo), (91, 10.0, 10.0)]
    return spark.createDataFrame(scenes, "scene_id bigint, at_us bigint"), spark.createDataFrame(rows, CLEAN), spark.createDataFrame(targets, "target_id bigint, lat double, lon double")


def all_pairs(scenes, reports, targets):
    c = alignment.covariance(F.col("speed_m_s"), F.col("course_deg"), F.col("report_age_s"))
    v = alignment.aligned(scenes, reports).select("scene_id", "user_id", c.alias("c"), F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"), "uncertainty_m")
    lat, lon = F.col("lat"), F.pmod(F.col("lon"), F.lit(360.0))
    scale = geodesy.local_distance_m(lat, F.lit(0.0), lat, F.lit(1.0))
    east = (F.pmod(lon - F.col("v_lon") + 180.0, F.lit(360.0)) - 180.0) * scale
    north = F.signum(lat - F.col("v_lat")) * geodesy.local_distance_m(F.col("v_lat"), F.lit(0.0), lat, F.lit(0.0))
    near = haversine_m(lat, lon, F.col("v_lat"), F.col("v_lon"))
    pairs = v.crossJoin(targets).select("scene_id", "target_id", "user_id", east.alias("east_m"), north.alias("north_m"), "c", near.alias("near_m"), "uncertainty_m")
    return alignment.priced(pairs.where(F.col("near_m") <= alignment.GATE_M * 1.01))


def test_uncertain_pairs_as_among_all(tables, monkeypatch):
    monkeypatch.setattr(association, "PAIRS", 50)
    monkeypatch.setattr(association, "TRACKS", 20)
    keys = ["scene_id", "target_id", "user_id"]
    rows = all_pairs(*tables).where("cost is not null").drop("c", "near_m", "uncertainty_m")
    want = sorted(alignment.one_to_one(rows, ["scene_id"], "target_id", "user_id", "cost", alignment.ABSTAIN).select(*keys, "selected", "cost").collect())
    found = association.uncertain_pairs(*tables)
    got = sorted(found.select(*keys, "selected", "cost").collect())
    assert len(want) > 200 and [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g.cost for g in got], [w.cost for w in want])
    assert found.columns == [*keys, "east_m", "north_m", "d2", "distance_m", "cost", "selected"]


def test_comparison_as_among_all(tables):
    pairs = all_pairs(*tables)
    one = pairs.where(F.col("near_m") <= F.col("uncertainty_m") + 500.0)
    one = alignment.one_to_one(one.drop("c"), ["scene_id"], "target_id", "user_id", "near_m")
    two = alignment.one_to_one(pairs.where("cost is not null").drop("c"), ["scene_id"], "target_id", "user_id", "cost", alignment.ABSTAIN)
    want = {r.state: r["count"] for r in alignment.compared_choices(one, two).groupBy("state").count().collect()}
    assert {r.state: r.targets for r in association.compared(*tables).collect()} == want and len(want) >= 3


def test_a_best_choice_is_settled_or_left_whole():
    rng = np.random.default_rng(6)
    for alone in (None, 20.0):
        for _ in range(200):
            code = np.unique(rng.integers(0, 36, 14))
            left, right, cost = code // 6, code % 6, rng.integers(1, 19, len(code)) + rng.random(len(code))
            none = np.zeros(len(code), bool)
            took, rest = association.settle(left, right, cost, left, none, none)
            rest = np.flatnonzero(rest)
            took[rest[alignment.best_pairs(left[rest], right[rest], cost[rest], alone)]] = True
            assert np.flatnonzero(took).tolist() == alignment.best_pairs(left, right, cost, alone).tolist()


@pytest.mark.parametrize("name", ["matcher_comparison", "scene_uncertain_pairs"])
def test_pairs_are_made_where_they_meet(spark, name):
    m = spark.createDataFrame([(1, "2017-01-02T12:00:00Z")], "area_id bigint, reference_midpoint_utc string")
    a = spark.createDataFrame([(1, [-51.0, 47.0])], "annotation_id bigint, coordinates array<double>")
    plan = getattr(survey_queries, name)(m, spark.createDataFrame([], RAW), a)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan  # each vessel at each scene was moved to join all targets of nine cells about
