import itertools
import math

import pytest
from pyspark.sql import functions as F

from pelorus.operators import evaluation as E


def best(pairs):
    """Most pairs, then the least distance, by trying all."""
    for n in range(min(len({f for f, _, _ in pairs}), len({t for _, t, _ in pairs})), 0, -1):
        fits = [c for c in itertools.combinations(pairs, n) if len({f for f, _, _ in c}) == len({t for _, t, _ in c}) == n]
        if fits:
            return min(fits, key=lambda c: sum(d for *_, d in c))
    return ()


def test_scores_match_anew_at_each_threshold(spark):
    features = [(1, 1, 0.9, True), (1, 2, 0.5, True), (1, 3, 0.5, False), (2, 4, 0.2, True)]
    pairs = [(1, 1, 10, 1.0), (1, 1, 11, 2.0), (1, 2, 10, 1.5), (2, 4, 12, 1.0)]
    f = spark.createDataFrame(features, "case_id bigint, feature_id bigint, score double, on_water boolean")
    t = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13)], "case_id bigint, truth_id bigint")
    p = spark.createDataFrame(pairs, "case_id bigint, feature_id bigint, truth_id bigint, distance_m double")
    c = spark.createDataFrame([(1, 2.0), (2, None), (3, 0.0)], "case_id bigint, water_km2 double")
    got = {(r.case_id, r.threshold): r for r in E.score_cases(f, t, p, c, [0.2, 0.5], 0.1).collect()}
    for (case, limit), r in got.items():
        kept = [x for x in features if x[0] == case and x[2] > limit]
        hit = best([(x, y, d) for k, x, y, d in pairs if k == case and x in {z[1] for z in kept}])
        assert (r.tp, r.fp) == (len(hit), len(kept) - len(hit))
    assert got[1, 0.2].tp == 2 and got[1, 0.5].tp == 1 and got[1, 0.5].fn == 1 and got[2, 0.2].fp == 0
    assert got[1, 0.2].alarms_km2 == 0 and got[2, 0.2].alarms_km2 is None and got[3, 0.2].alarms_km2 is None and got[3, 0.2].precision is None
    with pytest.raises(ValueError):
        E.score_cases(f, t, p, c, [0.05], 0.1)


def test_buffers_free_truths_for_others(spark):
    f = spark.createDataFrame([(1, 1, "water", 100.0), (1, 2, "water", 900.0), (1, 3, None, 50.0), (2, 4, "water", math.inf)], "case_id bigint, feature_id bigint, surface string, shore_m double")
    t = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "case_id bigint, truth_id bigint")
    p = spark.createDataFrame([(1, 1, 10, 1.0), (1, 2, 10, 5.0), (2, 4, 21, 1.0)], "case_id bigint, feature_id bigint, truth_id bigint, distance_m double")
    got = {(r.case_id, r.buffer_m): (r.features, r.raw, r.eligible, r.added_misses, r.measured) for r in E.buffer_sweep(f, t, p, [300.0, 1000.0, 300.0]).collect()}
    assert got == {(1, 300.0): (1, 1, 1, 0, False), (1, 1000.0): (0, 1, 0, 1, False), (2, 300.0): (1, 1, 1, 0, True), (2, 1000.0): (1, 1, 1, 0, True)}


def test_one_unknown_area_makes_the_sums_unknown(spark):
    c = spark.createDataFrame([("a", 1.0, 0.5, True), ("a", None, 0.5, True), ("b", 4.0, 1.0, True), ("b", 4.0, 3.0, False), (None, 1.0, 1.0, True)], "region string, water_km2 double, covered_km2 double, measured boolean")
    got = {(r.dimension, r.value): (r.cases, r.measured, r.share) for r in E.coverage_sums(c, ["region"]).collect()}
    assert got == {("all", ""): (5, 4, None), ("region", "a"): (2, 2, None), ("region", "b"): (2, 1, 0.125), ("region", "unknown"): (1, 1, 1.0)}


def test_thresholds_are_blocked_by_any_stratum_and_the_winner_has_most_recall(spark):
    rows = [(k, "x" if k < 10 else "y", t, 10 - d, d, w, 5.0) for k in range(20) for t, d, w in ((0.2, 0, 9), (0.4, 1, 1), (0.5, 1, 0), (0.6, 1, 0), (0.8, 6, 0))]
    m = spark.createDataFrame(rows, "case_id bigint, region string, threshold double, tp bigint, fn bigint, wet_alarms bigint, water_km2 double")
    got = {r.threshold: r for r in E.choose_threshold(m, ["region"], 50, 5, 0.7, 1.0).collect()}
    assert got[0.2].blockers == ["all::alarms", "region:x:alarms", "region:y:alarms"] and "region:x:recall" in got[0.8].blockers
    assert [t for t, r in got.items() if r.winner] == [0.5]
    assert all(not r.winner and "region:y:few_vessels" in r.blockers for r in E.choose_threshold(m, ["region"], 101, 5, 0.7, 1.0).collect())


def test_log_loss_is_clipped_and_nulls_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 1.0, False), ("a", None, True), ("a", 0.5, None)], "g string, p double, y boolean")
    r = E.binary_metrics(df, ["g"], F.col("p"), F.col("y")).first()
    assert r.n == 2 and r.tp == 1 and r.fp == 1 and abs(r.log_loss - (-math.log(1e-7) - math.log(1 - 1e-7)) / 2) < 1e-6
