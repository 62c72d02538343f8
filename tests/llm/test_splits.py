from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("pelorus.llm")
from pyspark.sql import functions as F  # noqa: E402

from pelorus.llm import splits as S  # noqa: E402


def brute(records):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for i, groups in records:
        for g in groups or []:
            if g:
                up[top(g)] = top(("r", i))
    sets = defaultdict(set)
    for i, _ in records:
        sets[top(("r", i))].add(i)
    return sorted(sorted(s) for s in sets.values())


def found(spark, records):
    df = spark.createDataFrame(records, "id bigint, g array<string>")
    sets = defaultdict(set)
    for r in S.components(df, "id", "g").collect():
        sets[r.component].add(r.id)
    return sorted(sorted(s) for s in sets.values())


def test_components_of_stars_chains_and_random_graphs(spark):
    rng = np.random.default_rng(5)
    star = [(i, ["hub", f"leaf{i}"]) for i in range(40)]
    chain = [(100 + i, [f"c{i}", f"c{i + 1}"]) for i in range(40)]
    loose = [(200 + i, [f"x{rng.integers(0, 60)}", f"x{rng.integers(0, 60)}"]) for i in range(25)]
    odd = [(300, None), (301, []), (302, [None, ""]), (303, ["solo"]), (304, ["c3"])]
    records = star + chain + loose + odd
    assert found(spark, records) == brute(records)


def test_records_without_links(spark):
    assert found(spark, [(1, ["a"]), (2, ["a"]), (3, ["b"])]) == [[1, 2], [3]]
    assert found(spark, []) == []


def test_shares_are_met_and_components_stay_whole(spark):
    sizes = [60, 20, 15] + [1] * 400 + [3] * 60
    df = spark.createDataFrame([(f"k{i}", s) for i, s in enumerate(sizes)], "component string, weight bigint")
    got = S.assign(df, {"train": 0.7, "validation": 0.15, "test": 0.15}).join(df, "component")
    rows = got.collect()
    assert len(rows) == len(sizes)
    total = defaultdict(float)
    for r in rows:
        total[r.split] += r.weight
    whole = sum(sizes)
    assert all(abs(total[k] / whole - v) < 0.01 for k, v in (("train", 0.7), ("validation", 0.15), ("test", 0.15)))
    assert S.assign(df.limit(0), {"train": 1.0}).count() == 0


def test_spellings_and_violations(spark):
    rows = [(1, "Train", " new_cell_-1_2", None), (2, "training", "NEW_CELL_-1_2", None), (3, "valid", "new cell -1 2+new_cell_-5_6", None), (4, None, "new_cell_-9_9", "s1a-005518-000285"), (5, "test", None, "S1A_005518_000285 ")]
    m = spark.createDataFrame(rows, "area_id bigint, split string, geo string, acq string")
    groups = F.concat(S.split_groups(F.col("geo"), "geo:"), F.array_compact(F.array(S.acquisition(F.col("acq"), F.lit(None).cast("string")))))
    labels = S.components(m.withColumn("g", groups), "area_id", "g")
    bad = S.violations(m, labels, "area_id", S.split_name(F.col("split")))
    assert sorted(r.area_id for r in bad.collect()) == [1, 2, 3]
    name = "S1C_IW_GRDH_1SDH_20170124T164353_20170124T164418_001899_000080_FC2A_COG.SAFE"
    one = spark.createDataFrame([(None, name)], "a string, p string").select(S.acquisition(F.col("a"), F.col("p")).alias("x")).first()
    assert one.x == "acq:S1C_001899_000080"
