import random

import numpy as np
from pyspark.sql import functions as F

from pelorus.operators import selection as S

RING = "array<struct<lon: double, lat: double>>"


def test_acquisitions_are_one_only_with_whole_equal_footprints(spark):
    ring, open_ = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (2.0, 2.0)]
    rows = [
        ("B", "n_COG", "s", 1, 2, ring, 1), ("a", "n", "s", 1, 2, ring, 2), ("c", "m", "s", 1, 3, ring, 3), ("d", "x", "t", 2, 2, ring, 4), ("e", "y", "t", 2, 2, ring, 5),
        ("f", "z", "u", 1, 2, open_, 6), ("g", "w", "u", 1, 2, open_, 7), ("h", "v", None, 1, 2, ring, 8), ("h ", "v2", None, 1, 2, None, 9),
    ]
    df = spark.createDataFrame(rows, f"id string, name string, slice string, start_us bigint, end_us bigint, ring {RING}, n int")
    got = {r.id: (r.name, r.aliases) for r in S.unique_acquisitions(df, "n").collect()}
    assert got == {"a": ("n", ["n", "n_COG"]), "c": ("m", None), "d": ("x", None), "e": ("y", None), "f": ("z", None), "g": ("w", None), "h": ("v2", None)}


def test_quantiles_equal_numpy_over_hot_groups_ties_and_single_rows(spark):
    r = random.Random(6)
    rows = [("hot", r.gauss(0, 50)) for _ in range(3000)] + [("ties", 2.0)] * 50 + [("one", -7.5), ("two", 1.0), ("two", 4.0), ("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(q.k, q.share): q.value for q in S.exact_quantiles(df, ["k"], "v", [0.0, 0.5, 0.95, 1.0], 1.0).collect()}
    for k in ("hot", "ties", "one", "two"):
        for p in (0.0, 0.5, 0.95, 1.0):
            assert np.isclose(got[k, p], np.quantile([v for g, v in rows if g == k], p))
    assert not any(k == "none" for k, _ in got)


def test_roles_and_locks(spark):
    near = spark.createDataFrame([(1, "train"), (1, "train"), (2, "train"), (2, "validation"), (3, "test"), (4, None)], "row_id bigint, split string")
    rows = spark.createDataFrame([(k, "g") for k in range(1, 6)], "row_id bigint, g string")
    got = {r.row_id: (r.role, r.problem) for r in S.inherited_roles(near, rows, F.lit("own")).collect()}
    assert got == {1: ("train", None), 2: (None, "near_several_splits"), 3: (None, "near_closed_split"), 4: ("own", None), 5: ("own", None)}
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, None)], "id int, g string, h string")
    locked = spark.createDataFrame([("a", "y"), (None, "x"), (None, None)], "g string, h string")
    assert [r.id for r in S.without_locked(df, locked, ["g", "h"]).collect()] == [3]


def test_precision_escaping_and_digests(spark):
    df = spark.createDataFrame([("12.340", '{"b": 1, "a": [1.0]}'), ("-7", '{"a":[1.0],"b":1}'), ("1e3", "nope"), (None, None)], "s string, j string")
    out = df.select(S.precision_step(F.col("s")).alias("p"), S.canonical_digest(F.col("j")).alias("d")).collect()
    assert [round(r.p, 6) if r.p else r.p for r in out] == [0.001, 1.0, None, None] and out[0].d == out[1].d and out[2].d is None and out[3].d is None
    assert spark.range(1).select(S.escaped(F.lit("<a href=\"x\">'&'</a>"))).first()[0] == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"


def test_groups_hold_only_if_every_row_does(spark):
    df = spark.createDataFrame([("a", True, 1), ("a", None, 1), ("b", True, 2)], "g string, ok boolean, n int")
    got = {r.g: (r.good, r.ready) for r in S.all_hold(df, "g", {"good": F.col("ok"), "some": F.col("n") > 0}).collect()}
    assert got == {"a": (False, False), "b": (True, True)}
    assert S.violations({"x": df.where("ok is null").select("g"), "y": df.where("n > 5").select("n")}).collect()[0].asDict() == {"rule": "x", "key": "a"}
