import datetime as dt

import numpy as np
import pytest

pytest.importorskip("pelorus.llm")
from pyspark.sql import functions as F  # noqa: E402

from pelorus.llm import nearest_time as N  # noqa: E402

SCHEMA = "entity bigint, t bigint, id bigint, extra string"


def brute(left, right, tolerance):
    out = []
    for e, t, i, _ in left:
        near = [(abs(rt - t), rt, ri) for re, rt, ri, _ in right if re == e and e is not None and rt is not None and t is not None and abs(rt - t) <= tolerance]
        if near and i is not None:
            out.append((i, min(near)[2]))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(spark, tmp_path, name, rows, parts=1):
    """The rows as a stream over that many files."""
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / name))


def test_replay_equals_brute_force_on_shuffled_rows(spark):
    rng = np.random.default_rng(4)
    right = [(int(rng.integers(1, 5)), int(rng.integers(0, 40_000) * 500_000), i, "x") for i in range(600)]
    right += [(9, 5_000_000, 2000 - i, "x") for i in range(300)]  # a hot entity, ties in time
    left = [(int(rng.integers(1, 6)), int(rng.integers(0, 40_000) * 500_000), 10_000 + i, "x") for i in range(80)]
    left += [(9, 5_000_000, 1, "x"), (9, 6_000_000, 2, "x"), (9, 7_000_001, 3, "x"), (None, 5_000_000, 4, "x"), (9, None, 5, "x")]
    right += [(None, 1, 7, "x"), (9, None, 8, "x")]
    rng.shuffle(right)
    right = [tuple(r) for r in right]
    right = [(None if r[0] is None else int(r[0]), None if r[1] is None else int(r[1]), int(r[2]), "x") for r in right]
    seen = []
    out = N.replay(table(spark, left).repartition(2), table(spark, right).repartition(3), 2.0, slice_s=10, shards=4, triggers=5, seen=seen)
    assert sorted((r.left_id, r.right_id) for r in out.collect()) == brute(left, right, 2_000_000)
    # every stretch of time was a trigger of its own, whose rows the next ones saw evicted
    assert [k for k, p in seen if p["numInputRows"]] == [0, 1, 2, 3, 4, 5]
    assert all(p["stateOperators"][0]["numRowsDroppedByWatermark"] == 0 for _, p in seen)
    assert seen[-1][1]["stateOperators"][0]["numRowsTotal"] <= 1


def test_pairs_come_out_before_the_end(spark, monkeypatch):
    monkeypatch.setattr(N, "END_US", 1)  # a marker that moves nothing: what comes out, the data's watermark let out
    s = 1_000_000
    left = [(1, k * 100 * s, k, "x") for k in range(40)]
    out = N.replay(table(spark, left), table(spark, [(e, t + s, 1000 + i, x) for e, t, i, x in left]), 5.0, triggers=4)
    assert sorted(r.left_id for r in out.collect()) == list(range(39))


def test_equally_near_takes_the_earlier_and_the_tolerance_is_inclusive(spark):
    left, right = [(1, 10_000_000, 1, "x")], [(1, 9_000_000, 5, "x"), (1, 11_000_000, 4, "x")]
    out = N.replay(table(spark, left), table(spark, right), 1.0).collect()
    assert [(r.right_id, r.offset_us) for r in out] == [(5, -1_000_000)]
    assert N.nearest(np.array([[1], [0], [1]]), np.array([[1], [1_000_001], [2]]), 1_000_000).empty


def test_rows_come_out_as_the_watermark_passes_over_several_triggers(spark, tmp_path):
    """Each file is a trigger: the first left row is out before the last file is read, the state is evicted."""
    s = 1_000_000
    spark.createDataFrame([(1, 100 * s, 1, "x"), (1, 4000 * s, 2, "x")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "l"))
    for k, t in enumerate((101, 3000, 3999, 9000)):
        spark.createDataFrame([(1, t * s, 50 + k, "x")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    left = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "l"))
    right = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))
    seen = []
    running = N.nearest_join(left, right, 5.0, "5000 seconds", shards=2).writeStream.foreachBatch(
        lambda df, n: seen.extend((n, r.left_id, r.right_id) for r in df.collect())
    ).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    running.awaitTermination()
    assert [(a, b) for _, a, b in seen] == [(1, 50)]  # 4000 s is open still: the watermark stands at 4000


def test_empty_sides(spark):
    assert N.replay(table(spark, [(1, 1, 1, "x")]), table(spark, []), 1.0).count() == 0
    assert N.replay(table(spark, []), table(spark, []), 1.0).count() == 0


def test_instants_and_vessel_numbers_in_all_spellings(spark):
    rows = [
        ("2017-01-23T21:15:47.457188+00:00", 1485206147457188), ("2017-01-17T10:42:29.494639Z", 1484649749494639),
        ("2017-01-27T12:06:23.491803-02:30", 1485527783491803), ("2017-01-26 02:45:12.734762 +0000 UTC", 1485398712734762),
        ("2017-01-05T23:41:40.084406", 1483659700084406), ("1485284516.541869", 1485284516541869), ("unknown", None), ("", None), (None, None),
        ("2017-13-45T00:00:00Z", None),
    ]
    got = spark.createDataFrame(rows, "s string, want bigint").select(N.instant_us(F.col("s")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert dt.datetime.fromtimestamp(1485206147, dt.UTC).day == 23
    numbers = [("120326612", 120326612), ("MMSI 120077049", 120077049), (" 120053214 ", 120053214), ("120188421.0", 120188421), ("120 269 002", 120269002), ("0", None), ("n/a", None), ("12032661", None), (None, None)]
    got = spark.createDataFrame(numbers, "s string, want bigint").select(N.vessel_number(F.col("s")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
