import datetime as dt
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelorus.sources import archive as A
from pelorus.streaming import recorder as R


def test_report_files_wide_and_narrow(spark, tmp_path):
    (tmp_path / "ais_stream_2017-01-02.csv").write_text(
        "mmsi,lat,lon,timestamp,speed_knots,course_deg\n123456789,47.1,-51.2,2017-01-02T01:00:00,102.2,360\n12345678,47,-51,2017-01-02T01:00:00,1,1\n123456789.0,,x,bad,,\n"
    )
    rows = A.report_csv(spark, A.day_files(str(tmp_path), "2017-01-01", "2017-01-02"), wide=False).orderBy("raw_timestamp", F.desc("user_id")).collect()
    assert [r.user_id for r in rows] == [123456789, None, 123456789]
    assert rows[0].speed_knots is None and rows[0].course_deg is None and rows[0].time_utc == dt.datetime(2017, 1, 2, 1)
    assert rows[2].time_utc is None and rows[2].lat is None and rows[0].timestamp_basis == "legacy_naive_utc"
    assert A.day_files(str(tmp_path), "2017-01-03", "2017-01-04") == []
    (tmp_path / "w.csv").write_text(
        "mmsi,lat,lon,timestamp,speed_knots,course_deg,source,message_type,timestamp_basis,received_at,position_accuracy,ais_second\n"
        "123456789,47.1,-51.2,2017-01-02T01:00:00-02:30,5,6,s,PositionReport,b,2017-01-02T03:30:01Z,True,61\n123456789,47.1,-51.2,2017-01-02T01:00:00,5,6,s,PositionReport,b,,,99\n"
    )
    rows = A.report_csv(spark, [str(tmp_path / "w.csv")]).orderBy(F.desc("time_utc")).collect()
    assert rows[0].time_utc == dt.datetime(2017, 1, 2, 3, 30) and rows[0].position_accuracy and rows[0].ais_second == 61
    assert rows[1].time_utc is None and rows[1].ais_second is None


def envelope(kind="PositionReport", meta="MetaData", when="2017-01-02 01:00:00.5 +0000 UTC", **body):
    body = {"UserID": 123456789, "Latitude": 47.12345678, "Longitude": -51.0, "Sog": 5.0, "Cog": 360.0, "Valid": True, "PositionAccuracy": True, "Timestamp": 61} | body
    return json.dumps({"MessageType": kind, "Message": {kind: body}, meta: {"MMSI": 123456789, "latitude": 1.0, "longitude": 2.0, "time_utc": when}})


def test_envelopes(spark):
    lines = [
        envelope(), envelope("StandardClassBPositionReport", "Metadata", Latitude=None), envelope("ShipStaticData"), envelope(Valid=False),
        envelope(when="2017-01-02 01:05:00 +0000 UTC"), envelope(UserID=5), envelope(PositionAccuracy=1, Timestamp=64, when=None), "{broken", None,
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = A.envelopes(df, F.lit("2017-01-02T01:01:00Z").cast("timestamp")).collect()
    assert len(rows) == 3
    first, second, third = rows
    assert (first.lat, first.course_deg, first.position_accuracy, first.ais_second) == (47.123457, None, True, 61)
    assert second.lat == 1.0 and second.message_type.startswith("Standard")
    assert third.timestamp_basis == "receiver_clock" and third.position_accuracy is None and third.ais_second is None


def test_journal_sightings_and_features(spark, tmp_path):
    j = spark.createDataFrame([('{"event":"open","time":"2017-01-02T00:00:00Z","connected":true}',), ("{oops",), ('{"event":"x"}',)], "value string")
    assert [r.malformed for r in A.journal(j).collect()] == [False, True, True]
    (tmp_path / "s.csv").write_text(
        '"ICEBERG\nYEAR",ICEBERG NUMBER,SIGHTING DATE,SIGHTING TIME,SIGHTING LATITUDE,SIGHTING LONGITUDE,SIGHTING METHOD,SIZE,SHAPE,SOURCE\n'
        "2017,12,1/2/2017,930,48.5,-50.5,R/V,MED,DRY,SAT\n2017,13,1/2/2017,2460,48.5,-50.5,,,,\n2017,14,1/2/2017,,48.5,-50.5,,,,\n2017,15,1/2/2017,0100,48.5,50.5,,,,\n2010,1,1/2/2010,0100,48.5,-50.5,,,,\n"
    )
    got = {r.iceberg_id: (r.reason, r.scope) for r in A.sightings(spark, [str(tmp_path / "s.csv")]).collect()}
    assert got == {"2017:12": (None, None), "2017:13": ("time", None), "2017:14": ("time", None), "2017:15": ("position", None), "2010:1": (None, "before_study")}
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"a": 1}}]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc))
    assert A.features(spark, str(tmp_path / "f.geojson")).first().geometry_type == "Point"


def test_strips_and_sinks(spark, tmp_path):
    pixels = np.arange(12, dtype="<u2").reshape(3, 4)
    head = struct.pack("<2sHI", b"II", 42, 8 + pixels.nbytes)
    tags = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 3, 1, 3), (279, 4, 1, pixels.nbytes)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    (tmp_path / "a.tif").write_bytes(head + pixels.tobytes() + ifd)
    rows = A.strip_rasters(spark, str(tmp_path / "a.tif")).collect()
    assert sorted((r.row, r.col, r.dn) for r in rows) == [(i // 4, i % 4, i) for i in range(12)]
    (tmp_path / "log").write_bytes(b"a\nb\nhalf")
    import hashlib

    assert A.complete_lines(str(tmp_path / "log"), str(tmp_path / "copy"), 3) == (4, 4, hashlib.sha256(b"a\nb\n").hexdigest())
    assert (tmp_path / "copy").read_bytes() == b"a\nb\n"
    (tmp_path / "open").write_bytes(b"no end")
    assert A.complete_lines(str(tmp_path / "open"), str(tmp_path / "copy"))[:2] == (0, 6) and (tmp_path / "copy").read_bytes() == b""
    A.write_json(str(tmp_path / "x.json"), {"a": 1})
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": 1}
    with pytest.raises(ValueError):
        A.write_json(str(tmp_path / "y.json"), float("nan"))
    assert not (tmp_path / "y.json").exists()
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, lon double, lat double")
    assert A.public(df, ["id"]).columns == ["id"]
    with pytest.raises(ValueError):
        A.public(df.select("id", F.struct("lon").alias("s")), ["id", "s"])
    assert json.loads(A.to_features(df, "lon", "lat").first().feature)["geometry"]["coordinates"] == [2.0, 3.0]


def test_recorder_streams(spark, tmp_path):
    schema = "value string, received_at timestamp"
    at = dt.datetime(2017, 1, 2, 1, 0, 30, tzinfo=dt.UTC)
    rows = [(envelope(), at), (envelope(), at), (envelope(when="2017-01-03 02:00:00 +0000 UTC"), at + dt.timedelta(days=1, hours=1))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    R.to_days(R.reports(lines), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(str(r.date) for r in got.collect()) == ["2017-01-02", "2017-01-03"]


def test_streamed_silences(spark, tmp_path):
    t = dt.datetime(2017, 1, 2, tzinfo=dt.UTC)
    minutes = [[0, 1, 30], [2, 31, 200], [900]]
    for k, m in enumerate(minutes):
        spark.createDataFrame([("s", t + dt.timedelta(minutes=x)) for x in m], "session string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
    stream = spark.readStream.schema("session string, at timestamp").parquet(str(tmp_path / "b"))
    seen = []
    R.silences(stream, 600.0).writeStream.foreachBatch(lambda df, _: seen.extend(r.seconds / 60 for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [28.0, 169.0]


def test_windows_of_strips_read_no_more_than_they_hold(tmp_path):
    import struct

    import numpy as np

    pixels = np.arange(7 * 9, dtype="<u2").reshape(7, 9)
    strips = [pixels[k : k + 2].tobytes() for k in range(0, 7, 2)]
    at, offsets = 8, []
    for x in strips:
        offsets.append(at)
        at += len(x)
    lists = struct.pack("<4I", *offsets)
    tags = [(256, 3, 1, 9), (257, 3, 1, 7), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 4, at), (277, 3, 1, 1), (278, 3, 1, 2), (279, 4, 4, at)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    path = tmp_path / "w.tif"
    path.write_bytes(struct.pack("<2sHI", b"II", 42, at + len(lists)) + b"".join(strips) + lists + ifd)
    assert (A.strip_window(str(path), 3, 2, 4) == pixels[2:6, 3:7]).all()
    for bad in ((6, 0, 4), (-1, 0, 2), (0, 5, 3)):
        with pytest.raises(ValueError):
            A.strip_window(str(path), *bad)
    with pytest.raises(ValueError):
        A.strip_window(str(path), 0, 0, 4, most_bytes=8)


def test_appending_keeps_to_the_header_or_goes_to_a_second_file(tmp_path):
    path = str(tmp_path / "d.csv")
    assert A.append_csv(path, ["a", "b"], [[1, "x,y"]]) == path and A.append_csv(path, ["a", "b"], [[2, None]]) == path
    assert A.append_csv(path, ["a", "b", "c"], [[3, 4, 5]]).endswith("d_v2.csv")
    assert (tmp_path / "d.csv").read_text().splitlines() == ["a,b", '1,"x,y"', "2,"]
    with pytest.raises(ValueError):
        A.append_csv(path, ["z"], [[1]])


def test_days_and_sqlite_tables(spark, tmp_path):
    import datetime as dt
    import sqlite3

    rows = [(k, dt.datetime(2017, 1, 1 + k, 23, tzinfo=dt.UTC)) for k in range(5)]
    A.write_days(spark.createDataFrame(rows, "report_id bigint, time_utc timestamp"), str(tmp_path / "days"))
    held = A.report_days(spark, str(tmp_path / "days"), "2017-01-02", "2017-01-03")
    assert sorted(r.report_id for r in held.collect()) == [1, 2] and "PartitionFilters: [isnotnull(date" in held._jdf.queryExecution().toString()
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("create table t (id integer, name text)")
        db.executemany("insert into t values (?, ?)", [(k, None if k % 7 == 0 else f"n{k}") for k in range(100)])
        db.execute("create table e (id integer)")
    db.close()
    got = A.sqlite_table(spark, str(tmp_path / "x.db"), "t", "id bigint, name string", 3)
    assert sorted((r.id, r.name) for r in got.collect()) == [(k, None if k % 7 == 0 else f"n{k}") for k in range(100)]
    assert A.sqlite_table(spark, str(tmp_path / "x.db"), "e", "id bigint").count() == 0
