"""Readers of report archives, journals, envelopes, sightings and features; every schema is explicit."""

from __future__ import annotations

import hashlib
import json
import os
import struct
import tempfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.functions.cleaning import course_deg, finite, speed_knots, utc, vessel_id

REPORT_CSV = "mmsi string, lat string, lon string, timestamp string, speed_knots string, course_deg string"
REPORT_CSV_WIDE = REPORT_CSV + ", source string, message_type string, timestamp_basis string, received_at string, position_accuracy string, ais_second string"
KINDS = ("PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport")


def report_csv(spark: SparkSession, paths: list[str], wide: bool = True) -> DataFrame:
    """Daily report files, narrow or wide, as typed reports; a narrow file's naive instants are UTC.

    Columns are found by the header's names; `raw_timestamp` keeps the text.
    """
    raw = spark.read.schema(REPORT_CSV_WIDE if wide else REPORT_CSV).option("header", True).option("enforceSchema", False).csv(paths)
    for c in ("source", "message_type", "timestamp_basis", "received_at", "position_accuracy", "ais_second"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    second = F.col("ais_second").try_cast("int")
    return raw.select(
        vessel_id(F.col("mmsi")).alias("user_id"), finite(F.col("lat")).alias("lat"), finite(F.col("lon")).alias("lon"),
        utc(F.col("timestamp"), allow_naive=not wide).alias("time_utc"), F.col("timestamp").alias("raw_timestamp"),
        speed_knots(F.col("speed_knots")).alias("speed_knots"), course_deg(F.col("course_deg")).alias("course_deg"),
        "source", "message_type", F.coalesce("timestamp_basis", F.lit(None if wide else "legacy_naive_utc")).alias("timestamp_basis"),
        utc(F.col("received_at")).alias("received_at"), F.lower("position_accuracy").try_cast("boolean").alias("position_accuracy"),
        F.when(second.between(0, 63), second).alias("ais_second"), F.col("_metadata.file_name").alias("file"),
    )


def day_files(folder: str, first_day: str, last_day: str) -> list[str]:
    """The daily files a window can touch: those of its days, in order."""
    days = set(np.arange(np.datetime64(first_day), np.datetime64(last_day) + 1).astype(str))
    return sorted(str(p) for p in Path(folder).glob("ais_stream_*.csv") if p.name[11:21] in days)


_BODY = "UserID bigint, Latitude double, Longitude double, Sog double, Cog double, Valid boolean, PositionAccuracy string, Timestamp int"
_META = "MMSI bigint, latitude double, longitude double, time_utc string"
_TYPED = _BODY.replace(" ", ": ").replace(",:", ",")
ENVELOPE = f"MessageType string, Message struct<{', '.join(f'{k}: struct<{_TYPED}>' for k in KINDS)}>"


def envelopes(lines: DataFrame, received_at: Column, text: str = "value") -> DataFrame:
    """Provider envelopes, a JSON document each, as reports; what isn't a valid position report is left out.

    A report more than a minute in the future of its receipt is left out; the past has no bound.
    """
    e = lines.withColumn("received_at", received_at).withColumn("e", F.from_json(text, ENVELOPE))
    kind = F.col("e.MessageType")
    body = F.coalesce(*[F.when(kind == k, F.col(f"e.Message.{k}")) for k in KINDS])
    # two spellings that differ in case only: found by path, as columns they would be one
    meta = F.coalesce(*[F.from_json(F.get_json_object(text, f"$.{k}"), _META) for k in ("MetaData", "Metadata")])
    rows = e.select("received_at", kind.alias("message_type"), body.alias("b"), meta.alias("m"))
    own = utc(F.col("m.time_utc"))
    second = F.col("b.Timestamp")
    out = rows.where("b is not null and coalesce(b.Valid, true)").select(
        vessel_id(F.coalesce("b.UserID", "m.MMSI")).alias("user_id"), F.round(F.coalesce("b.Latitude", "m.latitude"), 6).alias("lat"),
        F.round(F.coalesce("b.Longitude", "m.longitude"), 6).alias("lon"), F.coalesce(own, "received_at").alias("time_utc"),
        speed_knots(F.col("b.Sog")).alias("speed_knots"), course_deg(F.col("b.Cog")).alias("course_deg"), "message_type",
        F.when(own.isNull(), "receiver_clock").otherwise("provider_metadata_utc").alias("timestamp_basis"), "received_at",
        F.when(F.lower("b.PositionAccuracy").isin("true", "false"), F.lower("b.PositionAccuracy").try_cast("boolean")).alias("position_accuracy"),
        F.when(second.between(0, 63), second).alias("ais_second"),
    )
    placed = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.col("user_id").isNotNull()
    return out.where(placed & (F.unix_micros("time_utc") <= F.unix_micros("received_at") + 60_000_000))


JOURNAL = "event string, time string, connected boolean, permessage_deflate boolean, accepted boolean, compression_enabled boolean"


def journal(lines: DataFrame, text: str = "value") -> DataFrame:
    """Recorder journal lines; `malformed` ones have no event or no time."""
    e = lines.withColumn("j", F.from_json(text, JOURNAL)).select("*", "j.*").drop("j")
    at = utc(F.col("time"))
    return e.withColumn("at", at).withColumn("malformed", at.isNull() | F.col("event").isNull())


SIGHTING_COLUMNS = ("ICEBERG_YEAR", "ICEBERG_NUMBER", "SIGHTING_DATE", "SIGHTING_TIME", "SIGHTING_LATITUDE", "SIGHTING_LONGITUDE", "SIGHTING_METHOD", "SIZE", "SHAPE", "SOURCE")


def sightings(spark: SparkSession, paths: list[str], first_day: str = "2014-10-01") -> DataFrame:
    """Yearly sighting files with a `reason` for each row that is invalid, and the `scope` of valid ones out of the study.

    Headers may be broken over lines and spaced; times are four digits of which leading zeros may be lost. A row
    before the study is counted and valid.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("inferSchema", False).csv(paths)
    tidy = {c: "_".join(c.upper().split()) for c in raw.columns}
    raw = raw.select(*[F.col(f"`{c}`").cast("string").alias(t) for c, t in tidy.items()])
    for c in SIGHTING_COLUMNS:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    clock = F.lpad(F.trim("SIGHTING_TIME"), 4, "0")
    good_clock = clock.rlike(r"^([01]\d|2[0-3])[0-5]\d$") & (F.trim("SIGHTING_TIME") != "")
    at = F.try_to_timestamp(F.concat_ws(" ", F.trim("SIGHTING_DATE"), clock), F.lit("M/d/yyyy HHmm"))
    lat, lon = finite(F.col("SIGHTING_LATITUDE")), finite(F.col("SIGHTING_LONGITUDE"))
    out = raw.select(
        F.concat_ws(":", F.trim("ICEBERG_YEAR"), F.trim("ICEBERG_NUMBER")).alias("iceberg_id"), F.when(good_clock, at).alias("at"), lat.alias("lat"), lon.alias("lon"),
        F.trim("SIGHTING_METHOD").alias("method"), F.trim("SOURCE").alias("source"), F.trim("SIZE").alias("size"), F.trim("SHAPE").alias("shape"),
    )
    reason = F.when(F.col("at").isNull(), "time").when(lat_bad(F.col("lat")) | ~F.coalesce(F.col("lon").between(-180, 0), F.lit(False)), "position")
    early = F.when(reason.isNull() & (F.col("at") < F.lit(first_day).cast("timestamp")), "before_study")
    return out.withColumn("reason", reason).withColumn("scope", early)


def lat_bad(lat: Column) -> Column:
    return ~F.coalesce(lat.between(-90, 90), F.lit(False))


def features(spark: SparkSession, path: str) -> DataFrame:
    """The features of a GeoJSON collection: type, geometry and properties as JSON."""
    doc = spark.read.text(path, wholetext=True)
    schema = "type string, features array<string>"
    parsed = doc.select(F.from_json("value", schema).alias("d")).where("d.type = 'FeatureCollection'")
    each = parsed.select(F.posexplode("d.features").alias("n", "f"))
    return each.select(
        "n", F.get_json_object("f", "$.geometry.type").alias("geometry_type"), F.get_json_object("f", "$.geometry.coordinates").alias("coordinates"),
        F.get_json_object("f", "$.properties").alias("properties"),
    )


def strip_rasters(spark: SparkSession, path: str, rows_a_batch: int = 64) -> DataFrame:
    """Uncompressed or deflated 8- and 16-bit grey TIFF strips as long pixels: path, row, col, dn.

    A strip is read at a time, so that an image is never one row.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for name, blob in zip(batch["path"], batch["content"], strict=True):
                for top, block in tiff_strips(bytes(blob)):
                    for at in range(0, block.shape[0], rows_a_batch):
                        part = block[at : at + rows_a_batch]
                        r, c = np.indices(part.shape)
                        yield pd.DataFrame({"path": name, "row": (r + top + at).ravel(), "col": c.ravel(), "dn": part.ravel().astype("int32")})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, row int, col int, dn int")


def tiff_strips(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, pixels) of each strip of a baseline grey TIFF."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    magic, at = struct.unpack(order + "HI", data[2:8])
    if magic != 42:
        raise ValueError("not a baseline TIFF")
    size = {1: 1, 2: 1, 3: 2, 4: 4}
    tags: dict[int, tuple] = {}
    (n,) = struct.unpack_from(order + "H", data, at)
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in size:
            continue
        where = at + 2 + 12 * k + 8
        if size[kind] * count > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        tags[tag] = struct.unpack_from(order + {1: "B", 2: "B", 3: "H", 4: "I"}[kind] * count, data, where)
    width, height, bits = tags[256][0], tags[257][0], tags.get(258, (8,))[0]
    packing, strip_rows = tags.get(259, (1,))[0], tags.get(278, (height,))[0]
    if bits not in (8, 16) or packing not in (1, 8, 32946) or tags.get(277, (1,))[0] != 1:
        raise ValueError("unsupported TIFF")
    kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
    for k, (offset, count) in enumerate(zip(tags[273], tags[279], strict=True)):
        raw = data[offset : offset + count]
        raw = raw if packing == 1 else zlib.decompress(raw)
        rows = min(strip_rows, height - k * strip_rows)
        yield k * strip_rows, np.frombuffer(raw, kind, rows * width).reshape(rows, width)


def complete_lines(path: str, target: str, piece: int = 1 << 20) -> tuple[int, int, str]:
    """Copies a growing file up to its last line end, piece by piece: bytes copied, bytes left out, SHA-256 of the copy.

    Only what was there at the start is read; the copy is whole or not there.
    """
    size = os.path.getsize(path)
    end, at = 0, size
    with open(path, "rb") as f:
        while at and not end:  # the last line end, from the back
            start = max(0, at - piece)
            f.seek(start)
            k = f.read(at - start).rfind(b"\n")
            end, at = (start + k + 1 if k >= 0 else 0), start
        digest, left = hashlib.sha256(), end
        f.seek(0)
        with tempfile.NamedTemporaryFile("wb", dir=os.path.dirname(os.path.abspath(target)), delete=False) as out:
            while left:
                block = f.read(min(piece, left))
                digest.update(block)
                out.write(block)
                left -= len(block)
    os.replace(out.name, target)
    return end, size - end, digest.hexdigest()


def strip_window(path: str, col: int, row: int, size: int, most_bytes: int = 1 << 27) -> np.ndarray:
    """A square window of an uncompressed 16-bit grey TIFF: only its rows' bytes are read; beyond the image or the budget is an error."""
    with open(path, "rb") as f:
        head = f.read(8)
        order = {b"II": "<", b"MM": ">"}[head[:2]]
        magic, at = struct.unpack(order + "HI", head[2:8])
        if magic != 42:
            raise ValueError("not a baseline TIFF")
        f.seek(at)
        (n,) = struct.unpack(order + "H", f.read(2))
        entries = [struct.unpack(order + "HHI4s", f.read(12)) for _ in range(n)]

        def values(tag: int, default: tuple = ()) -> tuple:
            for t, kind, count, raw in entries:
                if t == tag:
                    code = {3: "H", 4: "I"}[kind]
                    if struct.calcsize(code) * count > 4:
                        f.seek(struct.unpack(order + "I", raw)[0])
                        raw = f.read(struct.calcsize(code) * count)
                    return struct.unpack(order + code * count, raw[: struct.calcsize(code) * count])
            return default

        (width,), (height,) = values(256), values(257)
        if values(258, (1,)) != (16,) or values(259, (1,)) != (1,) or values(277, (1,)) != (1,):
            raise ValueError("not an uncompressed 16-bit grey image")
        if col < 0 or row < 0 or col + size > width or row + size > height:
            raise ValueError("the window leaves the image")
        if 2 * size * size > most_bytes:
            raise ValueError("the window is over the budget")
        rows_a_strip, offsets = values(278, (height,))[0], values(273)
        out = np.empty((size, size), np.uint16)
        for k in range(size):
            strip, inside = divmod(row + k, rows_a_strip)
            f.seek(offsets[strip] + 2 * (inside * width + col))
            out[k] = np.frombuffer(f.read(2 * size), np.dtype(order + "u2"))
        return out


def report_days(spark: SparkSession, path: str, first_day: str, last_day: str) -> DataFrame:
    """Reports of write_days of a stretch of days: the folders of other days are not read."""
    return spark.read.parquet(path).where(F.col("date").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of a SQLite file that all executors can read, in stretches of row ids."""
    import sqlite3

    names = [c.split()[0] for c in schema.split(", ")]
    if not all(n.isidentifier() for n in (table, *names)):
        raise ValueError("names must be plain identifiers")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f"select min(rowid), max(rowid) from {table}").fetchone()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                for a, z in zip(b["a"], b["z"], strict=True):
                    held = db.execute(f"select {', '.join(names)} from {table} where rowid >= ? and rowid < ?", (int(a), int(z)))
                    while rows := held.fetchmany(20_000):
                        yield pd.DataFrame(rows, columns=names)

    if low is None:
        return spark.createDataFrame([], schema)
    step = (high - low) // parts + 1
    cuts = [(low + k * step, low + (k + 1) * step) for k in range(parts)]
    return spark.createDataFrame(cuts, "a bigint, z bigint").repartition(parts).mapInPandas(run, schema)


# ---- sinks ----


def write_json(path: str, value) -> None:
    """A JSON file that is whole or not there; NaN is refused."""
    text = json.dumps(value, ensure_ascii=False, allow_nan=False, indent=1, sort_keys=True)
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)


def append_csv(path: str, header: list[str], rows: list[list]) -> str:
    """Appends rows to a CSV file under its header; the file used.

    A file with another header is left as it is and the rows go to its _v2; if that has another too, it is an error.
    """
    import csv

    stem, dot, end = path.rpartition(".")
    for name in (path, f"{stem}_v2{dot}{end}"):
        there = os.path.exists(name) and os.path.getsize(name) > 0
        if there:
            with open(name, newline="", encoding="utf-8") as f:
                if next(csv.reader(f), None) != header:
                    continue
        with open(name, "a", newline="", encoding="utf-8") as f:
            out = csv.writer(f)
            if not there:
                out.writerow(header)
            out.writerows(rows)
        return name
    raise ValueError(f"{path} and its _v2 have other headers")


def write_days(reports: DataFrame, path: str, day_of: str = "time_utc") -> None:
    """Reports appended by UTC day of observation."""
    reports.withColumn("date", F.to_date(day_of)).write.mode("append").partitionBy("date").parquet(path)


PRIVATE = ("mmsi", "user_id", "support_user_id", "lon", "lat", "longitude", "latitude", "geometry", "coordinates")


def public(rows: DataFrame, allowed: list[str], private: tuple[str, ...] = PRIVATE) -> DataFrame:
    """Only the allowed columns; an allowed one that is private, or holds a private field, is an error."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    def names(t) -> Iterator[str]:
        if isinstance(t, StructType):
            for f in t.fields:
                yield f.name.lower()
                yield from names(f.dataType)
        elif isinstance(t, ArrayType):
            yield from names(t.elementType)
        elif isinstance(t, MapType):
            yield from names(t.valueType)

    out = rows.select(*allowed)
    found = sorted(set(names(out.schema)) & set(private))
    if found:
        raise ValueError(f"private fields: {found}")
    return out


def to_features(rows: DataFrame, lon: str, lat: str) -> DataFrame:
    """One GeoJSON point feature per row, in the column `feature`; properties are the other columns."""
    rest = [c for c in rows.columns if c not in (lon, lat)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("feature"))
