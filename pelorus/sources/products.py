"""Readers of plans, annotations, labels, shorelines and training chips, and writers of reports and features.

Schemas are explicit; a document that can't be read is an error or a named row, never left out. Small documents of one file
(plans, annotations) are parsed on the executors, a file a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.functions.cleaning import finite, instant_us

#: Modes and polarizations of plans that are taken (fixed values of the format).
PLAN_MODE, PLAN_POLARIZATION, PLAN_SATELLITES = "IW", "DH", ("S1C", "S1D")
PLAN = "file string, satellite string, start string, stop string, orbit bigint, datatake string, ring array<struct<lon: double, lat: double>>, problem string"


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _plan_rows(name: str, text: bytes) -> Iterator[tuple]:
    for mark in (e for e in ElementTree.fromstring(text).iter() if _tag(e) == "Placemark"):
        data = {d.get("name"): "".join(d.itertext()).strip() for d in mark.iter() if _tag(d) == "Data"}
        if data.get("Mode") != PLAN_MODE or data.get("Polarisation") != PLAN_POLARIZATION or data.get("SatelliteId") not in PLAN_SATELLITES:
            continue
        ring, problem = None, None
        try:
            places = next(("".join(c.itertext()).split() for c in mark.iter() if _tag(c) == "coordinates"), [])
            ring = [(float(p.split(",")[0]), float(p.split(",")[1])) for p in places]
            if len(ring) < 4 or ring[0] != ring[-1]:
                problem = "ring"
            orbit, take = int(data["OrbitAbsolute"]), f"{int(data['DatatakeId'], 16):06X}"
        except (KeyError, ValueError, IndexError):
            orbit, take, problem = None, None, "fields"
        yield name, data.get("SatelliteId"), data.get("ObservationTimeStart"), data.get("ObservationTimeStop"), orbit, take, ring, problem


def plans(spark: SparkSession, path: str) -> DataFrame:
    """Observation plans in KML: file, satellite, start_us, stop_us, native_group, ring, problem of those of the mode taken.

    Instants without an offset are UTC. A plan that counts but can't be read, or doesn't start before it stops, is named in `problem`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, blob in zip(b["path"], b["content"], strict=True):
                try:
                    rows.extend(_plan_rows(name, blob))
                except ElementTree.ParseError:
                    rows.append((name, None, None, None, None, None, None, "file"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("file", "satellite", "start", "stop", "orbit", "datatake", "ring", "problem")])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PLAN)
    a, b = instant_us(F.col("start")), instant_us(F.col("stop"))
    group = F.concat_ws("_", "satellite", F.lpad(F.col("orbit").cast("string"), 6, "0"), "datatake")
    problem = F.coalesce("problem", F.when(~F.coalesce(a < b, F.lit(False)), "time"))
    return raw.select("file", "satellite", a.alias("start_us"), b.alias("stop_us"), F.when(F.col("datatake").isNotNull(), group).alias("native_group"), "ring", problem.alias("problem"))


ANNOTATION = "file string, mission string, product string, polarization string, start string, lines bigint, samples bigint, spacing_m double, points array<struct<col: double, row: double, lon: double, lat: double>>, problem string"


def _annotation(name: str, text: bytes) -> tuple:
    root = ElementTree.fromstring(text)
    one = lambda tag: next((e.text for e in root.iter() if _tag(e) == tag), None)
    points = []
    for g in (e for e in root.iter() if _tag(e) == "geolocationGridPoint"):
        v = {_tag(c): c.text for c in g}
        points.append((float(v["pixel"]), float(v["line"]), float(v["longitude"]), float(v["latitude"])))
    spacing = float(one("rangePixelSpacing") or "nan")
    problem = "points" if len(points) < 9 else "spacing" if not 0 < spacing < float("inf") else None
    n = lambda tag: int(one(tag)) if one(tag) else None
    return name, one("missionId"), one("productType"), one("polarisation"), one("startTime"), n("numberOfLines"), n("numberOfSamples"), spacing, points, problem


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Product annotations in XML: what they say, their ground control points, and what speaks against them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, blob in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append(_annotation(name, blob))
                except (ElementTree.ParseError, KeyError, TypeError, ValueError):
                    rows.append((name, *[None] * 8, "file"))
            yield pd.DataFrame(rows, columns=["file", "mission", "product", "polarization", "start", "lines", "samples", "spacing_m", "points", "problem"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ANNOTATION)
    return raw.withColumn("start_us", instant_us(F.col("start"))).drop("start")


CHIP = "id string, band_1 array<double>, band_2 array<double>, inc_angle string, is_iceberg int"


def training_chips(spark: SparkSession, path: str, size: int = 75) -> DataFrame:
    """Training chips of a JSON list: id, band_1, band_2, angle (null for "na"), label; each with what speaks against it in `problem`."""
    raw = spark.read.schema(CHIP).option("multiLine", True).json(path)
    sound = lambda b: F.coalesce((F.size(b) == size * size) & ~F.exists(b, lambda v: v.isNull() | F.isnan(v)), F.lit(False))
    angle = finite(F.col("inc_angle"))
    problem = (
        F.when(F.col("id").isNull(), "id").when(~sound("band_1") | ~sound("band_2"), "bands").when(angle.isNull() & (F.coalesce(F.trim("inc_angle"), F.lit("")) != "na"), "angle")
        .when(~F.coalesce(F.col("is_iceberg").isin(0, 1), F.lit(False)), "label")
    )
    return raw.select("id", "band_1", "band_2", angle.alias("angle"), F.col("is_iceberg").alias("label"), problem.alias("problem"))


def label_audit(labels: DataFrame, inside: Column) -> DataFrame:
    """One row per kind of label (is_vessel as text; empty: unknown): labels in all, and inside the region."""
    kind = F.coalesce(F.when(F.trim("is_vessel") != "", F.lower(F.trim("is_vessel"))), F.lit("unknown"))
    return labels.groupBy(kind.alias("kind")).agg(F.count("*").alias("labels"), F.count_if(inside).alias("inside"), F.countDistinct(F.when(inside, F.col("scene_id"))).alias("scenes"))


def crosswalk(index: DataFrame, images: DataFrame) -> DataFrame:
    """Index entries and images (id, origin, split) matched on both id and origin: id, origin, split, state.

    An id that both hold under different origins is a conflict, one that a side lacks is missing there.
    """
    i = index.select("id", F.col("origin").alias("_io"), F.lit(True).alias("_i"))
    m = images.select("id", F.col("origin").alias("_mo"), "split", F.lit(True).alias("_m"))
    j = i.join(m, "id", "full")
    state = F.when(F.col("_i").isNull(), "not_indexed").when(F.col("_m").isNull(), "no_image").when(~F.col("_io").eqNullSafe(F.col("_mo")), "conflict").otherwise("matched")
    return j.select("id", F.coalesce("_io", "_mo").alias("origin"), "split", state.alias("state"))


def polarization_pair(files: DataFrame) -> DataFrame:
    """Per product (product_id, name of a band's file) its co- and cross-polarised file: VV and VH before HH and HV, never a guess."""
    of = lambda p: F.max(F.when(F.lower("name").rlike(rf"[-_]{p}[-_.]"), F.col("name")))
    b = files.groupBy("product_id").agg(*[of(p).alias(p) for p in ("vv", "vh", "hh", "hv")])
    v, h = F.col("vv").isNotNull() & F.col("vh").isNotNull(), F.col("hh").isNotNull() & F.col("hv").isNotNull()
    return b.select(
        "product_id", F.when(v, F.col("vv")).when(h, F.col("hh")).alias("co"), F.when(v, F.col("vh")).when(h, F.col("hv")).alias("cross"), F.when(v, "VV+VH").when(h, "HH+HV").otherwise("unknown").alias("polarization")
    )


def coverage_sessions(events: DataFrame, session: str, t: str, start: float, stop: float) -> DataFrame:
    """Sessions whose first to last event meets [start, stop]: session, first, last, observations, state (partial if any was heard)."""
    s = events.groupBy(session).agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count_if(F.coalesce("accepted", F.lit(False)) & F.col(t).between(start, stop)).alias("observations"))
    return s.where((F.col("first") <= stop) & (F.col("last") >= start)).withColumn("state", F.when(F.col("observations") > 0, "partial").otherwise("unknown"))


def shoreline(spark: SparkSession, path: str, west: float, south: float, east: float, north: float, pad: float = 0.1) -> DataFrame:
    """Polygons (r_id, rings) of a GeoJSON collection, a feature a line or one document, that meet a box widened by `pad` degrees."""
    text = spark.read.text(path, wholetext=True).select("value")
    ring = "array<array<array<double>>>"
    feats = text.select(F.explode(F.coalesce(F.from_json("value", "features array<string>")["features"], F.split("value", "\n"))).alias("f"))
    g = feats.select(F.get_json_object("f", "$.geometry.type").alias("kind"), F.get_json_object("f", "$.geometry.coordinates").alias("c")).where("c is not null")
    polygons = F.when(F.col("kind") == "Polygon", F.array(F.from_json("c", ring))).when(F.col("kind") == "MultiPolygon", F.from_json("c", f"array<{ring}>"))
    each = g.select(F.explode(polygons).alias("p")).where("p is not null")
    rings = F.transform("p", lambda r: F.transform(r, lambda q: F.struct(q[0].alias("lon"), q[1].alias("lat"))))
    lons, lats = F.transform(F.flatten("p"), lambda q: q[0]), F.transform(F.flatten("p"), lambda q: q[1])
    meets = (F.array_max(lons) >= west - pad) & (F.array_min(lons) <= east + pad) & (F.array_max(lats) >= south - pad) & (F.array_min(lats) <= north + pad)
    return each.where(meets).select(F.xxhash64(F.to_json("p")).alias("r_id"), rings.alias("rings"))


def synthetic_scene(spark: SparkSession, vessels: int = 50, reporting: int = 40, side: int = 1000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A made-up scene for tests: pixels (row, col, co, cross) of bright vessels, and five reports of those that report around time 0."""
    import numpy as np

    rng = np.random.default_rng(seed)
    at = rng.choice(side * side, vessels, replace=False)
    px = [(int(k // side), int(k % side), 255, 180) if i % 2 == 0 else (int(k // side), int(k % side), 230, 150) for i, k in enumerate(at)]
    rows = []
    for i in range(min(reporting, vessels)):
        v, course = float(rng.uniform(2, 15)), float(rng.uniform(0, 360))
        for s in (-600, -300, 0, 300, 600):
            d = v * 1852 / 3600 * s / 111_195
            lat, lon = 47 + px[i][0] / side + d * np.cos(np.radians(course)), -52 + px[i][1] / side + d * np.sin(np.radians(course))
            rows.append((200_000_000 + i, float(s), float(lat), float(lon), v, course))
    return spark.createDataFrame(px, "row int, col int, co int, cross int"), spark.createDataFrame(rows, "user_id bigint, dt double, lat double, lon double, speed_knots double, course_deg double")


# ---- sinks ----


def polygon_features(rows: DataFrame, ring: str) -> DataFrame:
    """One GeoJSON polygon feature per row in `feature`: the ring closed and counter-clockwise, the other columns as properties.

    A ring without three different corners has a null geometry.
    """
    from pelorus.functions.radar import ring_area

    n = F.size(ring)
    closed = F.when(F.get(ring, F.lit(0)) == F.get(ring, n - 1), F.col(ring)).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    area = ring_area(F.transform(closed, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))))
    turned = F.when(area < 0, F.reverse(closed)).otherwise(closed)
    coordinates = F.array(F.transform(turned, lambda p: F.array(p["lon"], p["lat"])))
    sound = F.coalesce((F.size(F.array_distinct(ring)) >= 3) & (area != 0), F.lit(False))
    geometry = F.when(sound, F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")))
    rest = [c for c in rows.columns if c != ring]
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))
    return rows.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def write_features(features: DataFrame, path: str, subset: Column | None = None) -> None:
    """Features as lines of JSON; with a condition on a partition column the rows in and out of it lie in folders of their own."""
    if subset is None:
        features.select("feature").write.mode("overwrite").text(path)
    else:
        features.select("feature", F.when(subset, "inside").otherwise("outside").alias("part")).write.mode("overwrite").partitionBy("part").text(path)


def html_table(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A page with a table of at most `most` rows, a summary and no archive: more is an error, nothing is left out."""
    from html import escape

    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} rows")
    text = lambda v: "" if v is None else escape(str(v), quote=True)
    head = "".join(f"<th>{text(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{text(v)}</td>" for v in r) + "</tr>" for r in held)
    return f"<!doctype html><meta charset=utf-8><title>{text(title)}</title><h1>{text(title)}</h1><table><tr>{head}</tr>{body}</table>"


def embedded_json(value) -> str:
    """JSON that is safe inside a script element; NaN is refused."""
    out = json.dumps(value, ensure_ascii=False, allow_nan=False)
    return out.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
