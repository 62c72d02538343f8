import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelorus.functions import geodesy, register
from pelorus.sources import products as P

PLACE = """<Placemark><ExtendedData><Data name="SatelliteId"><value>{sat}</value></Data><Data name="Mode"><value>{mode}</value></Data>
<Data name="Polarisation"><value>DH</value></Data><Data name="ObservationTimeStart"><value>{a}</value></Data><Data name="ObservationTimeStop"><value>{b}</value></Data>
<Data name="OrbitAbsolute"><value>{orbit}</value></Data><Data name="DatatakeId"><value>{take}</value></Data></ExtendedData>
<LinearRing><coordinates>{ring}</coordinates></LinearRing></Placemark>"""
SQUARE = "-52,47,0 -51,47,0 -51,48,0 -52,47,0"


def test_plans_keep_what_counts_and_name_what_is_broken(spark, tmp_path):
    one = lambda **k: PLACE.format(**({"sat": "S1C", "mode": "IW", "a": "2026-01-02T03:04:05", "b": "2026-01-02T03:05:05", "orbit": "123", "take": "ab", "ring": SQUARE} | k))
    marks = one() + one(mode="EW") + one(sat="S1A") + one(orbit="x") + one(b="2026-01-02T03:04:05") + one(ring="-52,47 -51,47 -51,48 -50,47")
    (tmp_path / "a.kml").write_text(f'<kml xmlns="http://www.opengis.net/kml/2.2"><Document>{marks}</Document></kml>')
    (tmp_path / "b.kml").write_text("<kml>")
    got = P.plans(spark, str(tmp_path)).collect()
    assert sorted(str(r.problem) for r in got) == ["None", "fields", "file", "ring", "time"]
    (whole,) = [r for r in got if r.problem is None]
    assert whole.native_group == "S1C_000123_0000AB" and whole.stop_us - whole.start_us == 60_000_000 and len(whole.ring) == 4


def test_annotations(spark, tmp_path):
    point = "<geolocationGridPoint><line>{0}</line><pixel>{0}</pixel><latitude>47</latitude><longitude>-52</longitude></geolocationGridPoint>"
    doc = "<product><missionId>S1A</missionId><polarisation>VV</polarisation><startTime>2017-01-02T00:00:00.5</startTime><numberOfLines>10</numberOfLines><rangePixelSpacing>{s}</rangePixelSpacing>{p}</product>"
    for name, n, s in (("a", 9, "10.0"), ("b", 8, "10.0"), ("c", 9, "nan")):
        (tmp_path / f"{name}.xml").write_text(doc.format(s=s, p="".join(point.format(k) for k in range(n))))
    (tmp_path / "d.xml").write_text("<product")
    got = {r.file[-5]: r for r in P.annotations(spark, str(tmp_path)).collect()}
    assert [got[k].problem for k in "abcd"] == [None, "points", "spacing", "file"] and got["a"].lines == 10 and got["a"].points[3].col == 3.0 and got["a"].start_us == 1483315200500000


def test_training_chips(spark, tmp_path):
    ok = {"id": "a", "band_1": [1.0] * 4, "band_2": [2.0] * 4, "inc_angle": 33.5, "is_iceberg": 1}
    docs = [ok, ok | {"id": "b", "inc_angle": "na", "is_iceberg": 0}, ok | {"id": "c", "band_2": [1.0]}, ok | {"id": "d", "inc_angle": "x"}, ok | {"id": "e", "is_iceberg": None}]
    (tmp_path / "t.json").write_text(json.dumps(docs))
    got = {r.id: (r.angle, r.problem) for r in P.training_chips(spark, str(tmp_path / "t.json"), 2).collect()}
    assert got == {"a": (33.5, None), "b": (None, None), "c": (33.5, "bands"), "d": (None, "angle"), "e": (33.5, "label")}


def test_labels_crosswalk_bands_and_sessions(spark):
    labels = spark.createDataFrame([("True", "s", 1.0), ("", "s", 1.0), (None, "t", 9.0), ("true ", "u", 9.0)], "is_vessel string, scene_id string, x double")
    assert {r.kind: (r.labels, r.inside, r.scenes) for r in P.label_audit(labels, F.col("x") < 5).collect()} == {"true": (2, 1, 1), "unknown": (2, 1, 1)}
    index = spark.createDataFrame([("a", "o"), ("b", "o"), ("c", "o")], "id string, origin string")
    images = spark.createDataFrame([("a", "o", "train"), ("b", "p", "test"), ("d", "o", None)], "id string, origin string, split string")
    assert {r.id: r.state for r in P.crosswalk(index, images).collect()} == {"a": "matched", "b": "conflict", "c": "no_image", "d": "not_indexed"}
    files = spark.createDataFrame([("p", "x-vv-1.tiff"), ("p", "x-vh-1.tiff"), ("p", "x-hh-1.tiff"), ("q", "x_HH_1.tif"), ("q", "x_hv_1.tif"), ("r", "x-vv-1.tiff")], "product_id string, name string")
    got = {r.product_id: (r.co, r.cross, r.polarization) for r in P.polarization_pair(files).collect()}
    assert got == {"p": ("x-vv-1.tiff", "x-vh-1.tiff", "VV+VH"), "q": ("x_HH_1.tif", "x_hv_1.tif", "HH+HV"), "r": (None, None, "unknown")}
    events = spark.createDataFrame([("a", 1.0, True), ("a", 9.0, None), ("b", 11.0, True), ("c", 4.0, False)], "s string, t double, accepted boolean")
    assert {r.s: r.state for r in P.coverage_sessions(events, "s", "t", 0.0, 10.0).collect()} == {"a": "partial", "c": "unknown"}


def test_shorelines_are_cut_to_the_padded_box(spark, tmp_path):
    square = lambda x: [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 0]]]
    feats = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square(0)}}, {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [square(5), square(2.05)]}}, {"type": "Feature", "geometry": None}]
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    got = P.shoreline(spark, str(tmp_path / "c.geojson"), 1.5, 0.0, 2.0, 1.0).collect()
    assert [r.rings[0][0].lon for r in got] == [2.05]


def test_features_are_closed_and_counter_clockwise(spark, tmp_path):
    rows = [(1, [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]), (2, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), (3, [(0.0, 0.0), (1.0, 0.0)]), (4, None)]
    df = spark.createDataFrame(rows, "id int, ring array<struct<lon: double, lat: double>>")
    out = [json.loads(r.feature) for r in P.polygon_features(df, "ring").collect()]
    assert out[0]["geometry"]["coordinates"] == [[[0, 0], [1, 1], [0, 1], [0, 0]]] and out[1]["geometry"]["coordinates"][0][1] == [1, 0]
    assert out[2]["geometry"] is None and out[3]["geometry"] is None and out[3]["properties"] == {"id": 4}
    P.write_features(P.polygon_features(df, "ring"), str(tmp_path / "f"), F.col("feature").contains("Polygon"))
    assert spark.read.text(str(tmp_path / "f" / "part=inside")).count() == 2
    page = P.html_table(spark.createDataFrame([("<b>", None)], "a string, b int"), "x & y")
    assert "&lt;b&gt;" in page and "x &amp; y" in page and "</script>" not in P.embedded_json("</script>")
    with pytest.raises(ValueError):
        P.html_table(spark.range(5), "t", 4)


def test_registered_functions_areas_and_planes(spark):
    assert register.register(spark) == ["area_km2", "geodesic_m", "recall_interval", "tile_windows"]
    assert abs(spark.sql("select geodesic_m(0D, 0D, 0D, 1D)").first()[0] - 111319.4908) < 1e-3
    assert spark.sql("select count(*) from tile_windows(200, 100, 128, 32)").first()[0] == 2
    degree = spark.sql("select area_km2(array(named_struct('lon', 0D, 'lat', 0D), named_struct('lon', 1D, 'lat', 0D), named_struct('lon', 1D, 'lat', 1D), named_struct('lon', 0D, 'lat', 1D)))").first()[0]
    assert abs(degree - 12308.778) < 0.5  # its edges are no geodesics
    x, y = geodesy.azimuthal_equidistant([47.5, 47.0], [-52.0, -51.0], 47.0, -52.0)
    assert np.allclose(np.hypot(x, y), geodesy.inverse([47.0, 47.0], [-52.0, -52.0], [47.5, 47.0], [-52.0, -51.0])[0]) and abs(x[0]) < 1e-6


def test_a_made_up_scene_is_the_same_each_time(spark):
    a, b = P.synthetic_scene(spark, 10, 8, 100)
    c, _ = P.synthetic_scene(spark, 10, 8, 100)
    assert a.collect() == c.collect() and b.count() == 40 and b.groupBy("user_id").count().count() == 8
