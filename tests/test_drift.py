import json

import pytest

from pelorus.operators import drift as D


def frame(spark, files):
    rows, n = [], 0
    for no, (file_id, docs) in enumerate(files, 1):
        for d in docs:
            n += 1
            rows.append((n, file_id, "f", no, d if isinstance(d, (str, type(None))) else json.dumps(d), "x"))
    return spark.createDataFrame(rows, "row_id bigint, file_id bigint, feed string, file_no int, payload string, value string")


def changes(spark, files):
    return sorted(tuple(r) for r in D.field_changes(frame(spark, files)).collect())


def test_added_removed_renamed_retyped(spark):
    got = changes(spark, [
        (10, [{"id": "a", "x": 1.5, "flag": True, "gone": "q"}, {"id": "b", "x": 2, "flag": False, "gone": "r"}]),
        (11, [{"id": "a", "offset": 1.5, "flag": "yes", "new": None}, {"id": "b", "offset": 2, "flag": "no"}, {"id": "c", "offset": 9}]),
        (12, [{"id": "c", "offset": {"v": 9}, "flag": None, "new": [1]}]),
    ])
    assert got == sorted([
        (11, "renamed", "x", "offset"), (11, "retyped", "flag", "flag"), (11, "removed", "gone", ""), (11, "added", "", "new"),
        (12, "retyped", "offset", "offset"),
    ])


def test_without_shared_areas_nothing_is_renamed(spark):
    got = changes(spark, [(1, [{"id": "a", "x": 1}]), (2, [{"id": "b", "y": 1}])])
    assert got == [(2, "added", "", "y"), (2, "removed", "x", "")]


def test_equal_content_in_two_new_fields_goes_to_the_likest_name(spark):
    got = changes(spark, [(1, [{"id": "a", "size_m": 7}]), (2, [{"id": "a", "size_metres": 7, "zzz": 7}])])
    assert got == [(2, "added", "", "zzz"), (2, "renamed", "size_m", "size_metres")]


def test_broken_rows_repeated_rows_and_empty_tables(spark):
    docs = [{"id": "a", "x": 1}] * 3 + ["{broken", None, "[1]", "7"]
    assert changes(spark, [(1, docs), (2, docs)]) == []
    assert D.field_changes(frame(spark, [])).count() == 0


def test_consistent_table_reports_failed_casts(spark):
    rows = frame(spark, [
        (1, [{"id": "a", "n": 1, "ok": True}, {"id": "b", "n": 2.5, "ok": False}, {"id": "c", "n": 3}]),
        (2, [{"id": "a", "num": 1, "ok": {"value": True}}, {"id": "b", "num": 2.5, "ok": [False]}, {"id": "d", "num": "many"}]),
    ])
    columns, typed = D.column_names(D.field_changes(rows), D.field_values(rows))
    assert sorted(columns["n"]) == ["n", "num"] and typed == {"id": "string", "n": "double", "ok": "boolean"}
    out = {r.row_id: r for r in D.consistent_table(rows, columns, typed).collect()}
    assert [out[i].n for i in range(1, 7)] == [1.0, 2.5, 3.0, 1.0, 2.5, None]
    assert [out[i].ok for i in range(1, 7)] == [True, False, None, True, False, None]
    assert out[6].failed_casts == ["n"] and out[1].failed_casts == []


def test_nested_paths(spark):
    got = {(r.path, r.kind) for r in D.nested_paths(frame(spark, [(1, [{"a": {"b": [1, "x"]}}])])).collect()}
    assert got == {("$.a", "object"), ("$.a.b", "array"), ("$.a.b[*]", "number"), ("$.a.b[*]", "string")}


def test_only_lists_of_one_and_objects_of_one_key_are_unwrapped(spark):
    docs = [{"n": 1, "s": "a"}, {"n": [2], "s": {"value": "b"}}, {"n": {"metres": 3}, "s": ["c"]}, {"n": [1, 2, 3], "s": [4, 5]}, {"n": {"value": 1, "unit": "m"}, "s": {"name": "d", "no": 6}}, {"n": [], "s": {}}]
    rows = frame(spark, [(1, docs)])
    out = D.consistent_table(rows, {"n": ["n"], "s": ["s"]}, {"n": "double", "s": "string"}).orderBy("row_id").collect()
    assert [r.n for r in out] == [1.0, 2.0, 3.0, None, None, None]
    assert [r.failed_casts for r in out] == [[], [], [], ["n"], ["n"], ["n"]]
    assert [r.s for r in out] == ["a", "b", "c", "[4,5]", '{"name":"d","no":6}', "{}"]


def test_too_many_renamings_are_an_error_not_left_out(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_NAMES", 1)
    values = spark.createDataFrame([("a", "number", "1.5")], "field string, kind string, raw string")
    pairs = [("renamed", f"o{k}", "a") for k in range(11)]
    schema = "change string, old_field string, new_field string"
    assert D.column_names(spark.createDataFrame(pairs[:10], schema), values) == ({"a": ["a"]}, {"a": "double"})
    with pytest.raises(ValueError, match="renamings"):
        D.column_names(spark.createDataFrame(pairs, schema), values)


def test_nested_paths_go_on_to_the_last_level(spark):
    doc = 7
    for k in range(13, 0, -1):
        doc = [doc] if k == 9 else {f"k{k}": doc}
    got = {r.path: (r.kind, r.n) for r in D.nested_paths(frame(spark, [(1, [doc, {"a": 1}])])).collect()}
    deepest = "$.k1.k2.k3.k4.k5.k6.k7.k8[*].k10.k11.k12.k13"
    assert len(got) == 14 and got[deepest] == ("number", 1) and got["$.a"] == ("number", 1)


def test_nothing_is_lost_without_a_word(spark):
    rows = frame(spark, [(1, [
        {"id": "a", "big": 9007199254740993, "mixed": 1.5, "list": ["x", "y", "z"], "size": {"value": 1, "unit": "m"}, "n": 4},
        {"id": "b", "big": 7, "mixed": 9007199254740993, "list": ["x"], "size": 2, "n": [5, 6]}, {"id": "c", "n": 8},
        {"id": "d", "a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": {"i": [{"j": 1}]}}}}}}}}},
    ])])
    columns, typed = D.column_names(D.field_changes(rows), D.field_values(rows))
    assert (typed["big"], typed["mixed"], typed["n"]) == ("bigint", "double", "bigint")
    out = {r.row_id: r for r in D.consistent_table(rows, columns, typed).collect()}
    assert out[1].big == 9007199254740993 and out[1].list == '["x","y","z"]' and out[2].list == "x"
    assert out[1].size is None and out[1].failed_casts == ["size"] and sorted(out[2].failed_casts) == ["mixed", "n"]
    paths = {r.path for r in D.nested_paths(rows).collect()}
    assert "$.a.b.c.d.e.f.g.h.i[*].j" in paths
