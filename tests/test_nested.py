import json

from pyspark.sql import functions as F

from pelorus.operators import nested as N


def tables(spark, docs):
    rows = [(i, "collection", d if d is None or isinstance(d, str) else json.dumps(d), "clash") for i, d in enumerate(docs)]
    return N.collection_tables(spark.createDataFrame(rows, "record_id bigint, record_kind string, payload string, pk string"))


def test_all_shapes_of_children_come_out(spark):
    scen = {"scenarios": {"a": {"complete": True}, "b": {"complete": False}}}
    docs = [
        {"areas": [{"id": "x", "objects": [{"id": "u1", "decision": "keep"}, {"id": "u2", "decision": None}], "source_coverage": scen}]},
        {"collection": {"areas": {"y": {"objects": {"u1": {"class": "c"}, "u2": {"class": "d", "decision": {"text": "t", "by": "me"}}}}}}},
        {"annotation_decisions": {"areas": [{"roi_id": "z", "objects": {"id": "u9", "class": "c"}, "source_coverage": {"scenarios": [{"name": "a"}]}}]}},
        {"areas": [{"id": "s", "objects": json.dumps([{"id": "u1"}])}, {"id": "e", "objects": []}, {"id": "n", "objects": None}, {"id": "m"}]},
        '{"areas": [{"id": "broken", "objects": [{"id": "u1"',
        "[1, 2]", None, "", {"areas": {}}, {"areas": [{"id": "x", "objects": [{"id": "u1"}, {"id": "u1"}]}]},
    ]
    t = tables(spark, docs)
    got = sorted(tuple(r) for r in N.children_of_areas(t).collect())
    assert got == sorted([
        (0, "x", "object", "u1"), (0, "x", "object", "u2"), (0, "x", "decision", "u1"), (0, "x", "scenario", "a"), (0, "x", "scenario", "b"),
        (1, "y", "object", "u1"), (1, "y", "object", "u2"), (1, "y", "decision", "u2"),
        (2, "z", "object", "u9"), (2, "z", "scenario", "a"), (3, "s", "object", "u1"), (9, "x", "object", "u1"),
    ])
    assert sorted(r.record_id for r in t.rows("rejected").collect()) == [4, 5, 6, 7]


def test_keys_are_unique_and_parents_exist(spark):
    t = tables(spark, [{"areas": [{"id": "a", "objects": [{"id": "u", "optical": {"products": [{"id": "p"}, {"id": "p"}]}}] * 2}]}] * 3)
    rows = t.rows("record", "area", "object", "optical_product").collect()
    keys = [r.pk for r in rows]
    assert len(keys) == len(set(keys)) == 3 * (1 + 1 + 2 + 4)
    assert all(r.parent_pk in set(keys) for r in rows if r.parent_pk)


def test_typed_table_and_empty_input(spark):
    t = tables(spark, [{"areas": [{"id": "a", "split": "train", "prior_datatake_exposure": "x", "objects": []}]}])
    r = t.table("area", "split string, prior_datatake_exposure boolean").first()
    assert (r.own_id, r.split, r.prior_datatake_exposure) == ("a", "train", None)
    none = spark.createDataFrame([], "record_id bigint, payload string")
    assert N.emit(none, F.col("record_id"), F.col("payload"), (), N.COLLECTION).count() == 0


def test_very_deep_and_very_long_documents(spark):
    deep = "[" * 100_000 + "]" * 100_000
    long = {"areas": [{"id": f"a{i}", "objects": [{"id": "u", "reason": "x" * 200}] * 5} for i in range(400)]}
    t = tables(spark, [deep, long])
    assert t.rows("rejected").count() == 1
    assert t.rows("object").count() == 2000


def test_members_that_are_no_objects_come_out_too(spark):
    t = tables(spark, [{"areas": [{"id": "a", "objects": ["o1", 7, None, [1, 2], {"id": "o3"}]}]}])
    got = {r.pk: (r.own_id, json.loads(r.payload)) for r in t.rows("object").collect()}
    assert sorted(str(v) for v in got.values()) == sorted(str(v) for v in [(None, {"value": "o1"}), (None, {"value": 7}), (None, {"value": None}), (None, {"value": [1, 2]}), ("o3", {"id": "o3"})])
    assert [tuple(r) for r in N.children_of_areas(t).collect()] == [(0, "a", "object", "o3")]
