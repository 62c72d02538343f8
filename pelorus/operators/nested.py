"""Deeply nested records into flat tables that keep the link from child to parent.

One pass: a visitor walks each document depth first and emits rows of (table, key, parent key, payload);
they are written partitioned by table, and each table is read back under its own schema.

A list of children may come as a list, as an object keyed by id, as one bare object, as JSON in a string,
or be null or absent. Defined cases: a document that isn't well-formed JSON, isn't an object, or is null
gives one row in the table "rejected" and nothing else; a child without an id has a null id and still its
own key, a member that is no object has its value under the key "value"; documents loaded again give their rows again under their own record; keys are made of the record
id and the places on the way, so they are unique even where ids repeat.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelorus.session import shared_path

EMITTED = "record_id bigint, tbl string, pk string, parent_pk string, own_id string, payload string"


@dataclass(frozen=True)
class Entity:
    """A child table: where its members lie below the parent, and which keys may hold a member's id."""

    tag: str
    path: tuple[str, ...]
    ids: tuple[str, ...] = ("id",)
    children: tuple[Entity, ...] = field(default=())
    #: One value rather than members: emitted if it is not null, under the parent's id.
    value: bool = False


def _unwrap(value):
    """A value that holds JSON as text is read; other text stays."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


def _members(value, ids: tuple[str, ...]) -> list[tuple[str | None, dict]]:
    value = _unwrap(value)
    if isinstance(value, list):
        items = [x if isinstance(x, dict) else {"value": x} for x in map(_unwrap, value)]
        return [(next((x[k] for k in ids if x.get(k) is not None), None), x) for x in items]
    if not isinstance(value, dict) or not value:
        return []
    if any(value.get(k) is not None and not isinstance(value[k], dict) for k in ids):
        return [(next(value[k] for k in ids if value.get(k) is not None), value)]
    keyed = {k: _unwrap(v) for k, v in value.items()}
    if all(isinstance(v, dict) for v in keyed.values()):
        return [(next((v[i] for i in ids if v.get(i) is not None), k), v) for k, v in keyed.items()]
    return [(None, value)]


def _at(node, path: tuple[str, ...]):
    for key in path:
        node = _unwrap(node)
        if not isinstance(node, dict):
            return None
        node = node.get(key)
    return node


def _text(own_id) -> str | None:
    return None if own_id is None else own_id if isinstance(own_id, str) else json.dumps(own_id, ensure_ascii=False)


def visit(record_id: int, text: str | None, wrappers: tuple[str, ...], roots: tuple[Entity, ...]) -> Iterator[tuple]:
    """The rows of one document, depth first, parents before their children."""
    try:
        document = json.loads(text)
        if not isinstance(document, dict):
            raise ValueError("not an object")
    except (TypeError, ValueError, RecursionError) as why:
        yield record_id, "rejected", f"{record_id}", None, None, json.dumps({"reason": str(why)[:200]})
        return
    kind = next((w for w in wrappers if isinstance(_unwrap(document.get(w)), dict)), None)
    body = _unwrap(document[kind]) if kind else document
    top = f"{record_id}"
    taken = {r.path[0] for r in roots}
    yield record_id, "record", top, None, None, json.dumps({"wrapper": kind} | {k: v for k, v in body.items() if k not in taken}, ensure_ascii=False)

    def walk(node: dict, key: str, own, entities: tuple[Entity, ...]) -> Iterator[tuple]:
        for e in entities:
            below = _at(node, e.path)
            if e.value:
                if below is not None:
                    body = below if isinstance(below, dict) else {"text": below if isinstance(below, str) else json.dumps(below)}
                    yield record_id, e.tag, f"{key}/{e.tag}", key, _text(own), json.dumps(body, ensure_ascii=False)
                continue
            for n, (own_id, child) in enumerate(_members(below, e.ids)):
                at = f"{key}/{e.tag}:{n}"
                taken = {c.path[0] for c in e.children if len(c.path) == 1 and not c.value}
                yield record_id, e.tag, at, key, _text(own_id), json.dumps({k: v for k, v in child.items() if k not in taken}, ensure_ascii=False)
                yield from walk(child, at, own_id, e.children)

    yield from walk(body, top, None, roots)


def emit(df: DataFrame, record_id: Column, payload: Column, wrappers: tuple[str, ...], roots: tuple[Entity, ...]) -> DataFrame:
    """All rows of all tables, tagged; one pass over the documents, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in EMITTED.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for rid, text in zip(batch["rid"], batch["doc"], strict=True):
                out.extend(visit(int(rid), text, wrappers, roots))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return df.select(record_id.cast("bigint").alias("rid"), payload.cast("string").alias("doc")).mapInPandas(run, EMITTED)


class FlatTables:
    """The tables of one emission, kept in the shared folder by tag."""

    def __init__(self, emitted: DataFrame):
        self.spark = emitted.sparkSession
        self.path = shared_path(self.spark, "nested")
        emitted.write.partitionBy("tbl").parquet(self.path)

    def rows(self, *tags: str) -> DataFrame:
        """Emitted rows of these tables; only their folders are read."""
        schema = "record_id bigint, pk string, parent_pk string, own_id string, payload string, tbl string"
        return self.spark.read.schema(schema).parquet(self.path).where(F.col("tbl").isin(*tags))

    def table(self, tag: str, schema: str) -> DataFrame:
        """One table under a schema; what doesn't fit a column's type is null in it."""
        body = F.from_json("payload", schema)
        return self.rows(tag).withColumn("body", body).select("record_id", "pk", "parent_pk", "own_id", "body.*")


#: The survey's own documents: areas hold objects (which hold decisions and optical products) and scenarios.
COLLECTION_WRAPPERS = ("collection", "annotation_decisions")
COLLECTION = (
    Entity(
        "area", ("areas",), ("id", "roi_id"),
        (
            Entity("object", ("objects",), ("id",), (
                Entity("decision", ("decision",), value=True),
                Entity("optical_product", ("optical", "products")),
            )),
            Entity("scenario", ("source_coverage", "scenarios"), ("name",)),
        ),
    ),
)


def collection_tables(records: DataFrame) -> FlatTables:
    """The tables of the collection records."""
    return FlatTables(emit(records, F.col("record_id"), F.col("payload"), COLLECTION_WRAPPERS, COLLECTION))


def children_of_areas(tables: FlatTables) -> DataFrame:
    """record_id, area_id, child_kind, child_id of every object, decision and scenario below an area.

    A child's area is found in its key, which holds the place of the area: no shuffle by record alone, so
    a record with a great many children does no harm.
    """
    kids = tables.rows("object", "decision", "scenario").where(F.col("own_id").isNotNull())
    kids = kids.withColumn("area_pk", F.regexp_extract("pk", r"^[^/]*/area:\d+", 0))
    areas = tables.rows("area").where(F.col("own_id").isNotNull()).select(F.col("pk").alias("area_pk"), F.col("own_id").alias("area_id"))
    return (
        kids.join(areas, "area_pk")
        .select("record_id", "area_id", F.col("tbl").alias("child_kind"), F.col("own_id").alias("child_id"))
        .distinct()
    )
