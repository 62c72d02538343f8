"""Splits that keep related records together.

Records sharing a group are related, and so are their groups. Groups are the vertices, a record that names
several groups gives the edges. Random-mate contraction: each round every vertex tosses a coin, tails with
a neighbour that shows heads are collapsed into it by joins, edges move along, loops vanish; when no edges
are left the rounds are unwound from the last to the first. Components are then split by cumulative weight.

Defined cases: null or empty groups relate nothing; a record without groups is a component of its own; a
record is counted once per id; equal weights are ordered by label; empty tables give empty results. Only
components of more than a LARGE-th of all weight reach the driver: at most LARGE of them.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pelorus.session import cut, release, shared_path, stored_at

LARGE = 1000
SLOTS = 512
MAX_ROUNDS = 400


def _coin(vertex: Column, turn: int) -> Column:
    """True for heads; another toss each round."""
    # the round goes in as text: a number would be written into the generated code, and compiled each round
    return F.pmod(F.xxhash64(F.lit(str(turn)), vertex), F.lit(2)) == 0


def _collapse(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One round: which vertex is collapsed into which (v, parent), and the edges that are left."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = both.where(~_coin(F.col("a"), turn) & _coin(F.col("b"), turn))
    mates = pairs.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("parent"))
    moved = edges
    for end in ("a", "b"):
        # merged, not broadcast: mates grow with the data, and many small broadcasts fill the driver
        m = mates.select(F.col("v").alias(end), F.col("parent").alias("_p")).hint("merge")
        moved = moved.join(m, end, "left").withColumn(end, F.coalesce("_p", end)).drop("_p")
    moved = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return mates, moved.distinct()


def contract(edges: DataFrame) -> DataFrame:
    """v, label for every vertex of the edges (a, b): vertices of one component have one label.

    Each round is written once, in one table: the edges left and the vertices collapsed. A vertex collapses once,
    so all rounds' mates are a forest; it is unwound by taking the parent's parent until nothing moves, which halves
    the way to the root each time. What was written is deleted as soon as it is read no more.
    """
    spark = edges.sparkSession
    vertex = edges.schema["a"].dataType
    where = shared_path(spark, "contract")
    loose = edges.where("a is not null and b is not null and a <> b")
    rest = loose.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rounds, left = 0, 1
    while left:
        if rounds > MAX_ROUNDS:
            raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds")
        mates = None
        if rounds:  # the first time the edges alone are written
            mates, rest = _collapse(rest, rounds)
        kept = rest.select("a", "b", F.lit("edge").alias("kind"))
        if mates is not None:
            kept = kept.unionByName(mates.select(F.col("v").alias("a"), F.col("parent").alias("b"), F.lit("mate").alias("kind")))
        seen = Observation()
        counted = kept.observe(seen, F.count_if(F.col("kind") == "edge").alias("edges"))
        counted.write.partitionBy("kind").parquet(f"{where}/round={rounds}")
        left = seen.get["edges"]
        rest = spark.read.schema(f"a {vertex.simpleString()}, b {vertex.simpleString()}").parquet(f"{where}/round={rounds}/kind=edge") if left else rest
        if rounds:
            release(spark, f"{where}/round={rounds - 1}/kind=edge")
        rounds += 1
    mates = spark.read.schema(f"a {vertex.simpleString()}, b {vertex.simpleString()}, kind string, round int").parquet(where).where("kind = 'mate'")
    labels, moved, step = mates.select(F.col("a").alias("v"), F.col("b").alias("label")), 1, 0
    while moved:
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("_up")).hint("merge")
        jumped = labels.join(up, "label", "left").select("v", F.coalesce("_up", "label").alias("label"), F.col("_up").isNotNull().alias("moved"))
        seen = Observation()
        path = f"{where}-labels{step}"
        stored_at(jumped.observe(seen, F.count_if("moved").alias("moved")), path)
        moved = seen.get["moved"]
        labels = spark.read.schema(jumped.schema).parquet(path).select("v", "label")
        release(spark, where if step == 0 else f"{where}-labels{step - 1}")
        step += 1
    roots = labels.select(F.col("label").alias("v"), "label").distinct()
    return labels.unionByName(roots)


def components(records: DataFrame, record_id: str, groups: str) -> DataFrame:
    """record_id, component: records related by the strings in the array column `groups`, or by a chain."""
    named = records.select(
        F.col(record_id).alias("id"),
        F.array_sort(F.array_distinct(F.filter(F.coalesce(groups, F.array().cast("array<string>")), lambda g: g.isNotNull() & (g != "")))).alias("g"),
    )
    first = F.get("g", F.lit(0))
    edges = named.where(F.size("g") > 1).select(first.alias("a"), F.explode(F.slice("g", 2, 1 << 30)).alias("b"))
    labels = contract(edges)
    # records without groups are no rows of the join: they would all be one key
    alone = named.where(F.size("g") == 0).select(F.col("id").alias(record_id), F.concat(F.lit("record:"), F.col("id").cast("string")).alias("component"))
    grouped = named.where(F.size("g") > 0).select("id", first.alias("v")).join(labels.hint("merge"), "v", "left")
    return grouped.select(F.col("id").alias(record_id), F.coalesce("label", "v").alias("component")).unionByName(alone)


def assign(weights: DataFrame, shares: dict[str, float]) -> DataFrame:
    """component, split for components with a weight: each whole, the splits as near the shares as can be.

    Components larger than a LARGE-th of all weight (so fewer than LARGE) are dealt out one by one, the
    largest first, to the split that lacks most; the rest fills the splits in order of a hash by cumulative
    weight, which is summed in slots so that no task sees all components.
    """
    weights = cut(weights.select("component", F.col("weight").cast("double").alias("weight")))
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    if not total:
        return weights.select("component", F.lit(None).cast("string").alias("split"))
    large = weights.where(F.col("weight") > total / LARGE).orderBy(F.desc("weight"), "component").collect()
    lack = {k: v * total for k, v in shares.items()}
    dealt = []
    for r in large:
        k = max(lack, key=lambda s: lack[s])
        lack[k] -= r["weight"]
        dealt.append((r["component"], k))
    small = weights.where(F.col("weight") <= total / LARGE)
    slot = F.pmod(F.xxhash64("component"), F.lit(SLOTS)).cast("int")
    small = small.withColumn("slot", slot)
    sums = sorted((r["slot"], r["w"]) for r in small.groupBy("slot").agg(F.sum("weight").alias("w")).collect())
    offsets, reached = {}, 0.0
    for s, w in sums:
        offsets[s] = reached
        reached += w
    open_ = {k: max(0.0, v) for k, v in lack.items()}
    scale = reached / sum(open_.values()) if sum(open_.values()) else 0.0
    ends, end = [], 0.0
    for k in shares:
        end += open_[k] * scale
        ends.append((k, end))
    spark = weights.sparkSession
    base = F.create_map(*[F.lit(x) for s in offsets for x in (s, offsets[s])]) if offsets else F.create_map(F.lit(0), F.lit(0.0))
    w = Window.partitionBy("slot").orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    middle = base[F.col("slot")] + F.sum("weight").over(w) - F.col("weight") / 2
    names = [k for k, _ in ends]
    choice = F.lit(names[max(range(len(names)), key=lambda i: open_[names[i]])])
    for k, e in reversed(ends):
        choice = F.when(middle <= e, F.lit(k)).otherwise(choice)
    spread = small.select("component", choice.alias("split"))
    if not dealt:
        return spread
    schema = spread.schema
    return spread.unionByName(spark.createDataFrame(dealt, schema))


def split_name(text: Column) -> Column:
    """train, validation, test, or null: spellings of one split are one."""
    s = F.lower(F.trim(text))
    return (
        F.when(s == "", None).when(s.startswith("tr"), "train").when(s.startswith("val") | (s == "dev"), "validation")
        .when(s.startswith("test"), "test").otherwise(s)
    )


def split_groups(text: Column, prefix: str) -> Column:
    """Group names in one spelling, those joined by + apart."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\+")
    tidy = lambda g: F.regexp_replace(F.regexp_replace(F.trim(g), r"[\s_]+", "_"), r"^_+|_+$", "")
    return F.transform(F.filter(F.transform(parts, tidy), lambda g: g != ""), lambda g: F.concat(F.lit(prefix), g))


def acquisition(group: Column, product_name: Column) -> Column:
    """The native acquisition group; where it is null the product's name holds it."""
    own = F.regexp_replace(F.upper(F.trim(group)), r"[\s_-]+", "_")
    part = r"^(S1[A-Z])_.*_(\d{6})_([0-9A-F]{6})_[0-9A-F]{4}(?:_COG)?(?:\.SAFE)?$"
    named = F.upper(F.trim(product_name))
    held = F.when(
        named.rlike(part),
        F.concat_ws("_", *[F.regexp_extract(named, part, k) for k in (1, 2, 3)]),
    )
    got = F.coalesce(F.when(own != "", own), held)
    return F.when(got.isNotNull(), F.concat(F.lit("acq:"), got))


def violations(records: DataFrame, labels: DataFrame, record_id: str, split: Column) -> DataFrame:
    """record_id, component of every record of a component that holds more than one split."""
    held = records.select(record_id, split.alias("split")).join(labels, record_id)
    mixed = (
        held.where("split is not null").groupBy("component")
        .agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("component")
    )
    return labels.join(mixed, "component").select(record_id, "component")


