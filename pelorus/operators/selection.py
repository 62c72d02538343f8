"""Choosing among products and areas: identities, exclusions, roles, orders, and the rules a release must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelorus.operators.overlap import complete


def unique_acquisitions(products: DataFrame, order: str) -> DataFrame:
    """One row of each acquisition: id, name, start_us, end_us, aliases (all its names if there are several).

    products: id, name, slice (null: no slice name), start_us, end_us, ring and an order column. Of rows with one id the last counts.
    Products are one acquisition if slice, start, end and footprint are equal; without a slice, with start not before end or with a
    footprint that isn't complete each is its own. Of several the one that is no copy counts, then the smallest id.
    """
    last = products.groupBy(F.lower(F.trim("id")).alias("uuid")).agg(F.max_by(F.struct("name", "slice", "start_us", "end_us", "ring"), order).alias("p"))
    known = F.col("p.slice").isNotNull() & F.coalesce(F.col("p.start_us") < F.col("p.end_us"), F.lit(False)) & complete(F.col("p.ring"))
    key = F.when(known, F.to_json(F.struct("p.slice", "p.start_us", "p.end_us", "p.ring"))).otherwise(F.col("uuid"))
    best = F.min(F.struct(F.coalesce(F.upper("p.name").contains("_COG"), F.lit(False)).alias("copy"), F.col("uuid"), F.col("p.name").alias("name"), F.col("p.start_us").alias("start_us"), F.col("p.end_us").alias("end_us")))
    out = last.groupBy(key.alias("_k")).agg(best.alias("b"), F.array_sort(F.collect_set("p.name")).alias("names"))
    return out.select(F.col("b.uuid").alias("id"), "b.name", "b.start_us", "b.end_us", F.when(F.size("names") > 1, F.col("names")).alias("aliases"))


def without_locked(rows: DataFrame, locked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share none of the keys with a locked row; an unknown key shares nothing."""
    out = rows
    for k in keys:
        out = out.join(locked.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
    return out


def parity_split(group: Column, even: str = "train", odd: str = "validation") -> Column:
    """A group's split by whether the first byte of its SHA-256 is even: the same wherever and whenever it is asked for."""
    return F.when(F.conv(F.substring(F.sha2(group, 256), 1, 2), 16, 10).cast("int") % 2 == 0, even).otherwise(odd)


def inherited_roles(near: DataFrame, rows: DataFrame, own: Column, closed: tuple[str, ...] = ("test",)) -> DataFrame:
    """Each row's role from the splits of what lies near it (near: row_id, split): row_id, role, problem.

    None near: its own. A closed split near, or more than one, is a problem.
    """
    held = near.where("split is not null").groupBy("row_id").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    out = rows.withColumn("_own", own).join(held, "row_id", "left")
    n = F.coalesce(F.size("splits"), F.lit(0))
    shut = F.coalesce(F.arrays_overlap("splits", F.array(*[F.lit(c) for c in closed])), F.lit(False))
    problem = F.when(shut, "near_closed_split").when(n > 1, "near_several_splits")
    role = F.when(problem.isNull(), F.when(n == 1, F.get("splits", F.lit(0))).otherwise(F.col("_own")))
    return out.select("row_id", role.alias("role"), problem.alias("problem"))


def all_hold(rows: DataFrame, by: str, checks: dict[str, Column]) -> DataFrame:
    """By group whether all its rows keep each check (unknown: no), and whether it keeps all of them."""
    kept = rows.groupBy(by).agg(F.count("*").alias("rows"), *[F.bool_and(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    whole = F.lit(True)
    for n in checks:
        whole &= F.col(n)
    return kept.withColumn("ready", whole)


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """rule, key of every row that a rule's DataFrame (one column) names; nothing means that all rules are kept."""
    out = None
    for rule, found in checks.items():
        part = found.select(F.lit(rule).alias("rule"), found[found.columns[0]].cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def precision_step(text: Column) -> Column:
    """The step of the last digit a number is written with, such as 0.001 for "12.340"; null if it isn't a plain number."""
    digits = F.length(F.regexp_extract(text, r"^\s*[+-]?\d+\.(\d+)\s*$", 1))
    return F.when(text.rlike(r"^\s*[+-]?\d+(\.\d+)?\s*$"), F.pow(F.lit(10.0), -digits))


def escaped(text: Column) -> Column:
    """Text safe inside HTML."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical_digest(value: Column) -> Column:
    """SHA-256 of JSON text in one form: keys in order, no blanks; null for what isn't JSON."""
    import hashlib
    import json

    import pandas as pd

    def one(text: str | None) -> str | None:
        try:
            return hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()
        except (TypeError, ValueError, RecursionError):
            return None

    return F.pandas_udf(lambda s: pd.Series([one(t) for t in s], dtype=object), "string")(value)


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], width: float) -> DataFrame:
    """by…, share, value: exact linear quantiles of groups of any size.

    Rows are counted by buckets of `width`, the buckets that hold the wanted ranks are found by running sums over the counts, and only
    those buckets' rows are put in order: no task holds a group.
    """
    from pyspark.sql import Window

    known = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias("_v")).withColumn("_b", F.floor(F.col("_v") / width))
    counts = known.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*by).orderBy("_b")
    total = F.sum("_n").over(Window.partitionBy(*by))
    run = counts.withColumn("_before", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).withColumn("_total", total)
    wanted = run.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("_at", F.col("share") * (F.col("_total") - 1))
    ends = F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))
    wanted = wanted.withColumn("_rank", F.explode(ends)).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    buckets = wanted.select(*by, "_b").distinct()
    ranked = known.join(buckets, [*by, "_b"]).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_v")) - 1)
    met = wanted.join(ranked, [*by, "_b"]).where(F.col("_r") + F.col("_before") == F.col("_rank"))
    part = F.when(F.col("_rank") == F.col("_at"), 1.0).otherwise(1 - F.abs(F.col("_at") - F.col("_rank")))
    return met.groupBy(*by, "share").agg(F.sum(F.col("_v") * part).alias("value"))
