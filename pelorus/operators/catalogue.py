"""Acquisition catalogues: copies of one slice as one, groups over splits, greedy and grouped selection."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelorus.session import cut


def one_per_slice(products: DataFrame, identity: list[str], copy: Column, order: Column) -> DataFrame:
    """One row of each identity: no copy if there is an original, then the first by order; with its aliases."""
    ranked = products.groupBy(*identity).agg(F.min(F.struct(copy.alias("copy"), order.alias("name"))).alias("first"), F.collect_set(order).alias("names"))
    aliases = F.when(F.size("names") > 1, F.array_sort("names"))
    return ranked.select(*identity, F.col("first.name").alias("name"), aliases.alias("aliases"))


def over_splits(rows: DataFrame, group: str, split: Column) -> DataFrame:
    """Groups whose rows hold more than one split, with the splits in order."""
    held = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count("*").alias("areas"))
    return held.where(F.size("splits") > 1)


def components(edges: DataFrame, limit: int = 200) -> DataFrame:
    """v, label: the smallest vertex that each vertex of the edges (a, b) is connected to.

    Every round a vertex takes the smallest label around it, and then its label's label, so that long
    chains shrink by halves. Rounds are cut in the shared folder.
    """
    both = cut(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("label")))
    for _ in range(limit):
        around = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(around, "v").select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        above = step.select(F.col("v").alias("label"), F.col("label").alias("up"))
        step = cut(step.join(above, "label", "left").select("v", "was", F.least("label", F.coalesce("up", "label")).alias("label")))
        labels = step.select("v", "label")
        if step.where("was <> label").isEmpty():
            return labels
    raise RuntimeError(f"labels still move after {limit} rounds")


def greedy(rows: Iterable[dict], checks: list[tuple[str, Callable[[dict, list[dict]], bool]]], most: int) -> list[dict]:
    """The order-dependent selection: each row in turn, refused with the first check that fails.

    A selection of at most `most` rows depends on its order and so is made on the driver, over candidates
    that were ranked and limited before.
    """
    taken: list[dict] = []
    out = []
    for row in rows:
        reason = "batch_full" if len(taken) >= most else next((name for name, ok in checks if not ok(row, taken)), None)
        if reason is None:
            taken.append(row)
        out.append({**row, "selected": reason is None, "reason": reason})
    return out


def ranked(rows: DataFrame, by: list[str], keys: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in the order of the keys, with their rank."""
    w = Window.partitionBy(*by).orderBy(*keys)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def around_cells(cells: DataFrame, x: str, y: str, reach: int) -> DataFrame:
    """Every cell within `reach` of the given ones once, with the ring and key of the nearest (x, y, ring, from_x, from_y)."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    spread = cells.select(F.col(x).alias("from_x"), F.col(y).alias("from_y")).withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    near = spread.select(
        (F.col("from_x") + F.col("dx")).alias("x"), (F.col("from_y") + F.col("dy")).alias("y"),
        F.struct(F.greatest(F.abs("dx"), F.abs("dy")).alias("ring"), "from_x", "from_y").alias("n"),
    )
    return near.groupBy("x", "y").agg(F.min("n").alias("n")).select("x", "y", "n.ring", "n.from_x", "n.from_y")


def latest_attempts(attempts: DataFrame, key: str, at: str, failed: Column) -> DataFrame:
    """By key: attempts, failures, the latest state, and whether three failures exhaust it."""
    out = attempts.groupBy(key).agg(
        F.count("*").alias("attempts"), F.count_if(failed).alias("failures"), F.max_by("state", at).alias("latest_state"), F.max(at).alias("latest_at")
    )
    return out.withColumn("exhausted", (F.col("failures") >= 3) & ~F.col("latest_state").isin("processed", "measured"))
