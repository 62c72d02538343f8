"""Matching records by nearest time: a stateful streaming join of two tables.

Both sides run as streams. Each entity's rows are cut into slices of time, which are spread over shards: a
shard's state holds the buffers of many slices, and an entity with a long history lies in many shards. A
left row visits every slice its tolerance reaches, and the best of its slices wins. Both sides are buffered
per entity; when the watermark has passed a left row's tolerance horizon it is emitted with its nearest
right row, and candidates that no open left row can still reach are evicted.

Defined cases: rows without entity or time take no part; offsets count in whole microseconds, the
tolerance is inclusive; of two equally near instants the earlier wins, of several rows at that instant the
smallest id; left rows without a match are not returned; repeated left rows with the same id are one; in a live
stream a row later than the watermark, or before 1970, is dropped by the engine, so the lateness must cover the
delay of either side; a replay drops none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from pelorus.functions.cleaning import instant_us  # noqa: F401  the queries and tests take it from here
from pelorus.session import make_folder, move_files, shared_path

STATE = ", ".join(f"{c} array<bigint>" for c in ("le", "lt", "li", "re", "rt", "ri"))
OUT = "left_id bigint, right_id bigint, offset_us bigint, right_us bigint"
#: The last instant an end marker may carry; far beyond data, within the range of timestamps.
END_US = 4_102_444_800_000_000
MICRO = 1_000_000
#: Triggers that a replay takes at least; each holds the rows of one stretch of time.
TRIGGERS = 4
_NONE = np.zeros(0, "int64")


def nearest(left: np.ndarray, right: np.ndarray, tolerance_us: int) -> pd.DataFrame:
    """The nearest right row of the same entity for each left row that has one. Rows: entity, t, id.

    right must be in order of entity and instant, one row per instant.
    """
    n = left.shape[1]
    at = _place(left, right)
    found = []
    for j in (at - 1, at):  # the last before, the first not before
        ok = (j >= 0) & (j < right.shape[1])
        k = np.clip(j, 0, max(0, right.shape[1] - 1))
        if not right.shape[1]:
            ok, k = np.zeros(n, bool), np.zeros(n, int)
            found.append((ok, np.zeros(n, "int64"), k))
            continue
        ok &= right[0][k] == left[0]
        off = np.where(ok, right[1][k] - left[1], 0)
        found.append((ok & (np.abs(off) <= tolerance_us), off, k))
    (ok_b, off_b, b), (ok_a, off_a, a) = found
    before = ok_b & (~ok_a | (-off_b <= off_a))
    ok, k, off = ok_b | ok_a, np.where(before, b, a), np.where(before, off_b, off_a)
    rows = right[:, k[ok]] if right.shape[1] else np.zeros((3, 0), "int64")
    return pd.DataFrame({"left_id": left[2][ok], "right_id": rows[2], "offset_us": off[ok], "right_us": rows[1]})


def _place(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each left row the number of right rows before it by entity and instant."""
    n, m = left.shape[1], right.shape[1]
    side = np.r_[np.zeros(n, int), np.ones(m, int)]
    order = np.lexsort((side, np.r_[left[1], right[1]], np.r_[left[0], right[0]]))
    before = np.cumsum(side[order])
    out = np.empty(n + m, int)
    out[order] = before
    return out[:n]


def _compact(rows: np.ndarray) -> np.ndarray:
    """In order of entity and instant, the smallest id of each."""
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    first = np.ones(rows.shape[1], bool)
    first[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
    return rows[:, first]


def _step(tolerance_us: int, origin_us: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [np.array(x, dtype="int64") for x in state.get] if state.exists else [_NONE] * 6
        lefts, rights = [np.stack(held[:3])], [np.stack(held[3:])]
        for f in frames:
            is_left = f["is_left"].to_numpy(bool)
            rows = np.stack([f[c].to_numpy("int64") for c in ("entity", "t", "id")])
            lefts.append(rows[:, is_left])
            rights.append(rows[:, ~is_left])
        left, right = np.concatenate(lefts, axis=1), _compact(np.concatenate(rights, axis=1))
        mark = state.getCurrentWatermarkMs() * 1000 + origin_us
        ready = left[1] + tolerance_us < mark
        yield nearest(left[:, ready], right, tolerance_us)
        left = left[:, ~ready]
        # a left row still to come lies behind the watermark by no more than the engine lets through
        right = right[:, right[1] + tolerance_us >= min(mark, left[1].min() if left.shape[1] else mark)]
        if not left.shape[1] and not right.shape[1]:
            state.remove()
            return
        state.update(tuple(x.tolist() for x in (*left, *right)))
        horizon = left[1].min() if left.shape[1] else right[1].max()
        state.setTimeoutTimestamp(int(max((horizon + tolerance_us - origin_us) // 1000 + 2, state.getCurrentWatermarkMs() + 1)))

    return step


def nearest_join(
    left: DataFrame, right: DataFrame, tolerance_s: float, lateness: str, slice_s: int = 3600, shards: int = 64
) -> DataFrame:
    """The streaming join. left, right: entity bigint, t bigint (microseconds), id bigint; streams.

    Returns a stream of left_id, right_id, offset_us, right_us: up to one row for each slice of a left row.
    shards: states that the slices are spread over; it should grow with the rows open at a time.
    """

    def side(df: DataFrame, is_left: bool) -> DataFrame:
        return df.where("entity is not null and t is not null and id is not null").select(F.lit(is_left).alias("is_left"), "entity", "t", "id")

    return tagged_join(side(left, True).unionByName(side(right, False)), tolerance_s, lateness, slice_s, shards)


def tagged_join(rows: DataFrame, tolerance_s: float, lateness: str, slice_s: int, shards: int, origin_us: int = 0) -> DataFrame:
    """nearest_join of one stream that holds both sides, told apart by is_left; event time counts from origin_us."""
    tolerance_us, slice_us = int(round(tolerance_s * MICRO)), slice_s * MICRO
    reach = F.when(F.col("is_left"), tolerance_us).otherwise(0)
    low, high = F.floor((F.col("t") - reach) / slice_us), F.floor((F.col("t") + reach) / slice_us)
    both = rows.withColumn("slot", F.explode(F.sequence(low, high))).withColumn("at", F.timestamp_micros(F.col("t") - origin_us)).withWatermark("at", lateness)
    both = both.withColumn("shard", F.pmod(F.xxhash64("entity", "slot"), F.lit(shards)).cast("int")).drop("slot")
    return both.groupBy("shard").applyInPandasWithState(
        _step(tolerance_us, origin_us), StructType.fromDDL(OUT), StructType.fromDDL(STATE), "append", GroupStateTimeout.EventTimeTimeout
    )


def best_of_slices(matched: DataFrame) -> DataFrame:
    """One row per left row: the nearest, of equally near the earlier, then the smallest id."""
    rank = F.struct(F.abs("offset_us").alias("d"), F.col("right_us"), F.col("right_id"), F.col("offset_us"))
    best = matched.groupBy("left_id").agg(F.min(rank).alias("m"))
    return best.select("left_id", F.col("m.right_id").alias("right_id"), F.col("m.offset_us").alias("offset_us"))


def _in_order(left: DataFrame, right: DataFrame, triggers: int) -> tuple[DataFrame, int]:
    """Both sides as one table with `chunk`: stretches of time in order, of equal length over the bulk of the left rows.

    And the first instant of a left row.
    """
    bulk, first = left.agg(F.percentile_approx("t", F.array(F.lit(0.01), F.lit(0.99))), F.min("t")).first()
    low, high = bulk or (0, 0)
    width = max(1, (high - low) // triggers + 1)
    tagged = lambda df, is_left: df.where("entity is not null and t is not null and id is not null").select(F.lit(is_left).alias("is_left"), "entity", "t", "id")
    chunk = F.least(F.lit(triggers - 1), F.greatest(F.lit(0), F.floor((F.col("t") - low) / width))).cast("int")
    return tagged(left, True).unionByName(tagged(right, False)).withColumn("chunk", chunk), first or 0


def replay(
    left: DataFrame, right: DataFrame, tolerance_s: float, slice_s: int = 3600, shards: int = 64, triggers: int = TRIGGERS, seen: list | None = None
) -> DataFrame:
    """Bounded tables (entity, t, id) through the streaming join, a stretch of time at a trigger.

    The rows are written by stretches; each is then put into the folder the stream watches and taken up in one
    trigger, so no row is late, and the watermark follows the data: pairs come out and buffers are evicted as it
    passes. A marker row far in the future moves it past the last horizons. The stream goes on from its checkpoint
    at each stretch, as it would after the loss of the driver. State and output lie in the shared folder.
    seen: takes the progress of every trigger.
    """
    spark: SparkSession = left.sparkSession
    where = shared_path(spark, "nearest")
    chunked, first = _in_order(left, right, triggers)
    chunked.write.partitionBy("chunk").parquet(f"{where}/staged")
    plain = chunked.drop("chunk")
    marker = spark.range(1).select(F.lit(False).alias("is_left"), *[F.lit(x).cast("bigint").alias(c) for c, x in (("entity", -1), ("t", END_US), ("id", -1))])
    marker.coalesce(1).write.parquet(f"{where}/staged/chunk={triggers}")
    make_folder(spark, f"{where}/live")
    rows = spark.readStream.schema(plain.schema).parquet(f"{where}/live")
    # an event time before 1970 would be late from the start; right rows before all left ones' reach match nothing
    origin = min(0, first - int(round(tolerance_s * MICRO)) - MICRO)
    joined = tagged_join(rows, tolerance_s, "1 second", slice_s, shards, origin)
    for k in range(triggers + 1):
        if not move_files(spark, f"{where}/staged/chunk={k}", f"{where}/live", f"{k}-"):
            continue
        running = (
            joined.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state")
            .trigger(availableNow=True).start()
        )
        try:
            running.awaitTermination()
            if seen is not None:
                seen.extend((k, p) for p in running.recentProgress)
        finally:
            running.stop()
    return best_of_slices(spark.read.schema(OUT).parquet(f"{where}/out"))


def reachable(left: DataFrame, tolerance_s: float, slice_s: int = 3600) -> DataFrame:
    """The (entity, slot) keys that left rows visit, each once: right rows elsewhere can match nothing."""
    tolerance_us, slice_us = int(round(tolerance_s * MICRO)), slice_s * MICRO
    low, high = F.floor((F.col("t") - tolerance_us) / slice_us), F.floor((F.col("t") + tolerance_us) / slice_us)
    return left.select("entity", F.explode(F.sequence(low, high)).alias("slot")).distinct()


# ---- reading the two sides ----


def vessel_number(text):
    """A nine-digit vessel number as text of several spellings, null if it is none."""
    s = F.regexp_replace(F.upper(F.trim(text)), r"^MMSI[\s:#]*", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\.0*$", ""), r"[\s -]", "")
    return F.when(s.rlike(r"^[1-9]\d{8}$"), s.cast("bigint"))
