"""Sequences per entity, worked on as arrays of many whole groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a Python worker gathers before it works on them; a single larger group is still kept whole.
BUFFER_ROWS = 60_000
#: Rows of an Arrow batch on its way back, which the engine holds outside its heap for each task.
BATCH_ROWS = 10_000


def in_time_buckets(df: DataFrame, time_s: str, width_s: float, halo_s: float) -> DataFrame:
    """df with `bucket`: the stretch of time a row lies in, and once more the neighbour it lies close to.

    A long history of one entity so becomes many groups of bounded length; each also sees halo_s seconds
    to either side. A row belongs to the bucket where `core` is true.
    """
    own = F.floor(F.col(time_s) / width_s)
    before, after = F.floor((F.col(time_s) - halo_s) / width_s), F.floor((F.col(time_s) + halo_s) / width_s)
    buckets = F.array_distinct(F.array(own, before, after)) if halo_s else F.array(own)
    return df.withColumn("bucket", F.explode(buckets)).withColumn("core", F.col("bucket") == own)


def over_groups(
    df: DataFrame, keys: list[str], order: list[str], work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame | Iterator[pa.Table]], schema: str | StructType, tasks: int | None = None
) -> DataFrame:
    """work(frame, starts) over frames that hold whole groups, sorted by keys and order.

    starts has the first row of each group. One shuffle; groups are spread by all keys. Where more comes out than goes
    in, work yields tables, one at a time, and tasks says how many share the groups: else the engine merges them by what goes in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        target = None

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            frame = table.to_pandas()
            first = np.zeros(len(frame), bool)
            first[:1] = True
            for k in keys:
                v = frame[k].to_numpy()
                first[1:] |= v[1:] != v[:-1]
            out = work(frame, np.flatnonzero(first))
            if not isinstance(out, pd.DataFrame):
                for part in out:
                    yield from part.select(target.names).cast(target).to_batches(max_chunksize=BATCH_ROWS)
            elif len(out):
                yield from pa.Table.from_pandas(out, schema=target, preserve_index=False).to_batches()

        target = to_arrow_schema(struct)
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= BUFFER_ROWS:
                table = pa.Table.from_batches(held)
                last = [table[k][rows - 1].as_py() for k in keys]
                same = np.ones(rows, bool)
                for k, v in zip(keys, last, strict=True):
                    same &= table[k].to_numpy() == v
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield from done(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    rows -= cut
        if held:
            yield from done(pa.Table.from_batches(held))

    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    spread = df.repartition(*[tasks] * bool(tasks), *keys).sortWithinPartitions(*keys, *order)
    return spread.mapInArrow(run, struct)


def windows(values: np.ndarray, group: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """For each reading its 2*half+1 neighbours, and which of them are in the same group."""
    n = len(values)
    at = np.arange(n)[:, None] + np.arange(-half, half + 1)[None, :]
    inside = (at >= 0) & (at < n)
    at = np.clip(at, 0, max(0, n - 1))
    inside &= group[at] == group[:, None]
    return np.where(inside, values[at], np.nan), inside


def masked_median(table: np.ndarray) -> np.ndarray:
    """Median of each row without its NaNs; NaN where there are none."""
    ordered = np.sort(table, axis=1)
    count = np.sum(~np.isnan(table), axis=1)
    low, high = np.maximum(0, (count - 1) // 2), np.maximum(0, count // 2)
    rows = np.arange(len(table))
    out = (ordered[rows, low] + ordered[rows, high]) / 2
    return np.where(count > 0, out, np.nan)


def runs(flag: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Length of the run of true values that each true value belongs to; 0 for false ones."""
    n = len(flag)
    if not n:
        return np.zeros(0, int)
    new = np.ones(n, bool)
    new[1:] = (flag[1:] != flag[:-1]) | (group[1:] != group[:-1])
    number = np.cumsum(new) - 1
    return np.where(flag, np.bincount(number)[number], 0)
