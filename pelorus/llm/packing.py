"""Filling containers of fixed capacity with texts, sized in tokens.

Pattern packing by non-negative least squares: patterns of a few sizes that fill a container are
enumerated, repeat counts are fitted to the histogram of sizes, rounded down, and what is left is fitted
again with new patterns; the residual is packed best fit, largest first. The driver sees the histogram
only, at most `capacity` numbers, whatever the number of texts. Items then find their container by their
rank among items of their size.

Defined cases: a text longer than the capacity is split into pieces of the capacity and a rest, no other
is split; null and empty texts have size 0 and share container 0, which holds
nothing else; repeated texts are items of their own; ids are placed in order of id within a size. An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelorus.session import stored

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public tokenizer cuts a text before merging (a fixed value of its format).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Patterns tried at each fit, fits, and steps of each: they bound the driver's work, not the data.
PATTERNS, FITS, STEPS = 12_000, 4, 250
ITEMS_A_SLOT = 200_000


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """id, tokens of each text (id, text); whole texts, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _encoder(tokenizer)
        for b in batches:
            counts = [len(own.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "tokens": pd.Series(counts, dtype="int64")})

    return texts.select("id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "id bigint, tokens bigint")


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """id, piece_no, first_token, size: each text whole, or cut into pieces of the capacity and a rest."""
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity))
    cut = sizes.withColumn("piece_no", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    first = F.col("piece_no").cast("bigint") * capacity
    return cut.select("id", "piece_no", first.alias("first_token"), F.least(F.lit(capacity), F.col("tokens") - first).cast("int").alias("size"))


# ---- the plan, on the histogram alone ----


def _patterns(left: np.ndarray, capacity: int, n: int, rng: np.random.Generator) -> list[tuple[int, ...]]:
    """Patterns that fill a container: all pairs, triples and deeper ones drawn as sizes occur."""
    there = np.flatnonzero(left > 0)
    if not len(there):
        return []
    largest_up_to = np.zeros(capacity + 1, int)
    largest_up_to[there] = there
    largest_up_to = np.maximum.accumulate(largest_up_to)
    found = {(int(s), int(capacity - s)) for s in there if s * 2 <= capacity and left[capacity - s] > 0}
    if left[capacity] > 0:
        found.add((capacity,))
    share = left[there] / left[there].sum()
    wide = int(min(64, max(4, 3 * capacity / max(1.0, (there * share).sum()))))
    drawn = rng.choice(there, size=(n, wide), p=share)
    by_weight = left[there] * there / (left[there] * there).sum()
    drawn[:, 0] = rng.choice(there, size=n, p=by_weight)
    total = np.cumsum(drawn, axis=1)
    deep = rng.integers(1, wide + 1, size=n)
    fits = np.minimum((total <= capacity).sum(axis=1), deep)
    for row, k in zip(drawn, fits, strict=True):
        have = [int(x) for x in row[:k]]
        room = capacity - sum(have)
        while room > 0:
            s = int(largest_up_to[room])
            if s == 0:
                break
            have.append(s)
            room -= s
        if room <= capacity // 512:
            found.add(tuple(sorted(have)))
    return sorted(found)


def fit_counts(patterns: list[tuple[int, ...]], wanted: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative x with A x close to `wanted` (least squares), by accelerated projected gradients."""
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.concatenate([np.array(p) for p in patterns])
    n, m = len(patterns), len(wanted)
    # scaled by pattern, as patterns of many small items would else dominate
    norm = np.sqrt(np.bincount(col, minlength=n).astype(float))
    up = lambda x: np.bincount(row, weights=(x / norm)[col], minlength=m)
    down = lambda r: np.bincount(col, weights=r[row], minlength=n) / norm
    v = np.ones(n)
    for _ in range(12):
        v = down(up(v))
        length = np.linalg.norm(v)
        v /= length or 1.0
    step = 1.0 / (1.05 * (length or 1.0))
    x = z = np.zeros(n)
    k = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, z + step * down(wanted - up(z)))
        k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
        z = new + (k - 1) / k2 * (new - x)
        x, k = new, k2
    return x / norm


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The residual, largest first into the fullest container that takes it; alike containers as one."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    rooms: list[int] = []  # rooms in use, kept sorted
    from bisect import bisect_left, insort

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        if room not in open_ or not open_[room]:
            if room not in rooms:
                insort(rooms, room)
        open_[room][content] = open_[room].get(content, 0) + n

    for s in np.flatnonzero(left > 0)[::-1]:
        s, n = int(s), int(left[s])
        while n:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                content, have = next(iter(open_[room].items()))
                k = min(have, n)
                if k == have:
                    del open_[room][content]
                    if not open_[room]:
                        rooms.pop(at)
                else:
                    open_[room][content] = have - k
                put(room - s, (*content, s), k)
            else:
                a_box = capacity // s
                k = n // a_box
                if k:
                    put(capacity - a_box * s, (s,) * a_box, k)
                    n -= k * a_box
                if n:
                    put(capacity - n * s, (s,) * n, 1)
                k = n
            n -= k
    return [(c, n) for by in open_.values() for c, n in by.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, seed: int = 7) -> list[tuple[tuple[int, ...], int]]:
    """(sizes of a container, number of such containers) for a histogram of sizes 1..capacity."""
    left = np.zeros(capacity + 1)
    for s, n in histogram.items():
        if s > 0:
            left[s] += n
    out: list[tuple[tuple[int, ...], int]] = []
    rng = np.random.default_rng(seed)
    for _ in range(FITS):
        patterns = _patterns(left, capacity, PATTERNS, rng)
        if not patterns:
            break
        counts = fit_counts(patterns, left, STEPS)
        made = 0
        for j in np.argsort(-counts, kind="stable"):
            want = int(np.floor(counts[j] + 0.5))
            if want <= 0:
                break
            sizes, times = np.unique(patterns[j], return_counts=True)
            k = int(min(want, (left[sizes] // times).min()))
            if k > 0:
                left[sizes] -= k * times
                out.append((patterns[j], k))
                made += k
        if made == 0:
            break
    return out + _best_fit(left, capacity)


def _plan_rows(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """size, first rank, end rank, first container, items of that size in each: where ranks go."""
    at: dict[int, int] = defaultdict(int)
    rows, base = [], 1
    for sizes, k in planned:
        for s, m in zip(*np.unique(sizes, return_counts=True), strict=True):
            s, m = int(s), int(m)
            rows.append((s, at[s], at[s] + m * k, base, m))
            at[s] += m * k
        base += k
    return rows


def _ranked(items: DataFrame, total: int) -> DataFrame:
    """items with `rank`, 0.. within their size; a size that holds most items is ranked in slots."""
    slots = max(1, -(-total // ITEMS_A_SLOT))
    items = items.withColumn("slot", F.pmod(F.xxhash64("id", "piece_no"), F.lit(slots)).cast("int"))
    counts = items.groupBy("size", "slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("size", "slot").orderBy("id", "piece_no")
    numbered = items.withColumn("r", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["size", "slot"]).withColumn("rank", F.col("r") + F.col("offset")).drop("slot", "r", "offset")


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """id, piece_no, first_token, size, container_id for sizes (id, tokens)."""
    items = stored(pieces(sizes, capacity), "pieces")
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}
    planned = plan({s: n for s, n in histogram.items() if s}, capacity)
    rows = _plan_rows(planned)
    if 0 in histogram:
        rows.append((0, 0, histogram[0], 0, histogram[0]))
    spark = items.sparkSession
    # a size's ranks in as many stretches as the plan has rows of it, so that an item meets about two of them
    times: dict[int, int] = defaultdict(int)
    for r in rows:
        times[r[0]] += 1
    width = {s: max(1, -(-histogram[s] // times[s])) for s in times}
    cut = [(s, k, lo, hi, base, m) for s, lo, hi, base, m in rows for k in range(lo // width[s], (hi - 1) // width[s] + 1)]
    # as many rows as the plan has pairs of pattern and size, twice at most, which capacity and PATTERNS bound
    where = F.broadcast(spark.createDataFrame(cut, "size int, stretch bigint, lo bigint, hi bigint, base bigint, times bigint"))
    wide = F.broadcast(spark.createDataFrame(sorted(width.items()), "size int, width bigint"))  # a row a size
    ranked = _ranked(items, sum(histogram.values())).join(wide, "size").withColumn("stretch", F.floor(F.col("rank") / F.col("width")))
    placed = ranked.join(where, ["size", "stretch"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    container = F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.greatest(F.col("times"), F.lit(1)))
    return placed.select("id", "piece_no", "first_token", "size", container.cast("bigint").alias("container_id"))
