import numpy as np
import pytest

pytest.importorskip("pelorus.llm")
from pelorus.llm import packing as P  # noqa: E402


def check(histogram, capacity=P.CAPACITY):
    plan = P.plan(histogram, capacity)
    placed = {}
    for sizes, n in plan:
        assert n > 0 and sum(sizes) <= capacity
        for s in sizes:
            placed[s] = placed.get(s, 0) + n
    assert placed == {s: n for s, n in histogram.items() if s and n}
    return sum(n for _, n in plan)


def test_plans_hold_every_item_and_are_tight():
    rng = np.random.default_rng(6)
    sizes = np.clip(rng.lognormal(5.3, 0.9, 20_000).astype(int), 1, 2048)
    histogram = dict(zip(*[x.tolist() for x in np.unique(sizes, return_counts=True)], strict=True))
    used = check(histogram)
    assert used <= 1.001 * -(-int(sizes.sum()) // 2048) + 1


def test_awkward_histograms():
    assert check({}) == 0
    assert check({2048: 7}) == 7
    assert check({1025: 5}) == 5
    assert check({1: 5000}) == 3
    assert check({1500: 10, 548: 4, 3: 1}) <= 11
    assert check({7: 1_000_000, 2041: 1_000_000}) == 1_000_000


def test_texts_are_packed_whole(spark):
    long = "the harbour board met again and again " * 900
    rows = [(i, f"speech number {i} about the ferry " * (i % 60), "x") for i in range(300)]
    rows += [(1000, long, "x"), (1001, None, "x"), (1002, "", "x"), (1003, long, "x")]
    texts = spark.createDataFrame(rows, "id bigint, text string, size string").select("id", "text")
    sizes = {r.id: r.tokens for r in P.token_counts(texts).collect()}
    out = P.pack(P.token_counts(texts)).collect()
    by_id, fill = {}, {}
    for r in out:
        by_id.setdefault(r.id, []).append((r.piece_no, r.first_token, r.size))
        fill[r.container_id] = fill.get(r.container_id, 0) + r.size
    assert set(by_id) == set(sizes) and max(fill.values()) <= 2048 and fill[0] == 0
    for i, pieces in by_id.items():
        pieces.sort()
        assert sum(s for *_, s in pieces) == sizes[i]
        assert len(pieces) == max(1, -(-sizes[i] // 2048)) and [f for _, f, _ in pieces] == [2048 * k for k in range(len(pieces))]
    assert len([c for c in fill if c]) <= -(-sum(sizes.values()) // 2048) + 1
    assert P.pack(P.token_counts(texts.limit(0))).count() == 0


def test_ranks_of_a_size_that_holds_most_items(spark):
    items = spark.range(500).selectExpr("id", "0 piece_no", "0L first_token", "cast(if(id % 5 = 0, 9, 4) as int) size")
    old, P.ITEMS_A_SLOT = P.ITEMS_A_SLOT, 50
    try:
        ranks = {}
        for r in P._ranked(items, 500).collect():
            ranks.setdefault(r.size, []).append(r["rank"])
    finally:
        P.ITEMS_A_SLOT = old
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())
