import numpy as np
import pytest
from pyspark.sql import functions as F

from pelorus.operators import raster as R

SCHEMA = "image_id bigint, height int, width int, band array<double>, row string"


def images(spark, *arrays):
    return spark.createDataFrame([(i, *a.shape, [None if np.isnan(v) else float(v) for v in a.ravel()], "x") for i, a in enumerate(arrays)], SCHEMA)


def test_peaks_at_edges_on_plateaus_and_without_data(spark):
    a = np.zeros((4, 5))
    a[0, 0], a[2, 2], a[2, 3], a[3, 4] = 5, 7, 7, np.nan
    got = sorted((r.row, r.col) for r in R.peaks(images(spark, a), "band", 1.0).collect())
    assert got == [(0, 0), (2, 2), (2, 3)]
    broken = spark.createDataFrame([(9, 2, 2, [1.0], "x"), (8, 2, 2, None, "x")], SCHEMA)
    assert R.peaks(broken, "band", 0.0).count() == 0 and sorted(r.image_id for r in R.rejected(broken, "band").collect()) == [8, 9]


def test_bright_regions_need_a_whole_ring_and_join_over_corners(spark):
    a = np.full((12, 12), -20.0)
    a[5, 5] = a[6, 6] = 0.0
    a[0, 0] = 0.0  # its ring isn't whole
    b = a.copy()
    b[5, 8] = np.nan  # no data in the ring of both
    got = {r.image_id: (r.row, r.col, r.pixels) for r in R.bright(images(spark, a, b), ["band"], [6.0], 3, 1).collect()}
    assert got == {0: (5, 5, 2)}


def test_tables_clamp_carry_on_or_end(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 2.5, 5.0, None)], "x double")
    out = {k: [r[0] for r in df.select(R.between(F.col("x"), [0.0, 2.0, 3.0], [0.0, 4.0, 5.0], k)).collect()] for k in ("clamp", "extend", "null")}
    assert out == {"clamp": [0.0, 0.0, 2.0, 4.5, 5.0, None], "extend": [-2.0, 0.0, 2.0, 4.5, 7.0, None], "null": [None, 0.0, 2.0, 4.5, None, None]}
    with pytest.raises(ValueError):
        R.between(F.col("x"), [0.0, 0.0], [1.0, 2.0])


def test_the_spline_passes_through_its_points(spark):
    rng = np.random.default_rng(2)
    points = [(float(c), float(r), -52 + c / 100 + rng.normal(0, 1e-3), 48 - r / 100 + rng.normal(0, 1e-3)) for c in range(0, 100, 25) for r in range(0, 100, 25)]
    px = spark.createDataFrame([(c, r) for c, r, _, _ in points], "col double, row double")
    got = {(p.col, p.row): (p.lon, p.lat) for p in R.georeferenced(px, points).collect()}
    assert all(np.allclose(got[c, r], (lo, la), atol=1e-9) for c, r, lo, la in points)


def test_noise_counts_only_where_one_block_covers(spark):
    px = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 0)], "row int, col int")
    out = {r.row: (r.covers, r.noise) for r in R.noise_power(px, ([0.0, 1.0], [2.0, 4.0]), [(0, 1, 0, 5, [0.0, 1.0], [1.0, 3.0]), (1, 2, 0, 5, [1.0, 2.0], [5.0, 5.0])]).collect()}
    assert out == {0: (1, 2.0), 1: (2, None), 2: (1, 10.0), 3: (0, None)}


def test_chips_are_never_moved_or_padded(spark):
    a = np.arange(25.0).reshape(5, 5)
    a[4, 4] = np.nan
    boxes = spark.createDataFrame([(0, 1, 1, 1, 3, 3), (0, 2, 0, 0, 1, 1), (0, 3, 3, 3, 3, 3), (7, 4, 1, 1, 2, 2)], "image_id bigint, box_id bigint, x0 int, y0 int, x1 int, y1 int")
    got = {r.box_id: (r.chip, r.reason) for r in R.chips(images(spark, a), boxes, "band", 3).collect()}
    assert got == {1: ([6.0, 7.0, 8.0, 11.0, 12.0, 13.0, 16.0, 17.0, 18.0], None), 2: (None, "leaves_image"), 3: (None, "no_data")}


def test_statistics_of_arrays_with_nulls_and_without_any(spark):
    df = spark.createDataFrame([([1.0, None, 3.0, float("nan"), 8.0],), ([],), (None,)], "a array<double>")
    a, b, c = R.array_statistics(df, "a").collect()
    assert (a.n, a.mean, a.median, a.least, a.greatest) == (3, 4.0, 3.0, 1.0, 8.0) and abs(a.sd - np.std([1, 3, 8])) < 1e-12
    assert b.n == 0 and b.mean is None and b.median is None and c.mean is None


def test_alike_images_under_turns_noise_and_chains(spark):
    rng = np.random.default_rng(4)
    base = [rng.normal(0, 1, (6, 6)) for _ in range(12)]
    noisy = base[0] + rng.normal(0, 0.01, (6, 6))
    chain = noisy + rng.normal(0, 0.01, (6, 6))
    all_ = [*base, np.rot90(base[1]), base[2].T, noisy, np.flipud(chain), base[3] * 5]
    got = {r.image_id: r.label for r in R.alike_groups(images(spark, *all_), "band", 0.995, 0.05).collect()}
    assert len(got) == len(all_) and got[12] == got[1] and got[13] == got[2] and got[14] == got[0] == got[15] and got[16] == 16
    assert len({got[k] for k in range(12)}) == 12
    assert R.alike_groups(images(spark, base[0]).limit(0), "band", 0.9, 1.0).count() == 0


def test_comparing_tables(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, value double")
    b = spark.createDataFrame([(1, 1.5), (2, 2.0), (4, 3.0)], "k int, value double")
    r = R.compared(a, b, ["k"], "value", 0.1).first()
    assert (r.both, r.one_only, r.greatest, r.mean, r.beyond) == (2, 2, 0.5, -0.25, 1) and abs(r.rms - 0.125**0.5) < 1e-12
