"""Images as rows: an array a band, worked on in Arrow batches, or long pixels worked on by the engine.

An image row has image_id and bands of `height * width` values, row by row (arrays). Defined cases: null, NaN and values at or
below NODATA_DB are no data; an image whose array has another length than its size says gives nothing but is named in
`rejected`; nothing is resized or padded: a chip that doesn't fit is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelorus.functions.radar import lookup
from pelorus.operators.detection import bright_regions, local_contrast

NODATA_DB = -60.0


def rejected(images: DataFrame, *bands: str) -> DataFrame:
    """image_id of images with a band whose length isn't height times width."""
    wrong = [~F.coalesce(F.size(b) == F.col("height") * F.col("width"), F.lit(False)) for b in bands]
    out = wrong[0]
    for w in wrong[1:]:
        out |= w
    return images.where(out).select("image_id")


def _sound(images: DataFrame, *bands: str) -> DataFrame:
    ok = F.lit(True)
    for b in bands:
        ok &= F.coalesce(F.size(b) == F.col("height") * F.col("width"), F.lit(False))
    return images.where(ok)


def pixels(images: DataFrame, band: str) -> DataFrame:
    """image_id, row, col, value of every pixel; no Python."""
    spread = _sound(images, band).select("image_id", "width", F.posexplode(band).alias("n", "value"))
    return spread.select("image_id", F.floor(F.col("n") / F.col("width")).cast("int").alias("row"), F.pmod("n", "width").cast("int").alias("col"), F.col("value").cast("double").alias("value"))


def _over_images(images: DataFrame, bands: list[str], schema: str, work) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                arrays = [np.array([np.nan if v is None else v for v in getattr(r, k)], float).reshape(r.height, r.width) for k in bands]
                rows.extend((r.image_id, *out) for out in work(*arrays))
            yield pd.DataFrame(rows, columns=names)

    return _sound(images, *bands).select("image_id", "height", "width", *bands).mapInPandas(run, schema)


def peak_places(a: np.ndarray, least: float) -> np.ndarray:
    """(row, col) of pixels above `least` that no neighbour of eight exceeds."""
    padded = np.pad(np.where(np.isnan(a), -np.inf, a), 1, constant_values=-np.inf)
    around = np.max([padded[1 + dr : 1 + dr + a.shape[0], 1 + dc : 1 + dc + a.shape[1]] for dr in (-1, 0, 1) for dc in (-1, 0, 1)], axis=0)
    return np.argwhere((padded[1:-1, 1:-1] == around) & (padded[1:-1, 1:-1] > least))


def peaks(images: DataFrame, band: str, least: float) -> DataFrame:
    """image_id, row, col, score of the peaks of a score map: equal to the greatest of their 3 by 3 and above `least`."""
    return _over_images(images, [band], "image_id bigint, row int, col int, score double", lambda a: ((int(r), int(c), float(a[r, c])) for r, c in peak_places(a, least)))


def contrast(images: DataFrame, band: str, outer: int, inner: int) -> DataFrame:
    """image_id, row, col, contrast_db of pixels whose whole ring is data: dB over the mean power of the ring."""

    def work(a: np.ndarray):
        c = local_contrast(a, outer, inner)
        return ((int(r), int(k), float(c[r, k])) for r, k in np.argwhere(~np.isnan(c)))

    return _over_images(images, [band], "image_id bigint, row int, col int, contrast_db double", work)


def bright(images: DataFrame, bands: list[str], thresholds: list[float], outer: int = 30, inner: int = 5) -> DataFrame:
    """image_id, row, col, pixels, margin_db of 8-connected regions over either band's threshold, at their first peak."""

    def work(*arrays: np.ndarray):
        valid = np.all([np.isfinite(a) & (a > NODATA_DB) for a in arrays], axis=0)
        contrasts = [local_contrast(np.where(valid, a, np.nan), outer, inner) for a in arrays]
        for r in bright_regions(contrasts, thresholds):
            yield r["row"], r["col"], r["pixels"], max(x - t for x, t in zip(r["contrast_db"], thresholds, strict=True))

    return _over_images(images, bands, "image_id bigint, row int, col int, pixels int, margin_db double", work)


def valid_points(points: DataFrame, px: DataFrame, zero_is_data: bool) -> DataFrame:
    """points (image_id, row, col, …) with `valid`: they lie on a pixel that holds a finite number, and not zero unless that is data."""
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")) & (F.lit(zero_is_data) | (F.col("value") != 0))
    met = points.join(px.select("image_id", "row", "col", ok.alias("_ok")), ["image_id", "row", "col"], "left")
    return met.withColumn("valid", F.coalesce("_ok", F.lit(False))).drop("_ok")


# ---- noise and calibration ----


def calibrated(px: DataFrame, table: tuple[np.ndarray, np.ndarray, np.ndarray], row: str = "row", col: str = "col") -> DataFrame:
    """px with `a`: the value of a table over irregular lines and pixels at each place, bilinear and clamped."""
    value = F.pandas_udf(lookup(*(np.asarray(v, float) for v in table)), "double")
    return px.withColumn("a", value(F.col(row).cast("double"), F.col(col).cast("double")))


def between(x: Column, xs: list[float], ys: list[float], outside: str = "clamp") -> Column:
    """Linear interpolation in a short sorted table, as a column: clamped, carried on, or null outside it."""
    if len(xs) < 2 or any(b <= a for a, b in zip(xs, xs[1:], strict=False)):
        raise ValueError("a table needs two places and more, in order")
    leg = lambda i: F.lit(float(ys[i])) + (x - float(xs[i])) * float((ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]))
    low = {"clamp": F.lit(float(ys[0])), "extend": leg(0), "null": F.lit(None).cast("double")}[outside]
    high = {"clamp": F.lit(float(ys[-1])), "extend": leg(len(xs) - 2), "null": F.lit(None).cast("double")}[outside]
    out = F.when(x < float(xs[0]), low)
    for i in range(len(xs) - 1):
        out = out.when(x <= float(xs[i + 1]), leg(i))
    return out.otherwise(F.when(x.isNotNull(), high))


def noise_power(px: DataFrame, ranges: tuple[list[float], list[float]], blocks: list[tuple[int, int, int, int, list[float], list[float]]]) -> DataFrame:
    """px (row, col) with `noise` and `covers`: range noise by column times azimuth noise by row of the block a pixel lies in.

    blocks: first row, last row, first column, last column, rows, values. A pixel that isn't in exactly one block has no noise.
    """
    inside = [F.col("row").between(b[0], b[1]) & F.col("col").between(b[2], b[3]) for b in blocks]
    azimuth = F.coalesce(*[F.when(i, between(F.col("row").cast("double"), b[4], b[5])) for i, b in zip(inside, blocks, strict=True)])
    covers = sum((i.cast("int") for i in inside[1:]), inside[0].cast("int"))
    return px.withColumn("covers", covers).withColumn("noise", F.when(covers == 1, between(F.col("col").cast("double"), *ranges) * azimuth))


def corrected_db(dn: Column, noise: Column, a: Column) -> Column:
    """Backscatter in dB with the noise taken off, power not below zero; floor 1e-10."""
    return 10 * F.log10(F.greatest(F.lit(1e-10), F.try_divide(F.greatest(F.lit(0.0), dn * dn - noise), a * a)))


# ---- places ----


def affine(col: Column, row: Column, t: tuple[float, float, float, float, float, float]) -> Column:
    """(lon, lat) of a pixel's upper left corner under (a, b, c, d, e, f): lon = a col + b row + c, lat = d col + e row + f."""
    return F.struct((col * t[0] + row * t[1] + t[2]).alias("lon"), (col * t[3] + row * t[4] + t[5]).alias("lat"))


def spline(cols, rows, values) -> tuple[np.ndarray, np.ndarray]:
    """Weights and affine part of the thin plate that passes through values at ground control points."""
    p = np.stack([np.asarray(cols, float), np.asarray(rows, float)], 1)
    n = len(p)
    k = _plate(p, p)
    q = np.c_[np.ones(n), p]
    a = np.block([[k, q], [q.T, np.zeros((3, 3))]])
    out = np.linalg.solve(a, np.r_[np.asarray(values, float), np.zeros(3)])
    return out[:n], out[n:]


def _plate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = ((a[:, None] - b[None]) ** 2).sum(-1)
    return np.where(d2 > 0, 0.5 * d2 * np.log(np.where(d2 > 0, d2, 1)), 0.0)


def georeferenced(px: DataFrame, points: list[tuple[float, float, float, float]], row: str = "row", col: str = "col") -> DataFrame:
    """px with lon, lat by a thin-plate spline over a few hundred ground control points (col, row, lon, lat)."""
    if len(points) < 3:
        raise ValueError("three control points and more")
    p = np.array(points, float)
    centre, size = p[:, :2].mean(0), np.maximum(np.ptp(p[:, :2], axis=0), 1.0)
    at = (p[:, :2] - centre) / size
    fits = [spline(at[:, 0], at[:, 1], p[:, k]) for k in (2, 3)]

    def place(c: pd.Series, r: pd.Series) -> pd.DataFrame:
        q = (np.stack([c.to_numpy(float), r.to_numpy(float)], 1) - centre) / size
        k, one = _plate(q, at), np.c_[np.ones(len(q)), q]
        return pd.DataFrame({"lon": k @ fits[0][0] + one @ fits[0][1], "lat": k @ fits[1][0] + one @ fits[1][1]})

    udf = F.pandas_udf(place, "lon double, lat double")
    return px.withColumn("_p", udf(F.col(col).cast("double"), F.col(row).cast("double"))).select(*px.columns, "_p.lon", "_p.lat")


# ---- chips, masks, comparisons ----


def chips(images: DataFrame, boxes: DataFrame, band: str, size: int) -> DataFrame:
    """image_id, box_id, chip of boxes (image_id, box_id, x0, y0, x1, y1): the size by size pixels about the box's middle.

    A chip that would leave the image or holds no data is null, with a reason; it is never moved or padded.
    """
    half = size // 2
    c0 = F.floor((F.col("x0") + F.col("x1")) / 2).cast("int") - half
    r0 = F.floor((F.col("y0") + F.col("y1")) / 2).cast("int") - half
    met = boxes.join(_sound(images, band), "image_id").withColumn("_c", c0).withColumn("_r", r0)
    fits = (F.col("_c") >= 0) & (F.col("_r") >= 0) & (F.col("_c") + size <= F.col("width")) & (F.col("_r") + size <= F.col("height"))
    lines = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.slice(F.col(band), (F.col("_r") + k) * F.col("width") + F.col("_c") + 1, F.lit(size)))
    cut = met.withColumn("_chip", F.when(fits, F.flatten(lines)))
    empty = F.exists("_chip", lambda v: v.isNull() | F.isnan(v.cast("double")) | (v <= NODATA_DB))
    reason = F.when(F.col("_chip").isNull(), "leaves_image").when(empty, "no_data")
    return cut.select("image_id", "box_id", F.when(reason.isNull(), F.col("_chip")).alias("chip"), reason.alias("reason"))


def array_statistics(rows: DataFrame, array: str) -> DataFrame:
    """rows with n, mean, sd (of a population), least, greatest and median of an array's numbers; no Python."""
    known = F.filter(F.transform(array, lambda v: v.cast("double")), lambda v: v.isNotNull() & ~F.isnan(v))
    d = rows.withColumn("_v", F.array_sort(known)).withColumn("_n", F.size("_v"))
    total = F.aggregate("_v", F.lit(0.0), lambda a, v: a + v)
    d = d.withColumn("_m", F.try_divide(total, F.col("_n")))
    spread = F.aggregate(F.transform("_v", lambda v: (v - F.col("_m")) ** 2), F.lit(0.0), lambda a, v: a + v)
    at = lambda k: F.get("_v", F.floor(k).cast("int"))
    median = (at((F.col("_n") - 1) / 2) + at(F.col("_n") / 2)) / 2
    return d.select(
        *rows.columns, F.col("_n").alias("n"), F.col("_m").alias("mean"), F.sqrt(F.try_divide(spread, F.col("_n"))).alias("sd"), F.array_min("_v").alias("least"), F.array_max("_v").alias("greatest"),
        F.when(F.col("_n") > 0, median).alias("median"),
    )


def ring_mask(px: DataFrame, boxes: DataFrame, guard: int, outer: int) -> DataFrame:
    """Pixels (image_id, row, col, valid) with the role of each for each box about it: object, ring or none.

    boxes: image_id, box_id, x0, y0, x1, y1. A box's ring is what lies within `outer` of it, without the pixels within `guard` of any
    box of the image; no data wins over all. One row for each pixel and box that it has a role for.
    """
    grown = lambda d: F.col("col").between(F.col("x0") - d, F.col("x1") + d) & F.col("row").between(F.col("y0") - d, F.col("y1") + d)
    # a pixel visits the boxes of its block only
    block = 64
    steps = lambda a, b: F.sequence(F.floor((F.col(a) - outer) / block), F.floor((F.col(b) + outer) / block))
    at = boxes.withColumn("_bx", F.explode(steps("x0", "x1"))).withColumn("_by", F.explode(steps("y0", "y1")))
    met = px.withColumn("_bx", F.floor(F.col("col") / block)).withColumn("_by", F.floor(F.col("row") / block)).join(at, ["image_id", "_bx", "_by"]).where(grown(outer))
    guarded = F.max(grown(guard).cast("int")).over(_pixel_window())
    role = F.when(~F.col("valid"), "no_data").when(grown(0), "object").when(guarded == 0, "ring")
    return met.withColumn("role", role).where("role is not null").select("image_id", "row", "col", "box_id", "role")


def _pixel_window():
    from pyspark.sql import Window

    return Window.partitionBy("image_id", "row", "col")


def compared(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """One row: how two pixel tables differ: pixels in both, in one only, greatest, mean and root-mean-square difference, beyond tolerance."""
    x = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ina"))
    y = b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_inb"))
    both = x.join(y, keys, "full").withColumn("d", F.col("_a") - F.col("_b"))
    met = F.col("_ina").isNotNull() & F.col("_inb").isNotNull()
    return both.agg(
        F.count_if(met).alias("both"), F.count_if(~met).alias("one_only"), F.max(F.abs("d")).alias("greatest"), F.avg("d").alias("mean"), F.sqrt(F.avg(F.col("d") ** 2)).alias("rms"),
        F.count_if(F.abs("d") > tolerance).alias("beyond"),
    )


# ---- images alike ----


def _symmetries(a: np.ndarray) -> Iterator[np.ndarray]:
    for m in (a, a.T):
        for k in range(4):
            yield np.rot90(m, k)


def _canonical(a: np.ndarray) -> np.ndarray:
    """The one of the eight turned and mirrored forms that is first in order, so that all eight have one."""
    return min(_symmetries(np.round(a, 6)), key=lambda m: m.ravel().tolist())


def alike_groups(images: DataFrame, band: str, least_correlation: float, most_rms: float, planes: int = 12, tables: int = 12, seed: int = 5) -> DataFrame:
    """image_id, label: images of equal content or alike under the eight symmetries have one label, also through others.

    Copies are one image first, by digest of the canonical form. The rest meet by signs of random projections of the
    normalised image under each symmetry (`tables` tables of `planes` signs), and are then compared in full. Pairs are
    sought among distinct images only; links, not images, make the groups.
    """
    from pelorus.operators.catalogue import components

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = [_canonical(np.array(getattr(r, band), float).reshape(r.height, r.width)) for r in b.itertuples(index=False)]
            yield b.assign(same=[hashlib.sha256(repr(m.shape).encode() + m.tobytes()).hexdigest() for m in forms])

    plain = _sound(images, band).select("image_id", "height", "width", F.col(band).cast("array<double>").alias(band))
    held = plain.mapInPandas(digests, f"image_id bigint, height int, width int, {band} array<double>, same string")
    first = held.groupBy("same").agg(F.min("image_id").alias("rep"))
    reps = held.join(first, "same").where("image_id = rep").select("image_id", "height", "width", band)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                a = np.array(getattr(r, band), float).reshape(r.height, r.width)
                rng = np.random.default_rng(seed)
                w = rng.standard_normal((tables * planes, a.size))
                for s, m in enumerate(_symmetries(a)):
                    v = m.ravel() - m.mean()
                    signs = (w @ v > 0).reshape(tables, planes)
                    for t in range(tables):
                        rows.append((r.image_id, s, f"{m.shape}{t}:{''.join('1' if x else '0' for x in signs[t])}"))
            yield pd.DataFrame(rows, columns=["image_id", "sym", "bucket"])

    seen = reps.mapInPandas(keys, "image_id bigint, sym int, bucket string")
    straight = seen.where("sym = 0").select(F.col("image_id").alias("a"), "bucket")
    turned = seen.select(F.col("image_id").alias("b"), "bucket")
    near = straight.join(turned, "bucket").where("a < b").select("a", "b").distinct()
    values = reps.select("image_id", "height", "width", band)
    pairs = near.join(values.select(F.col("image_id").alias("a"), F.col(band).alias("va"), "height", "width"), "a").join(
        values.select(F.col("image_id").alias("b"), F.col(band).alias("vb"), F.col("height").alias("hb"), F.col("width").alias("wb")), "b"
    )

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for r in b.itertuples(index=False):
                x = np.array(r.va, float).reshape(r.height, r.width)
                y = np.array(r.vb, float).reshape(r.hb, r.wb)
                ok = False
                for m in _symmetries(y):
                    if m.shape == x.shape and x.std() > 0 and m.std() > 0:
                        c = np.corrcoef(x.ravel(), m.ravel())[0, 1]
                        ok |= bool(c >= least_correlation and np.sqrt(np.mean((x - m) ** 2)) <= most_rms)
                keep.append(ok)
            yield b.loc[keep, ["a", "b"]]

    links = pairs.mapInPandas(alike, "a bigint, b bigint")
    labels = components(links)
    rep_label = held.join(first, "same").select("image_id", F.col("rep").alias("v")).join(labels, "v", "left")
    return rep_label.select("image_id", F.coalesce("label", "v").alias("label"))
