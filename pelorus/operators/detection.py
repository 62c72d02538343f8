"""Detections on images: tiles, peaks, suppression of doubles, local contrast."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windows(images: DataFrame, width: Column, height: Column, tile: int, overlap: int) -> DataFrame:
    """images with (col, row, w, h) of sliding windows; the last ones are cut at the edge."""
    if not 0 <= overlap < tile:
        raise ValueError("overlap must be at least 0 and below the tile")
    step = tile - overlap
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(step))
    out = images.withColumn("col", F.explode(starts(width))).withColumn("row", F.explode(starts(height)))
    return out.withColumn("w", F.least(F.lit(tile), width - F.col("col"))).withColumn("h", F.least(F.lit(tile), height - F.col("row")))


def fixed_tiles(images: DataFrame, width: Column, height: Column, tile: int, overlap: int) -> DataFrame:
    """images with (col, row) of whole tiles; the last ones are moved inside."""
    step = tile - overlap
    starts = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(step)), lambda x: F.greatest(F.lit(0), F.least(x, n - tile))))
    return images.withColumn("col", F.explode(starts(width))).withColumn("row", F.explode(starts(height)))


def keep_best(x0, y0, x1, y1, score, most_iou: float) -> np.ndarray:
    """Which boxes stay: by score downwards, each box that overlaps a kept one by most_iou or more is dropped."""
    order = np.argsort(-score, kind="stable")
    area = (x1 - x0) * (y1 - y0)
    keep = np.zeros(len(score), bool)
    alive = np.ones(len(score), bool)
    for i in order:
        if not alive[i]:
            continue
        keep[i] = True
        w = np.clip(np.minimum(x1[i], x1) - np.maximum(x0[i], x0), 0, None)
        h = np.clip(np.minimum(y1[i], y1) - np.maximum(y0[i], y0), 0, None)
        both = w * h
        union = area[i] + area - both
        alive &= ~((both > 0) & (both >= most_iou * union))
    return keep


def suppress(boxes: DataFrame, by: list[str], most_iou: float = 0.5) -> DataFrame:
    """boxes (x0, y0, x1, y1, score) that greedy suppression within each image and class keeps; of equal scores the first by the other columns."""
    tied = [c for c in boxes.columns if c not in (*by, "score")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", *tied], ascending=[False] + [True] * len(tied), kind="stable")
        v = [frame[c].to_numpy(float) for c in ("x0", "y0", "x1", "y1", "score")]
        return frame[keep_best(*v, most_iou)]

    return boxes.groupBy(*by).applyInPandas(run, boxes.schema)


def keep_apart(col, row, score, tile, radius: float) -> np.ndarray:
    """Which points stay: by score downwards, one nearer than radius to a kept one of another tile is dropped."""
    order = np.argsort(-score, kind="stable")
    grid: dict[tuple[int, int], list[int]] = defaultdict(list)
    keep = np.zeros(len(score), bool)
    for i in order:
        gx, gy = int(col[i] // radius), int(row[i] // radius)
        near = (j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in grid.get((gx + dx, gy + dy), ()))
        if any((col[i] - col[j]) ** 2 + (row[i] - row[j]) ** 2 < radius**2 and (tile[i] is None or tile[j] is None or tile[i] != tile[j]) for j in near):
            continue
        keep[i] = True
        grid[(gx, gy)].append(i)
    return keep


def apart(points: DataFrame, by: list[str], radius: float = 6.0) -> DataFrame:
    """points (col, row, score, tile) without the doubles that overlapping tiles make; of equal scores the first by the other columns stays."""
    tied = [c for c in points.columns if c not in (*by, "score")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", *tied], ascending=[False] + [True] * len(tied), kind="stable")
        tile = [None if pd.isna(t) else t for t in frame["tile"]]
        return frame[keep_apart(frame["col"].to_numpy(float), frame["row"].to_numpy(float), frame["score"].to_numpy(float), tile, radius)]

    return points.groupBy(*by).applyInPandas(run, points.schema)


def _box_sum(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2r+1, at places whose square lies inside; else NaN."""
    s = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    s[1:, 1:] = a.cumsum(0).cumsum(1)
    out = np.full(a.shape, np.nan)
    n = 2 * r + 1
    if min(a.shape) >= n:
        out[r : a.shape[0] - r, r : a.shape[1] - r] = s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]
    return out


def local_contrast(db: np.ndarray, outer: int = 30, inner: int = 5) -> np.ndarray:
    """dB of each pixel over the mean power of the ring around it; NaN where the ring isn't whole and valid."""
    valid = np.isfinite(db) & (db > -60)
    power = np.where(valid, 10 ** (np.where(valid, db, 0) / 10), 0.0)
    ring = _box_sum(power, outer) - _box_sum(power, inner)
    count = _box_sum(valid.astype(float), outer) - _box_sum(valid.astype(float), inner)
    whole = (2 * outer + 1) ** 2 - (2 * inner + 1) ** 2
    with np.errstate(all="ignore"):
        out = np.where(valid, db, np.nan) - 10 * np.log10(np.maximum(ring / whole, 1e-300))
    return np.where(np.nan_to_num(count) == whole, out, np.nan)


def bright_regions(contrasts: list[np.ndarray], thresholds: list[float]) -> list[dict]:
    """Regions of pixels (8-connected) above either band's threshold: size, peak place and contrast."""
    margin = np.max([np.nan_to_num(c, nan=-np.inf) - t for c, t in zip(contrasts, thresholds, strict=True)], axis=0)
    hot = np.argwhere(margin >= 0)
    place = {(int(r), int(c)): k for k, (r, c) in enumerate(hot)}
    up = list(range(len(hot)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for (r, c), k in place.items():
        for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
            j = place.get((r + dr, c + dc))
            if j is not None:
                a, b = top(k), top(j)
                up[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = defaultdict(list)
    for k in range(len(hot)):
        groups[top(k)].append(k)
    out = []
    for members in groups.values():
        peak = max(members, key=lambda k: (margin[tuple(hot[k])], -k))
        r, c = map(int, hot[peak])
        out.append({"row": r, "col": c, "pixels": len(members), "contrast_db": [float(x[r, c]) for x in contrasts]})
    return out


def mock_scores(pixels: DataFrame, co: Column, cross: Column, least_co: float, least_cross: float) -> DataFrame:
    """Pixels over both thresholds as detections: a score by place and a box of five pixels."""
    hit = pixels.where((co >= least_co) & (cross >= least_cross))
    score = F.lit(0.65) + (F.pmod(F.col("row") + F.col("col"), F.lit(100))) / 285.0
    return hit.select("image_id", "row", "col", score.alias("score"), *[(F.col(c) + d).alias(n) for n, c, d in (("x0", "col", -2.5), ("y0", "row", -2.5), ("x1", "col", 2.5), ("y1", "row", 2.5))])
