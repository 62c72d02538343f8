"""Radar arithmetic as columns: calibration, normalisation, boxes, rings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sigma0_db(dn: Column, a: Column) -> Column:
    """Backscatter in dB of a digital number under a calibration value; no data is -60, the floor -100."""
    power = F.greatest(dn * dn / (a * a), F.lit(1e-10))
    return F.when(F.coalesce(dn, F.lit(0)) <= 0, -60.0).when(F.coalesce(a <= 0, F.lit(True)) | F.isnan(a), -100.0).otherwise(10 * F.log10(power))


def squash(db: Column) -> Column:
    """dB to 0..1."""
    return 1 / (1 + F.exp(-(db + 20.0) * 0.18))


def preview(db: Column) -> Column:
    """dB stretched to a byte."""
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (db + 30.0) / 35.0)) * 255).cast("int")


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes with x0, y0, x1, y1; 0 for boxes without area."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    both = w * h
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - both
    return F.coalesce(F.try_divide(both, area), F.lit(0.0))


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring of (x, y) structs: positive if it runs counter-clockwise."""
    n = F.size(ring)
    pairs = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / 2


def lookup(lines: np.ndarray, pixels: np.ndarray, values: np.ndarray):
    """A bilinear table over irregular lines and pixels, clamped at its edges, as a pandas function."""

    def at(axis: np.ndarray, x: np.ndarray):
        x = np.clip(x, axis[0], axis[-1])
        i = np.clip(np.searchsorted(axis, x, side="right") - 1, 0, max(0, len(axis) - 2))
        j = np.minimum(i + 1, len(axis) - 1)
        span = axis[j] - axis[i]
        return i, j, np.where(span > 0, (x - axis[i]) / np.where(span > 0, span, 1), 0.0)

    def value(line: pd.Series, pixel: pd.Series) -> pd.Series:
        i, i2, u = at(lines, line.to_numpy(float))
        j, j2, v = at(pixels, pixel.to_numpy(float))
        top = values[i, j] * (1 - v) + values[i, j2] * v
        low = values[i2, j] * (1 - v) + values[i2, j2] * v
        return pd.Series(top * (1 - u) + low * u)

    return value
