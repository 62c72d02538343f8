"""Exact intervals, confusion counts, block bootstrap, threshold choice, and a logistic fit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType


def _beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    gamma = np.vectorize(math.lgamma)
    with np.errstate(all="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        f = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
                f = f * c * d
        out = np.where(z <= 0, 0.0, front * f)
    return np.clip(np.where(flip, 1 - out, out), 0, 1)


def _beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.zeros(np.shape(a)), np.ones(np.shape(a))
    for _ in range(80):
        mid = (low + high) / 2
        below = _beta_share(a, b, mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def binomial_interval(k, n, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """The exact (Clopper-Pearson) interval of a share; NaN without trials."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    inner_low, inner_high = np.maximum(k, 1), np.maximum(n - k, 1)
    low = np.where(k > 0, _beta_quantile(alpha / 2, inner_low, n - k + 1), 0.0)
    high = np.where(k < n, _beta_quantile(1 - alpha / 2, k + 1, inner_high), 1.0)
    return np.where(n > 0, low, np.nan), np.where(n > 0, high, np.nan)


def poisson_interval(events, exposure, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """The exact interval of a rate: bounds of the mean by bisection on Poisson sums, over the exposure."""
    events, exposure = np.asarray(events, int), np.asarray(exposure, float)
    if ((exposure <= 0) & (events > 0)).any():
        raise ValueError("events without exposure")

    def below(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
        total = np.zeros_like(mean)
        for i, (kk, mu) in enumerate(zip(k, mean, strict=True)):
            j = np.arange(int(kk) + 1)
            logs = j * math.log(mu) - mu - np.array([math.lgamma(x + 1) for x in j]) if mu > 0 else np.where(j == 0, 0.0, -np.inf)
            total[i] = np.exp(logs).sum()
        return total

    def solve(k: np.ndarray, p: float) -> np.ndarray:
        low, high = np.zeros(len(k)), k + 10 * np.sqrt(k + 1.0) + 20
        for _ in range(80):
            mid = (low + high) / 2
            more = below(k, mid) > p
            low, high = np.where(more, mid, low), np.where(more, high, mid)
        return (low + high) / 2

    k = np.atleast_1d(events)
    lower = np.where(k > 0, solve(np.maximum(k - 1, 0), 1 - alpha / 2), 0.0)
    upper = solve(k, alpha / 2)
    e = np.atleast_1d(exposure)
    with np.errstate(all="ignore"):
        return np.where(e > 0, lower / e, np.nan), np.where(e > 0, upper / e, np.nan)


@pandas_udf(StructType([StructField("low", DoubleType()), StructField("high", DoubleType())]))
def share_interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    low, high = binomial_interval(k.fillna(0), n.fillna(0))
    return pd.DataFrame({"low": low, "high": high}).astype(object).where(lambda d: d.notna(), None).astype(float)


def confusion(rows: DataFrame, by: list[str], truth: Column, score: Column, threshold: Column) -> DataFrame:
    """Counts and ratios of scores above a threshold against the truth; a ratio over nothing is null."""
    hit = score > threshold
    out = rows.groupBy(*by).agg(
        F.count_if(truth & hit).alias("tp"), F.count_if(~truth & hit).alias("fp"), F.count_if(truth & ~hit).alias("fn"), F.count_if(~truth & ~hit).alias("tn")
    )
    return out.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})


def at_thresholds(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """rows once for each of a short list of thresholds; no join."""
    return rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def best_threshold(metrics: DataFrame, by: list[str], least_recall: float) -> DataFrame:
    """By group the threshold of the highest recall, then fewest false alarms, then the smallest; if recall suffices."""
    ok = metrics.where(F.col("recall") >= least_recall)
    best = F.max_by(F.struct("threshold", "recall", "fp"), F.struct(F.col("recall"), -F.col("fp"), -F.col("threshold")))
    return ok.groupBy(*by).agg(best.alias("b")).select(*by, "b.threshold", "b.recall", "b.fp")


def block_bootstrap(blocks: DataFrame, numerator: str, denominator: str, draws: int = 2000, seed: int = 0, alpha: float = 0.05, most: int = 100_000):
    """Interval of a ratio of sums, drawing whole blocks; None below five blocks. Blocks are sums already."""
    rows = blocks.select(numerator, denominator).orderBy(numerator, denominator).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} blocks")
    if len(rows) < 5:
        return None
    a, b = np.array([[float(r[0]), float(r[1])] for r in rows]).T
    rng = np.random.default_rng(seed)
    ratios = []
    for _ in range(draws):
        i = rng.integers(0, len(a), len(a))
        if b[i].sum() > 0:
            ratios.append(a[i].sum() / b[i].sum())
    return tuple(np.quantile(ratios, [alpha / 2, 1 - alpha / 2])) if ratios else None


def logistic(rows: DataFrame, features: str, label: str, penalty: float = 0.01):
    """A logistic regression with an L2 penalty on the weights, not on the intercept."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol=features, labelCol=label, regParam=penalty, elasticNetParam=0.0, standardization=False).fit(rows)
