"""Normal and binomial functions that SQL lacks, small and exact, and their Arrow forms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

# Types are objects: workers import this module and can't parse type strings.
_INTERVAL = T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])


def cdf(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in np.ravel(x)]).reshape(np.shape(x))


def ppf(p: np.ndarray) -> np.ndarray:
    """Inverse of cdf; 0 and 1 give infinities.

    A rational start by the tail (Abramowitz and Stegun 26.2.23, within 5e-4)
    and two steps of Halley's method with the exact distribution function.
    """
    p = np.asarray(p, float)
    inside = (p > 0) & (p < 1)
    q = np.where(inside, p, 0.5)
    tail = np.minimum(q, 1 - q)
    t = np.sqrt(-2 * np.log(tail))
    x = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    for _ in range(2):
        # x is the upper tail's place, so the difference keeps its digits far out.
        step = (tail - cdf(-x)) * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
        x = x - step / (1 + x * step / 2)
    return np.where(inside, np.where(q < 0.5, -x, x), np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, np.nan)))


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return pd.Series(cdf(x.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    return pd.Series(ppf(p.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def gaussian_crps(mean: pd.Series, std: pd.Series, truth: pd.Series) -> pd.Series:
    """CRPS of a normal forecast; the absolute error where std is 0."""
    d, s = truth.to_numpy(float) - mean.to_numpy(float), std.to_numpy(float)
    z = np.divide(d, s, out=np.zeros_like(d), where=s > 0)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return pd.Series(np.where(s > 0, s * (z * (2 * cdf(z) - 1) + 2 * density - 1 / math.sqrt(math.pi)), np.abs(d)))


def binomial_cdf(k: int, n: int, p: float) -> float:
    if k >= n or p <= 0:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return min(1.0, math.fsum(map(math.exp, logs)))


def clopper_pearson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """The exact interval of a share, by bisection on the binomial distribution."""
    tail = (1 - confidence) / 2

    def root(f) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) else (low, mid)
        return (low + high) / 2

    lower = 0.0 if k == 0 else root(lambda p: 1 - binomial_cdf(k - 1, n, p) < tail)
    upper = 1.0 if k == n else root(lambda p: binomial_cdf(k, n, p) > tail)
    return lower, upper


@F.pandas_udf(_INTERVAL)
def clopper_pearson_interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([clopper_pearson(int(a), int(b)) for a, b in zip(k, n, strict=True)], columns=["lower", "upper"])
