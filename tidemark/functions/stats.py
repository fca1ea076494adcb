"""Statistics as Column expressions and small DataFrame steps."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import order as O


def share(condition: Column) -> Column:
    """Aggregate: the share of rows for which condition holds (null: not)."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def with_pct_rank(df: DataFrame, column: str, out: str, by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Average rank over the number of non-null values (one less that, if descending); nulls have none."""
    rank = (F.col("_upto") - (F.col("_n") - 1) / 2.0) / F.col("_total")
    return O.with_rank(df, column, 1 - rank if descending else rank, out, by)


def wilson_lower(hits: Column, n: Column) -> Column:
    """Lower bound of a share at z = 1.96, with a centre of 1.9208 / 2n as the seed ranking defines it."""
    p = hits / n
    return (p + 1.9208 / (2 * n) - 1.96 * F.sqrt((p * (1 - p) + 0.9604 / n) / n)) / (1 + 3.8416 / n)


def wilson_interval(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, zz = hits / n, z * z
    middle, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return middle - half, middle + half


def required_sample_size(p: float, half_width: float, z: float = 1.96, most: int = 1_000_000) -> int:
    """The smallest n whose Wilson interval of share p is no wider than half_width to a side."""
    lo, hi = 1, most
    while lo < hi:
        n = (lo + hi) // 2
        half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
        lo, hi = (lo, n) if half <= half_width else (n + 1, hi)
    return lo


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! by Stirling's series from 10 up and exactly below."""
    x = np.maximum(n, 10.0) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 10, _FIRST[np.clip(n, 0, 9).astype(int)], series)


_FIRST = np.array([math.lgamma(i + 1) for i in range(10)])


def _summed(ratio: Callable[[np.ndarray, int], np.ndarray], rows: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """1 + r1 + r1 r2 + ... of so many terms a row; ratio gives the i-th of the rows asked for."""
    out, term, live, i = np.zeros(len(rows)), np.ones(len(rows)), np.arange(len(rows)), 0
    while len(live):
        i += 1
        out[live] += term[live]
        term[live] *= ratio(rows[live], i)
        live = live[(i < steps[live]) & (term[live] > 1e-18 * out[live])]
    return out


def _poisson_tail(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    p = np.where(x <= 0, 1.0, 0.0)

    def term(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.exp(k * np.log(mean[i]) - mean[i] - _log_factorial(k))

    up, down = np.flatnonzero((x > 0) & (mean > 0) & (x > mean)), np.flatnonzero((x > 0) & (mean > 0) & ~(x > mean))
    p[up] = term(up, x[up]) * _summed(lambda r, i: mean[r] / (x[r] + i), up, 12 * np.sqrt(mean[up] + 1) + 60)
    p[down] = 1 - term(down, x[down] - 1) * _summed(lambda r, i: np.maximum(x[r] - i, 0) / mean[r], down, np.maximum(x[down], 1))
    return np.where(np.isnan(x) | np.isnan(mean), np.nan, p)


def _hypergeometric_tail(x: np.ndarray, total: np.ndarray, good: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    top, low = np.minimum(good, drawn), np.maximum(drawn - (total - good), 0)
    mean = good * drawn / np.maximum(total, 1)

    def choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
        return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)

    def term(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.exp(choose(good[i], k) + choose(total[i] - good[i], drawn[i] - k) - choose(total[i], drawn[i]))

    def rising(r: np.ndarray, i: int) -> np.ndarray:  # the i-th term is that of x + i - 1
        k = x[r] + i - 1
        return np.maximum(good[r] - k, 0) * np.maximum(drawn[r] - k, 0) / ((k + 1) * np.maximum(total[r] - good[r] - drawn[r] + k + 1, 1))

    def falling(r: np.ndarray, i: int) -> np.ndarray:  # the i-th term is that of x - i
        k = x[r] - i
        return np.maximum(k, 0) * np.maximum(total[r] - good[r] - drawn[r] + k, 0) / (np.maximum(good[r] - k + 1, 1) * np.maximum(drawn[r] - k + 1, 1))

    inside = (x > low) & (x <= top)
    p = np.where(x <= low, 1.0, 0.0)
    up, down = np.flatnonzero(inside & (x > mean)), np.flatnonzero(inside & ~(x > mean))
    p[up] = term(up, x[up]) * _summed(rising, up, 12 * np.sqrt(mean[up] + 1) + 60)
    p[down] = 1 - term(down, x[down] - 1) * _summed(falling, down, 12 * np.sqrt(mean[down] + 1) + 60)
    return np.where(np.isnan(x) | np.isnan(total) | np.isnan(good) | np.isnan(drawn), np.nan, np.minimum(p, 1.0))


def poisson_tail(x: Column, mean: Column) -> Column:
    """P(X >= x) for whole x.

    Above the mean the terms from x upward shrink and are summed by their ratio; below it the lower
    tail is summed downward and taken from one. First terms in logarithms. In numpy, a batch at a time.
    """

    @F.pandas_udf("double")
    def tail(x: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series(_poisson_tail(x.to_numpy(float), mean.to_numpy(float)))

    return tail(x.cast("double"), mean.cast("double"))


def hypergeometric_tail(x: Column, total: Column, good: Column, drawn: Column) -> Column:
    """P(X >= x): x or more of `good` among `drawn` out of `total`.

    As for Poisson: above the mean the terms from x upward shrink and are summed by their ratio, below it
    the lower tail is taken from one. The spread is no wider than a Poisson's of that mean.
    """

    @F.pandas_udf("double")
    def tail(x: pd.Series, total: pd.Series, good: pd.Series, drawn: pd.Series) -> pd.Series:
        return pd.Series(_hypergeometric_tail(*(c.to_numpy(float) for c in (x, total, good, drawn))))

    return tail(*(c.cast("double") for c in (x, total, good, drawn)))


def benjamini_hochberg(df: DataFrame, p: str, out: str, alpha: float) -> DataFrame:
    """out: whether p is at most the largest p_(k) with p_(k) <= k * alpha / m."""
    cut = O.value_counts(df, p).where(F.col(p) <= F.col("_upto") * alpha / F.col("_total")).agg(F.max(p).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn(out, F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def kappa(agree: Column, expected: Column) -> Column:
    return (agree - expected) / (1 - expected)


def entropy(shares: Column) -> Column:
    """Shannon entropy in nats of an array of shares."""
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log(p)).otherwise(0.0))
