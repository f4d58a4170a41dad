"""Weighted least squares of any order, one fit for each group, however many rows a group has.

Polynomials are in Chebyshev form on [-1, 1].  As T_i T_j = (T_(i+j) + T_|i-j|) / 2, the normal matrix follows from the weighted sums of T_0 .. T_2m, so
one aggregation of 3m + 2 sums, combined before its shuffle, holds all that a fit needs; the solve is a small matrix for each group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 31
_TOLERANCE = 1e-12


def term(x: Column, k: int) -> Column:
    """T_k of x, which is held to [-1, 1]."""
    if k == 0:
        return F.lit(1.0)
    held = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return held if k == 1 else F.cos(k * F.acos(held))


def scaled(x: Column, low: Column | float, high: Column | float) -> Column:
    """From [low, high] to [-1, 1]; 0 where both are equal."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.coalesce(F.try_divide(2 * x.cast("double") - low - high, high - low), F.lit(0.0))


def _solver(order: int, fewer: bool):
    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, sums: pd.Series, right: pd.Series) -> pd.Series:
        out = [None] * len(n)
        for i, (k, s, r) in enumerate(zip(n, sums, right, strict=True)):
            size = min(order + 1, int(k)) if fewer else order + 1
            if size < 1 or k < size:
                continue
            s, r = np.asarray(s, float), np.asarray(r, float)[:size]
            j = np.arange(size)
            normal = (s[j[:, None] + j] + s[abs(j[:, None] - j)]) / 2
            if not np.isfinite(normal).all() or not np.isfinite(r).all():
                continue
            scale, vectors = np.linalg.eigh(normal)
            if scale[0] <= _TOLERANCE * scale[-1]:  # the points do not tell the coefficients apart
                continue
            out[i] = np.r_[vectors @ ((vectors.T @ r) / scale), np.zeros(order + 1 - size)].tolist()
        return pd.Series(out)

    return solve


def fitted(df: DataFrame, keys: list[str], x: Column, values: list[str], order: int, weight: Column | None = None, fewer: bool = False) -> DataFrame:
    """(keys.., n, c_<value>..): the Chebyshev coefficients of each value as array<double>, and the number of points.

    Points with a null or infinite x or value, or without a positive finite weight, don't count.  A fit with fewer points than
    coefficients, or whose points do not determine it, is null; with ``fewer`` a fit of few points has as many coefficients as points, the others are 0.
    Infinite and missing values are left out for all values together.
    """
    if not 0 <= order <= MOST:
        raise ValueError(f"orders from 0 to {MOST}")
    w = F.lit(1.0) if weight is None else weight.cast("double")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    d = df.select(*keys, x.cast("double").alias("__x"), w.alias("__w"), *(F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(values)))
    for c in ("__x", "__w", *(f"__v{i}" for i in range(len(values)))):
        d = d.filter(fine(F.col(c)))
    d = d.filter("__w > 0")
    t = [term(F.col("__x"), k) for k in range(2 * order + 1)]
    sums = [F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.col("__w") * t[k]) for k in range(2 * order + 1))).alias("__s")]
    sums += [F.array(*(F.sum(F.col("__w") * F.col(f"__v{i}") * t[k]) for k in range(order + 1))).alias(f"__r{i}") for i in range(len(values))]
    solve = _solver(order, fewer)
    return d.groupBy(*keys).agg(*sums).select(*keys, "n", *(solve("n", "__s", f"__r{i}").alias(f"c_{v}") for i, v in enumerate(values)))


def evaluated(coefficients: Column, x: Column, order: int) -> Column:
    """The polynomial at x; null for null coefficients."""
    total = F.get(coefficients, F.lit(0))
    for k in range(1, order + 1):
        total = total + F.get(coefficients, F.lit(k)) * term(x, k)
    return total


def residuals(df: DataFrame, keys: list[str], x: Column, values: list[str], order: int, weight: Column | None = None) -> DataFrame:
    """``df`` less its fits; groups without a fit stay as they are."""
    fits = fitted(df, keys, x, values, order, weight).drop("n")
    d = df.withColumn("__at", x).join(fits, keys, "left")
    less = {v: F.col(v) - F.coalesce(evaluated(F.col(f"c_{v}"), F.col("__at"), order), F.lit(0.0)) for v in values}
    return d.select(*(less[c].alias(c) if c in less else F.col(c) for c in df.columns))
