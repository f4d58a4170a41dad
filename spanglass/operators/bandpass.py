"""Bandpass calibration: antenna gains of every channel, their normalisation, and polynomials through them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanglass.operators import polynomials

BLOCK = 64  # channels solved in one call


def _gains(model: np.ndarray, weight: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Damped alternating least squares of ``model[c, a, b] = g[c, a] conj(g[c, b])`` for all channels c at once."""
    size = np.abs(model).sum(axis=(1, 2)) / np.maximum((weight > 0).sum(axis=(1, 2)), 1)
    g = np.sqrt(np.where(size > 0, size, 1.0))[:, None] * np.ones(model.shape[:2], complex)
    for _ in range(rounds):
        down = np.einsum("cab,cb->ca", weight, np.abs(g) ** 2)
        up = np.einsum("cab,cb->ca", weight * model, g)
        new = np.where(down > 0, up / np.where(down > 0, down, 1), g)
        change = np.abs(new - g).max(initial=0.0)
        g = (g + new) / 2
        if change < tolerance * max(np.abs(g).max(initial=0.0), 1e-300):
            break
    return g


def _reached(weight: np.ndarray, start: int) -> np.ndarray:
    """Which antennas a chain of baselines ties to the reference, for each channel."""
    linked = (weight > 0) | np.eye(weight.shape[1], dtype=bool)
    seen = np.zeros(weight.shape[:2], bool)
    seen[:, start] = True
    for _ in range(weight.shape[1]):
        more = seen | np.einsum("cab,cb->ca", linked, seen)
        if (more == seen).all():
            break
        seen = more
    return seen


def solve_bandpass(vis: DataFrame, group: list[str], antennas: int, reference: int = 0, rounds: int = 500, tolerance: float = 1e-10) -> DataFrame:
    """(group.., chan, antenna, g_re, g_im, flag) for a unit point source, a solution for each group and channel.

    Times of a group are averaged by Spark first (weighted, unflagged cross correlations), so a task's group is one row for each baseline
    and channel of a block.  The reference antenna has phase 0.  Antennas that no chain of baselines ties to the reference are flagged
    and have gain 1.
    """
    good = vis.filter(~F.col("flag") & (F.col("antenna1") != F.col("antenna2")) & (F.col("weight") > 0))
    of = lambda c: F.try_divide(F.sum(F.col("weight") * F.col(c)), F.sum("weight")).alias(c)
    mean = good.groupBy(*group, "chan", "antenna1", "antenna2").agg(of("re"), of("im"), F.sum("weight").alias("weight"))
    mean = mean.withColumn("__block", F.floor(F.col("chan") / BLOCK))

    def solve(d: pd.DataFrame) -> pd.DataFrame:
        channels = np.unique(d["chan"])
        c, a, b = np.searchsorted(channels, d["chan"]), d["antenna1"].to_numpy(), d["antenna2"].to_numpy()
        v, w = d["re"].to_numpy() + 1j * d["im"].to_numpy(), d["weight"].to_numpy()
        model, weight = np.zeros((len(channels), antennas, antennas), complex), np.zeros((len(channels), antennas, antennas))
        for i, j, x in ((a, b, v), (b, a, v.conj())):  # both directions of a baseline count, if both are there
            np.add.at(model, (c, i, j), w * x)
            np.add.at(weight, (c, i, j), w)
        model = np.where(weight > 0, model / np.where(weight > 0, weight, 1), 0)
        g = _gains(model, weight, rounds, tolerance)
        g = g * np.exp(-1j * np.angle(g[:, [reference]]))
        reached = _reached(weight, reference)
        g = np.where(reached & ((weight.sum(axis=2) > 0) | ~reached), g, 1.0)
        n = len(channels) * antennas
        out = {k: [d[k].iloc[0]] * n for k in group}
        return pd.DataFrame(out | {"chan": np.repeat(channels, antennas), "antenna": np.tile(np.arange(antennas), len(channels)), "g_re": g.real.ravel(), "g_im": g.imag.ravel(), "flag": ~reached.ravel()})

    kinds = {f.name: f.dataType.simpleString() for f in vis.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in (*group, "chan")), "antenna int", "g_re double", "g_im double", "flag boolean"])
    return mean.groupBy(*group, "__block").applyInPandas(solve, schema)


def normalised(gains: DataFrame, keys: list[str]) -> DataFrame:
    """Gains over all channels of ``keys`` (antenna included) divided to a root mean square of 1 and a mean phase of 0.

    The mean phase is that of the sum of unit phasors.  Flagged and zero gains don't count; a spectrum with one good channel or none stays.
    """
    a = F.hypot("g_re", "g_im")
    good = ~F.col("flag") & (a > 1.1920929e-07)
    unit = lambda c: F.sum(F.when(good, F.try_divide(F.col(c), a)))
    sums = gains.groupBy(*keys).agg(unit("g_re").alias("__x"), unit("g_im").alias("__y"), F.avg(F.when(good, a * a)).alias("__p"), F.count_if(good).alias("__n"))
    d = gains.join(sums, keys)
    length = F.hypot("__x", "__y")
    known = length > 1.1920929e-07
    x, y = F.when(known, F.col("__x") / length).otherwise(1.0), F.when(known, F.col("__y") / length).otherwise(0.0)
    size = F.sqrt("__p")
    use = (F.col("__n") > 1) & (size > 1.1920929e-07)
    re = F.when(use, (F.col("g_re") * x + F.col("g_im") * y) / size).otherwise(F.col("g_re"))
    im = F.when(use, (F.col("g_im") * x - F.col("g_re") * y) / size).otherwise(F.col("g_im"))
    return d.select(*(re.alias(c) if c == "g_re" else im.alias(c) if c == "g_im" else F.col(c) for c in gains.columns))


def unwrapped(df: DataFrame, keys: list[str], order: str, phase: str) -> DataFrame:
    """Phases with a turn added wherever neighbours differ by more than half of one, along ``order`` within ``keys`` (a spectrum's channels)."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.col(phase) - F.lag(phase).over(w)
    turns = F.when(step > math.pi, -1).when(step < -math.pi, 1).otherwise(0)
    d = df.withColumn("__turn", turns)
    return d.withColumn(phase, F.col(phase) + 2 * math.pi * F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__turn")


def bandpass_polynomials(gains: DataFrame, keys: list[str], amplitude_degree: int, phase_degree: int) -> DataFrame:
    """(keys.., low, high, amplitude, phase): Chebyshev coefficients of the gains' log amplitude and unwrapped phase over frequency.

    ``gains`` has ``freq``; the domain is from the first channel's frequency to the last's.  The constant term counts by half,
    so the first coefficient is twice the mean level.  A spectrum with fewer channels than coefficients has zeros for the rest.
    """
    a = F.hypot("g_re", "g_im")
    d = gains.select(*keys, "chan", "freq", F.ln(F.greatest(a, F.lit(1.1920929e-07))).alias("amplitude"), F.atan2("g_im", "g_re").alias("phase"))
    d = unwrapped(d, keys, "chan", "phase")
    ends = d.groupBy(*keys).agg(F.min_by("freq", "chan").alias("low"), F.max_by("freq", "chan").alias("high"))
    d = d.join(ends, keys)
    x = polynomials.scaled(F.col("freq"), F.col("low"), F.col("high"))
    half = lambda c: F.transform(c, lambda v, i: F.when(i == 0, v * 2).otherwise(v)).alias(c.removeprefix("c_"))
    fit = lambda c, degree: polynomials.fitted(d, [*keys, "low", "high"], x, [c], degree, fewer=True).select(*keys, "low", "high", half(f"c_{c}"))
    return fit("amplitude", amplitude_degree).join(fit("phase", phase_degree), [*keys, "low", "high"])


def polynomial_gain(amplitude: Column, phase: Column, freq: Column, low: Column, high: Column, degrees: tuple[int, int]) -> tuple[Column, Column]:
    """(re, im) of the gain that bandpass polynomials give at a frequency, which is held to their domain."""
    x = polynomials.scaled(freq, low, high)
    whole = lambda c: F.transform(c, lambda v, i: F.when(i == 0, v / 2).otherwise(v))
    size = F.exp(polynomials.evaluated(whole(amplitude), x, degrees[0]))
    angle = polynomials.evaluated(whole(phase), x, degrees[1])
    return size * F.cos(angle), size * F.sin(angle)
