"""Visibilities to a grid and back, by a prolate spheroidal kernel, with planes of w."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUPPORT = 3
#: Schwab's rational approximation to the spheroidal function (m = 6, alpha = 1) below and above 0.75 of the support.
P_INNER = (8.203343e-2, -3.644705e-1, 6.278660e-1, -5.335581e-1, 2.312756e-1)
P_OUTER = (4.028559e-3, -3.697768e-2, 1.021332e-1, -1.201436e-1, 6.412774e-2)
Q_INNER = (1.0, 8.212018e-1, 2.078043e-1)
Q_OUTER = (1.0, 9.599102e-1, 2.918724e-1)


def _polynomial(coefficients: tuple, x: Column) -> Column:
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * x + c
    return total


def spheroidal(nu: Column) -> Column:
    """The function at nu of its support, 0 beyond 1; it also corrects an image for the kernel, at twice the offset over the width."""
    size = F.abs(nu)
    inner, outer = size * size - 0.75**2, size * size - 1.0
    value = F.when(size < 0.75, _polynomial(P_INNER, inner) / _polynomial(Q_INNER, inner)).otherwise(_polynomial(P_OUTER, outer) / _polynomial(Q_OUTER, outer))
    return F.when(size <= 1, value).otherwise(0.0)


def kernel(distance: Column, support: float = SUPPORT) -> Column:
    """Weight of a cell at a distance in cells."""
    nu = distance / support
    return F.when(F.abs(nu) <= 1, (1 - nu * nu) * spheroidal(nu)).otherwise(0.0)


OFFSETS = np.arange(-SUPPORT, SUPPORT + 1)
SLICE = 8192  # samples that are spread at once: some 30 MB


def _horner(coefficients: tuple, x: np.ndarray) -> np.ndarray:
    total = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        total = total * x + c
    return total


def _taps(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places in cells along one axis: the nearest cell, and the weights (n, 7) of the cells around it, which add to 1; 0 is out of reach."""
    near = np.floor(place + 0.5)
    nu = ((place - near)[:, None] - OFFSETS) / SUPPORT
    n = nu * nu
    inner, outer = n - 0.75**2, n - 1.0
    value = np.where(np.abs(nu) < 0.75, _horner(P_INNER, inner) / _horner(Q_INNER, inner), _horner(P_OUTER, outer) / _horner(Q_OUTER, outer))
    k = np.where(np.abs(nu) <= 1, np.maximum((1 - n) * value, 0.0), 0.0)
    return near.astype(np.int64), k / k.sum(axis=1)[:, None]


def _floats(column: pa.Array) -> np.ndarray:
    """Nulls become NaN."""
    return column.to_numpy(zero_copy_only=False)


def _valid(*columns: pa.Array) -> np.ndarray | None:
    """Where no column is null; None if that is everywhere."""
    if not any(c.null_count for c in columns):
        return None
    return np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])


def _summed(batch: pa.RecordBatch, keys: list[str], cell: float) -> pa.RecordBatch | None:
    """(keys.., gu, gv, re, im, weight): the sums of some samples over each cell that they reach."""
    u, v = _floats(batch["u"]) / cell, _floats(batch["v"]) / cell
    somewhere = np.isfinite(u) & np.isfinite(v)
    if not somewhere.all():
        batch, u, v = batch.filter(pa.array(somewhere)), u[somewhere], v[somewhere]
    if not len(u):
        return None
    group, firsts = np.zeros(len(u), dtype=np.int64), np.zeros(1, dtype=np.int64)
    for key in keys:
        codes = pc.dictionary_encode(batch[key], null_encoding="encode")
        _, firsts, group = np.unique(group * len(codes.dictionary) + codes.indices.to_numpy(), return_index=True, return_inverse=True)
    (near_u, ku), (near_v, kv) = _taps(u), _taps(v)
    cells_u, cells_v = (np.unique(np.unique(near)[:, None] + OFFSETS) for near in (near_u, near_v))
    at_u, at_v = np.searchsorted(cells_u, near_u[:, None] + OFFSETS), np.searchsorted(cells_v, near_v[:, None] + OFFSETS)
    reached = (ku > 0)[:, :, None] & (kv > 0)[:, None, :]
    places = (((group * len(cells_u))[:, None] + at_u)[:, :, None] * len(cells_v) + at_v[:, None, :])[reached]
    sample = np.nonzero(reached)[0]
    size = len(firsts) * len(cells_u) * len(cells_v)
    if size > 4 * len(places):  # far apart
        found, places = np.unique(places, return_inverse=True)
    else:
        found = np.nonzero(np.bincount(places, minlength=size))[0]
    w = (ku[:, :, None] * kv[:, None, :])[reached] * _floats(batch["imaging_weight"])[sample]

    def total(factor: str | None) -> pa.Array:
        """Nulls are left out; of nulls alone the sum is null."""
        used = _valid(batch["imaging_weight"], *([batch[factor]] if factor else []))
        x = w * _floats(batch[factor])[sample] if factor else w
        if used is None:
            sums = np.bincount(places, x)
            return pa.array(sums if len(sums) == len(found) else sums[found])
        some = used[sample]
        n, sums = (np.bincount(places[some], y, minlength=places.max() + 1) for y in (None, x[some]))
        n, sums = (n, sums) if len(sums) == len(found) else (n[found], sums[found])
        return pa.array(sums, mask=n == 0)

    rest, gv = np.divmod(found, len(cells_v))
    which, gu = np.divmod(rest, len(cells_u))
    columns = [batch[key].take(pa.array(firsts[which])) for key in keys]
    columns += [pa.array(cells_u[gu]).cast(pa.int32()), pa.array(cells_v[gv]).cast(pa.int32()), total("re"), total("im"), total(None)]
    return pa.RecordBatch.from_arrays(columns, names=[*keys, "gu", "gv", "re", "im", "weight"])


def w_plane(w: Column, step: float) -> Column:
    """Number of the plane that a sample's w (in wavelengths) lies nearest to."""
    return F.floor(w / step + 0.5).cast("int")


def gridded(uv: DataFrame, cell: float, keys: list[str] | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """(keys.., gu, gv, re, im, weight): samples (u, v, re, im, imaging_weight) spread over the cells within the kernel's support and summed.

    Each batch of samples is spread and summed in arrays, so what Spark sums and shuffles is a row for each cell of a batch, not for each cell of a
    sample, and a dense middle of the plane is no hot spot.  With ``shape``, cells beyond +-n // 2 are left out.  Samples without a finite place
    reach no cell.  ``keys`` keeps grids apart, such as planes of w or channels.
    """
    keys = keys or []

    def spread(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                sums = _summed(batch.slice(begin, SLICE), keys, cell)
                if sums is not None:
                    yield sums

    samples = uv.select(*keys, *(F.col(c).cast("double").alias(c) for c in ("u", "v", "re", "im", "imaging_weight")))
    kinds = T.StructType([*(T.StructField(k, samples.schema[k].dataType) for k in keys), T.StructField("gu", T.IntegerType()), T.StructField("gv", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("re", "im", "weight"))])
    d = samples.mapInArrow(spread, kinds)
    if shape:
        d = d.filter(F.col("gu").between(-(shape[0] // 2), (shape[0] - 1) // 2) & F.col("gv").between(-(shape[1] // 2), (shape[1] - 1) // 2))
    return d.groupBy(*keys, "gu", "gv").agg(*(F.sum(c).alias(c) for c in ("re", "im", "weight")))


def _patches(grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., __gu, __gv, __at, __re, __im): the cells of a grid around each cell, by their places 0 to 48 in the kernel's square."""
    width = len(OFFSETS)
    shifts = F.explode(F.array(*(F.struct(F.lit(int(i)).alias("i"), F.lit(int(j)).alias("j")) for i in OFFSETS for j in OFFSETS)))
    d = grid.select(*keys, "gu", "gv", F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im"), shifts.alias("__s"))
    at = (F.col("__s.i") + SUPPORT) * width + F.col("__s.j") + SUPPORT
    cells = F.sort_array(F.collect_list(F.struct(at.alias("at"), "re", "im"))).alias("__c")
    d = d.groupBy(*keys, (F.col("gu") - F.col("__s.i")).alias("__gu"), (F.col("gv") - F.col("__s.j")).alias("__gv")).agg(cells)
    return d.select(*keys, "__gu", "__gv", *(F.col(f"__c.{c}").alias(f"__{c}") for c in ("at", "re", "im")))


def _model(cell: float):
    @F.arrow_udf("struct<re: double, im: double>")
    def model(u: pa.Array, v: pa.Array, at: pa.Array, re: pa.Array, im: pa.Array) -> pa.Array:
        ku, kv = _taps(_floats(u) / cell)[1], _taps(_floats(v) / cell)[1]
        sample, places = np.repeat(np.arange(len(u)), pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False)), at.flatten().to_numpy()
        a, b = ku[sample, places // len(OFFSETS)], kv[sample, places % len(OFFSETS)]
        reached = (a > 0) & (b > 0)
        k, sample = (a * b)[reached], sample[reached]
        sums = [pa.array(np.bincount(sample, k * x.flatten().to_numpy()[reached], minlength=len(u))) for x in (re, im)]
        return pa.StructArray.from_arrays(sums, ["re", "im"])

    return model


def degridded(uv: DataFrame, grid: DataFrame, cell: float, row: str, keys: list[str] | None = None) -> DataFrame:
    """(row, model_re, model_im): the grid (keys.., gu, gv, re, im) read at each sample's place, by the same kernel.

    A sample joins the one patch of the grid around its nearest cell, so samples are never multiplied; the grid is, 49 times.  Cells that the grid
    does not hold count as zero.  Samples without a finite place have no row.  ``row`` is what tells samples apart, and may be a struct of whatever
    goes with a sample; samples that have it in common each have their row.
    """
    keys = keys or []
    somewhere = (F.abs("u") < float("inf")) & (F.abs("v") < float("inf"))
    near = lambda c: F.floor(F.col(c) / cell + 0.5).cast("int")
    d = uv.select(row, *keys, F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")).filter(somewhere)
    both = d.withColumn("__gu", near("u")).withColumn("__gv", near("v")).join(_patches(grid, keys), [*keys, "__gu", "__gv"], "left")
    return both.withColumn("__m", _model(cell)("u", "v", "__at", "__re", "__im")).select(row, F.col("__m.re").alias("model_re"), F.col("__m.im").alias("model_im"))


def w_screened(plane: DataFrame, w: Column, increment: float, shape: tuple[int, int], conjugate: bool = False) -> DataFrame:
    """An image plane (x, y, re, im) times the phase of its w: exp(2 pi i w (sqrt(1 - l^2 - m^2) - 1)); pixels off the sky become zero.

    ``increment`` is a pixel's size in direction cosines.
    """
    l, m = (F.col("x") - shape[0] // 2) * increment, (F.col("y") - shape[1] // 2) * increment  # noqa: E741
    r = l * l + m * m
    angle = (-1 if conjugate else 1) * 2 * math.pi * w * (F.sqrt(F.greatest(1 - r, F.lit(0.0))) - 1)
    re, im = F.col("re"), F.col("im")
    on = r < 1
    turned = {"re": re * F.cos("__a") - im * F.sin("__a"), "im": re * F.sin("__a") + im * F.cos("__a")}
    return plane.withColumn("__a", angle).select(*(F.when(on, turned[c]).otherwise(0.0).alias(c) if c in turned else F.col(c) for c in plane.columns))


def kernel_corrected(plane: DataFrame, shape: tuple[int, int], floor: float = 1e-3) -> DataFrame:
    """An image (x, y, re, im) divided by the kernel's transform; where that is below ``floor`` of its peak the image becomes zero."""
    peak = _polynomial(P_INNER, F.lit(-(0.75**2))) / _polynomial(Q_INNER, F.lit(-(0.75**2)))
    taper = spheroidal(2 * (F.col("x") - shape[0] // 2) / shape[0]) * spheroidal(2 * (F.col("y") - shape[1] // 2) / shape[1]) / (peak * peak)
    return plane.withColumn("__t", taper).select(*(F.when(F.col("__t") >= floor, F.col(c) / F.col("__t")).otherwise(0.0).alias(c) if c in ("re", "im") else F.col(c) for c in plane.columns))
