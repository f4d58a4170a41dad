"""Gaussian beams: (major, minor, angle), full widths at half maximum and position angle from north to east in radians."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AREA = math.pi / (4 * math.log(2))


def area(major: Column, minor: Column) -> Column:
    return AREA * major * minor


def is_null(major: Column, minor: Column) -> Column:
    return (major == 0) & (minor == 0)


def _covariance(major: Column, minor: Column, angle: Column) -> tuple[Column, Column, Column]:
    """(xx, xy, yy) with x to the east; the major axis points to the position angle."""
    s, c = F.sin(angle), F.cos(angle)
    a, b = major * major, minor * minor
    return a * s * s + b * c * c, (a - b) * s * c, a * c * c + b * s * s


def deconvolved(major: Column, minor: Column, angle: Column, by_major: Column, by_minor: Column, by_angle: Column) -> Column:
    """struct(major, minor, angle): the beam that makes the first out of the second; null where it is no larger in some direction or equal."""
    xx, xy, yy = (p - q for p, q in zip(_covariance(major, minor, angle), _covariance(by_major, by_minor, by_angle), strict=True))
    middle, spread = (xx + yy) / 2, F.hypot((xx - yy) / 2, xy)
    tiny = 1e-12 * (major * major + by_major * by_major)
    large, small = middle + spread, middle - spread
    turn = F.when(spread <= tiny, 0.0).otherwise(F.pmod(0.5 * F.atan2(2 * xy, yy - xx), F.lit(math.pi)))
    found = F.struct(F.sqrt(F.greatest(large, F.lit(0.0))).alias("major"), F.sqrt(F.greatest(small, F.lit(0.0))).alias("minor"), turn.alias("angle"))
    return F.when((small >= -tiny) & (large > tiny), found)


def beam_extremes(beams: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """(keys.., n, smallest, largest, median): of each set its beams by area, as structs of ``place``, major, minor, angle and area.

    Null beams (no width) don't count; ties go to the first place.  The median is the lower one of an even number.
    """
    d = beams.filter(~is_null(F.col("major"), F.col("minor"))).withColumn("area", area(F.col("major"), F.col("minor")))
    whole = F.struct(*place, "major", "minor", "angle", "area")
    by = F.struct("area", *place)
    last = F.struct(-F.col("area"), *place)
    sorted_beams = F.array_sort(F.collect_list(F.struct("area", *place, "major", "minor", "angle")))  # a set is a grid of channels and Stokes parameters
    middle = F.element_at(sorted_beams, F.floor((F.count(F.lit(1)) + 1) / 2).cast("int"))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by(whole, by).alias("smallest"), F.min_by(whole, last).alias("largest"), middle.alias("__m")).select(
        *keys, "n", "smallest", "largest", F.struct(*(F.col(f"__m.{c}").alias(c) for c in (*place, "major", "minor", "angle", "area"))).alias("median")
    )


def _matrix(major: float, minor: float, angle: float) -> np.ndarray:
    s, c = math.sin(angle), math.cos(angle)
    axes = np.array([[s, c], [c, -s]])
    return axes.T @ np.diag([major * major, minor * minor]) @ axes


def _beam(m: np.ndarray) -> tuple[float, float, float]:
    size, vectors = np.linalg.eigh(m)
    x, y = vectors[:, 1]
    turn = math.atan2(x, y) % math.pi if size[1] - size[0] > 1e-12 * size[1] else 0.0
    return math.sqrt(max(size[1], 0)), math.sqrt(max(size[0], 0)), turn


def _enclosing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least ellipse round two with one centre: where one is the unit circle, each axis of the other counts if it is longer."""
    root = np.linalg.cholesky(a)
    inverse = np.linalg.inv(root)
    size, vectors = np.linalg.eigh(inverse @ b @ inverse.T)
    return root @ vectors @ np.diag(np.maximum(size, 1)) @ vectors.T @ root.T


def enclosing_beam(beams: list[tuple[float, float, float]]) -> tuple[float, float, float] | None:
    """The largest beam, grown by the others that stick out of it, last ones first, until all are inside."""
    found = [b for b in beams if b[0] > 0 and b[1] > 0]
    if not found:
        return None
    largest = max(range(len(found)), key=lambda i: found[i][0] * found[i][1])
    whole = _matrix(*found[largest])
    for i in range(len(found) - 1, -1, -1):
        if i != largest:
            other = _matrix(*found[i])
            inverse = np.linalg.inv(np.linalg.cholesky(whole))
            if np.linalg.eigvalsh(inverse @ other @ inverse.T)[-1] > 1 + 1e-9:
                whole = _enclosing(whole, other)
    return _beam(whole)


def common_beams(beams: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """(keys.., major, minor, angle) of a beam that encloses all beams of each set.

    ``place`` orders a set's beams.  A set is a grid of an image's channels and Stokes parameters, so a task takes a whole one; sets without
    a beam of some width have no row.
    """
    kinds = {f.name: f.dataType.simpleString() for f in beams.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "major double", "minor double", "angle double"])

    def find(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(place)
        common = enclosing_beam(list(zip(d["major"], d["minor"], d["angle"], strict=True)))
        return pd.DataFrame([[*(d[k].iloc[0] for k in keys), *common]] if common else [], columns=[*keys, "major", "minor", "angle"])

    return beams.select(*keys, *place, "major", "minor", "angle").groupBy(*keys).applyInPandas(find, schema)
