"""Two-dimensional Fourier transforms of planes in long form, and what is done in the plane of frequencies.

A plane is transformed along one axis and then along the other: each pass groups a line's pixels (one shuffle, a line a row), transforms
batches of lines, and spreads them again.  No task holds more than its lines, so a plane may be larger than a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _along(d: DataFrame, keys: list[str], line: str, axis: str, n: int, inverse: bool) -> DataFrame:
    @F.pandas_udf("struct<re:array<double>,im:array<double>>")
    def transform(at: pd.Series, re: pd.Series, im: pd.Series) -> pd.DataFrame:
        plane = np.zeros((len(at), n), complex)
        for i, (k, x, y) in enumerate(zip(at, re, im, strict=True)):
            plane[i, np.asarray(k)] = np.asarray(x, float) + 1j * np.asarray(y, float)
        plane = np.fft.ifftshift(plane, axes=1)
        plane = np.fft.fftshift(np.fft.ifft(plane, axis=1) if inverse else np.fft.fft(plane, axis=1), axes=1)
        return pd.DataFrame({"re": list(plane.real), "im": list(plane.imag)})

    pixels = F.collect_list(F.struct(axis, "re", "im")).alias("__p")
    lines = d.filter(F.col(axis).between(0, n - 1)).groupBy(*keys, line).agg(pixels)
    done = lines.select(*keys, line, transform("__p." + axis, "__p.re", "__p.im").alias("__l"))
    return done.select(*keys, line, F.posexplode(F.arrays_zip("__l.re", "__l.im")).alias(axis, "__v")).select(*keys, line, axis, "__v.re", "__v.im")


def transformed(plane: DataFrame, keys: list[str], shape: tuple[int, int], inverse: bool = False, axes: tuple[str, str] = ("x", "y")) -> DataFrame:
    """(keys.., x, y, re, im): the transform of each plane, with zero (of pixels as of frequencies) at pixel n // 2 of each axis.

    Pixels that are missing count as zero, pixels outside the shape are left out, null parts count as zero.  The inverse is divided by
    the number of pixels, so it gives back what was transformed.  A line without any pixel stays without rows until the second pass.
    """
    x, y = axes
    part = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in plane.columns else F.lit(0.0).alias(c)
    d = plane.select(*keys, x, y, part("re"), part("im")).filter(F.col(x).between(0, shape[0] - 1) & F.col(y).between(0, shape[1] - 1))
    first = _along(d, keys, y, x, shape[0], inverse)
    return _along(first, keys, x, y, shape[1], inverse)


def beam_image(frequency_x, frequency_y, major: float, minor: float, angle: float):
    """The transform of a Gaussian beam (full widths at half maximum in pixels, angle from +y towards -x), 1 at frequency 0, as a Column."""
    c, s = math.cos(angle + math.pi / 2), math.sin(angle + math.pi / 2)
    along, across = frequency_x * c + frequency_y * s, -frequency_x * s + frequency_y * c
    k = math.pi**2 / (4 * math.log(2))
    return F.exp(-k * (along * along * major**2 + across * across * minor**2))


def feathered(high: DataFrame, low: DataFrame, keys: list[str], shape: tuple[int, int], high_beam: tuple[float, float], low_beam: tuple[float, float, float], factor: float = 1.0) -> DataFrame:
    """(keys.., x, y, value, mask): an image's fine structure with a single dish's coarse structure.

    In the plane of frequencies: high * (1 - w) + low * factor * (area of the high beam / area of the low beam), w being the transform of
    the low beam.  Beams are (major, minor) and (major, minor, angle), full widths in pixels.  Images are (keys.., x, y, value, mask); a pixel is
    good if it is in both.  Pixels missing from an image count as zero and are masked.
    """
    scale = factor * high_beam[0] * high_beam[1] / (low_beam[0] * low_beam[1])
    fx, fy = (F.col("x") - shape[0] // 2) / shape[0], (F.col("y") - shape[1] // 2) / shape[1]
    part = lambda d: transformed(d.select(*keys, "x", "y", F.col("value").alias("re")), keys, shape)
    weight = 1 - beam_image(fx, fy, *low_beam)
    a = part(high).select(*keys, "x", "y", *((F.col(c) * weight).alias(c) for c in ("re", "im")))
    b = part(low).select(*keys, "x", "y", *((F.col(c) * scale).alias(c) for c in ("re", "im")))
    both = a.unionByName(b).groupBy(*keys, "x", "y").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    image = transformed(both, keys, shape, inverse=True).select(*keys, "x", "y", F.col("re").alias("value"))
    good = high.select(*keys, "x", "y", "mask").unionByName(low.select(*keys, "x", "y", "mask")).groupBy(*keys, "x", "y").agg((F.bool_and("mask") & (F.count(F.lit(1)) == 2)).alias("mask"))
    return image.join(good, [*keys, "x", "y"], "left").withColumn("mask", F.coalesce("mask", F.lit(False)))
