"""Lattices and images in long form: one row for each pixel (index columns, value, mask).

Expressions on images are Column expressions on lattices joined on their indices; ``joined`` does the
join and ANDs the masks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanglass.operators import ranks


def joined(a: DataFrame, b: DataFrame, index: list[str], name: str = "value2") -> DataFrame:
    """a with b's value beside its own; the mask is the AND of both.  A pixel that only one of them has is an error: shapes must be equal."""
    other = b.select(*index, F.col("value").alias(name), F.col("mask").alias("__mask"), F.lit(True).alias("__there"))
    both = a.withColumn("__here", F.lit(True)).join(other, index, "full")
    unequal = F.col("__here").isNull() | F.col("__there").isNull()
    mask = F.when(unequal, F.raise_error(F.lit("images of unequal shapes")).cast("boolean")).otherwise(F.col("mask") & F.col("__mask"))
    return both.withColumn("mask", mask).drop("__mask", "__here", "__there")


# ---- reductions of whole images, as in image expressions: masks play no part


def reductions(image: DataFrame, keys: list[str] | None = None, fraction: float = 0.5) -> DataFrame:
    """(keys.., nelem, sum, mean, min, max, variance, stddev, avdev, median, fractile) of all pixels, good or not; of nothing, one row of zeros if there are no keys.

    The variance is the sample's (0 of one pixel), avdev the mean absolute deviation from the mean, median and
    fractile are the values at floor((n - 1) f + 0.01) in order, without averaging the middle two.
    """
    keys = keys or []
    v = F.col("value").cast("double")
    d = image.select(*keys, v.alias("value")).filter("value IS NOT NULL")
    n = F.count(F.lit(1))
    spread = F.when(n > 1, F.var_samp("value")).otherwise(0.0)
    sums = d.groupBy(*keys).agg(n.alias("nelem"), F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), spread.alias("variance"))
    sums = sums.withColumn("stddev", F.sqrt("variance"))
    apart = ranks.joined(d, sums.select(*keys, F.col("mean").alias("__m")), keys).groupBy(*keys).agg(F.avg(F.abs(F.col("value") - F.col("__m"))).alias("avdev"))
    middle = ranks.fractiles(d, keys, "value", {"median": 0.5, "fractile": fraction}).drop("n")
    out = ranks.joined(ranks.joined(sums, apart, keys), middle, keys, "left")
    return out if keys else out.na.fill(0)


def mask_counts(image: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys.., ntrue, nfalse, any, all) of the masks: how many pixels are good and bad."""
    return image.groupBy(*(keys or [])).agg(F.count_if("mask").alias("ntrue"), F.count_if(~F.col("mask")).alias("nfalse"), F.coalesce(F.bool_or("mask"), F.lit(False)).alias("any"), F.coalesce(F.bool_and("mask"), F.lit(True)).alias("all"))


def replaced(image: DataFrame, by: float | DataFrame, index: list[str]) -> DataFrame:
    """Bad pixels' values replaced by a number or another image's; masks stay as they are."""
    if isinstance(by, DataFrame):
        d = image.join(by.select(*index, F.col("value").alias("__by")), index, "left")
        return d.withColumn("value", F.when(F.col("mask"), F.col("value")).otherwise(F.col("__by"))).drop("__by")
    return image.withColumn("value", F.when(F.col("mask"), F.col("value")).otherwise(F.lit(float(by))))


def statistics(image: DataFrame, axes: list[str], index: list[str], include: tuple[float, float] | None = None) -> DataFrame:
    """Statistics over everything but ``axes``: of good pixels, with the sample variance (NaN of under two) and the exact median."""
    d = image.filter("mask")
    if include:
        d = d.filter(F.col("value").between(*include))
    v, place = F.col("value"), F.struct(*index)
    n = F.count(v)
    variance = F.when(n > 1, F.var_samp(v)).otherwise(F.lit(float("nan")))
    sums = d.groupBy(*axes).agg(
        n.alias("npts"), F.sum(v).alias("sum"), F.sum(v * v).alias("sumsq"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"),
        variance.alias("variance"), F.sqrt(variance).alias("sigma"), F.min_by(place, F.struct(v, *index)).alias("min_pos"), F.max_by(place, F.struct(v, *(-F.col(i) for i in index))).alias("max_pos"),
    )
    return ranks.joined(sums, ranks.medians(d, axes, "value").drop("n"), axes, "left")


def quartiles(image: DataFrame, axes: list[str]) -> DataFrame:
    """The values at floor((n - 1) / 4) and floor(3 (n - 1) / 4) in order."""
    at = {name: (lambda n, f=f: F.floor((n - 1) * F.lit(f))) for name, f in (("q1", 0.25), ("q3", 0.75))}
    return ranks.at_places(image.filter("mask"), axes, "value", at).drop("n").withColumn("quartile", F.col("q3") - F.col("q1"))


def madfm(image: DataFrame, axes: list[str]) -> DataFrame:
    """Median of absolute deviations from the median."""
    return ranks.median_deviations(image.filter("mask"), axes, "value").drop("median")


def moments(image: DataFrame, plane: list[str], velocity: Column, width: float, include: tuple[float, float] | None = None) -> DataFrame:
    """Moments -1, 0, 1, 2 and 3 along a spectral axis; none where the values sum to zero."""
    d = image.filter("mask")
    if include:
        d = d.filter(F.col("value").between(*include))
    v = F.col("value")
    d = d.withColumn("__x", velocity)
    s0, s1, s2 = F.sum(v), F.sum(v * F.col("__x")), F.sum(v * F.col("__x") * F.col("__x"))
    m1 = F.try_divide(s1, s0)
    spread = F.try_divide(s2, s0) - m1 * m1
    out = d.groupBy(*plane).agg(F.avg(v).alias("mean"), (s0 * width).alias("moment0"), m1.alias("moment1"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("moment2"), F.median(v).alias("median"), s0.alias("__s"))
    return out.filter(F.col("__s") != 0).drop("__s")


def pb_corrected(image: DataFrame, beam: DataFrame, index: list[str], cutoff: float = 0.2) -> DataFrame:
    """Divide by the primary beam; pixels under the cutoff are masked."""
    d = joined(image, beam, index, "pb")
    ok = F.col("pb") >= cutoff
    return d.select(*index, F.when(ok, F.try_divide(F.col("value"), F.col("pb"))).alias("value"), (F.col("mask") & ok).alias("mask"))


def sub_image(image: DataFrame, box: dict[str, tuple[int, int]]) -> DataFrame:
    """Cut an inclusive box; indices begin at 0 again."""
    d = image
    for axis, (first, last) in box.items():
        d = d.filter(F.col(axis).between(first, last)).withColumn(axis, F.col(axis) - first)
    return d


def in_ellipsoid(centre: dict[str, float], radius: dict[str, float]) -> Column:
    return sum(((F.col(a) - c) / radius[a]) ** 2 for a, c in centre.items()) <= 1


def in_polygon(x: str, y: str, corners: list[tuple[float, float]]) -> Column:
    """By crossings of a ray, as one expression."""
    odd = F.lit(False)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            odd = odd != (((F.lit(y1) > F.col(y)) != (F.lit(y2) > F.col(y))) & (F.col(x) < (x2 - x1) * (F.col(y) - y1) / (y2 - y1) + x1))
    return odd


def regridded(image: DataFrame, template: DataFrame, index: tuple[str, str], source_x: Column, source_y: Column, how: str = "linear") -> DataFrame:
    """Values at each template pixel's place (source_x, source_y) in the image; pixels off it are left out.

    ``linear``: each output pixel joins its four neighbours and sums by weight, one join and one aggregation; it is good if all of them are.
    ``nearest``: the pixel whose centre is nearest, the upper one of two that are equally near.
    """
    x, y = index
    if how not in ("linear", "nearest"):
        raise ValueError("linear or nearest")
    d = template.select(F.col(x).alias("ox"), F.col(y).alias("oy"), source_x.alias("sx"), source_y.alias("sy"))
    if how == "nearest":
        at = d.select("ox", "oy", F.floor(F.col("sx") + 0.5).cast("int").alias(x), F.floor(F.col("sy") + 0.5).cast("int").alias(y))
        return at.join(image.select(x, y, "value", "mask"), [x, y]).select(F.col("ox").alias(x), F.col("oy").alias(y), "value", "mask")
    d = d.withColumn("dx", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("dy", F.explode(F.array(F.lit(0), F.lit(1))))
    d = d.withColumn(x, (F.floor("sx") + F.col("dx")).cast("int")).withColumn(y, (F.floor("sy") + F.col("dy")).cast("int"))
    share = lambda s, k: F.when(F.col(k) == 1, F.col(s) - F.floor(s)).otherwise(1 - F.col(s) + F.floor(s))
    d = d.withColumn("w", share("sx", "dx") * share("sy", "dy")).filter("w > 0")
    out = d.join(image, [x, y]).groupBy("ox", "oy").agg(F.sum(F.col("w") * F.col("value")).alias("value"), F.sum("w").alias("__w"), F.bool_and("mask").alias("mask"))
    return out.filter(F.col("__w") > 1 - 1e-9).select(F.col("ox").alias(x), F.col("oy").alias(y), "value", "mask")


def flux(image: DataFrame, axes: list[str], beam_area: float) -> DataFrame:
    """Flux density over everything but ``axes``: the sum of good pixels over the beam's area in pixels."""
    return image.filter("mask").groupBy(*axes).agg((F.sum("value") / beam_area).alias("flux"))


def position_velocity(image: DataFrame, start: tuple[float, float], end: tuple[float, float], n: int, spectral: str = "z") -> DataFrame:
    """impv: (offset, spectral, value): n samples along a line in the plane (x, y), each the nearest good pixel, for every spectral pixel."""
    step = lambda a, b: F.round(a + (b - a) * F.col("offset") / max(1, n - 1)).cast("int")
    line = image.sparkSession.range(n).select(F.col("id").cast("int").alias("offset"))
    line = line.select("offset", step(start[0], end[0]).alias("x"), step(start[1], end[1]).alias("y"))
    return image.filter("mask").join(line, ["x", "y"]).select("offset", spectral, "value")


def line_pixels(start: tuple[int, int], end: tuple[int, int]) -> list[tuple[int, int]]:
    """The pixels from one to another, one for each step along the longer axis; a half goes on."""
    (x0, y0), (x1, y1) = start, end
    a, b = abs(x1 - x0), abs(y1 - y0)
    sx, sy, n = (1 if x1 > x0 else -1), (1 if y1 > y0 else -1), max(a, b)
    step = lambda i, m: i if m == n else (2 * i * m + n) // (2 * n)
    return [(x0 + sx * step(i, a), y0 + sy * step(i, b)) for i in range(n + 1)]


def across(start: tuple[int, int], end: tuple[int, int], width: int) -> list[tuple[int, int]]:
    """Offsets of ``width`` pixels at right angles to a line, each once."""
    dx, dy = end[0] - start[0], end[1] - start[1]
    length = math.hypot(dx, dy)
    px, py = (-dy / length, dx / length) if length else (0.0, 1.0)
    near = lambda v: math.copysign(math.floor(abs(v) + 0.5), v)
    return sorted({(int(near(px * (i - (width - 1) / 2))), int(near(py * (i - (width - 1) / 2)))) for i in range(max(1, width))})


def line_profile(image: DataFrame, start: tuple[int, int], end: tuple[int, int], keys: list[str], width: int = 1) -> DataFrame:
    """impv: (offset, keys.., value): along every pixel of a line in the plane (x, y), for each spectral (or other) pixel of ``keys``.

    With a ``width`` the mean over as many pixels across the line; those off the image don't count, masks play no part.  The line is
    as many rows as it has pixels, and joins the image.
    """
    cells = [(i, x + dx, y + dy) for i, (x, y) in enumerate(line_pixels(start, end)) for dx, dy in across(start, end, width)]
    line = image.sparkSession.createDataFrame(cells, "offset int, x int, y int")
    return image.join(line, ["x", "y"]).groupBy("offset", *keys).agg(F.avg("value").alias("value"))
