"""Functions of array cells: reductions, moving windows and n-dimensional indexing.

An n-dimensional cell is a flat array in column-major order (the first index runs fastest) with
its shape beside it; axes and indices count from 1.
"""

from __future__ import annotations

from collections.abc import Callable
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x.cast("double"))


def sumsqr(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def mean(a: Column) -> Column:
    """Null of an empty array."""
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def variance(a: Column, sample: bool = False) -> Column:
    """Of the population, or of a sample (null under two elements)."""
    n = F.size(a)
    m = mean(a)
    s = total(F.transform(a, lambda x: (x - m) * (x - m)))
    return F.when(n > 1, s / (n - 1)) if sample else F.when(n > 0, s / n)


def stddev(a: Column, sample: bool = False) -> Column:
    return F.sqrt(variance(a, sample))


def rms(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sqrt(sumsqr(a) / F.size(a)))


def avdev(a: Column) -> Column:
    m = mean(a)
    return mean(F.transform(a, lambda x: F.abs(x - m)))


def median(a: Column) -> Column:
    """Mean of the middle two."""
    s, n = F.array_sort(_double(a)), F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def fractile(a: Column, f: float) -> Column:
    """The element at floor((n - 1) f) in order."""
    return F.when(F.size(a) > 0, F.get(F.array_sort(_double(a)), F.floor((F.size(a) - 1) * F.lit(f)).cast("int")))


def count_true(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x))


REDUCERS: dict[str, Callable[[Column], Column]] = {
    "sum": total, "product": product, "sumsqr": sumsqr, "mean": mean, "variance": variance, "stddev": stddev, "rms": rms,
    "avdev": avdev, "median": median, "min": F.array_min, "max": F.array_max, "ntrue": count_true,
    "any": lambda a: F.exists(a, lambda x: x), "all": lambda a: F.forall(a, lambda x: x),
}


def running(a: Column, half: int, how: str) -> Column:
    """Reduce the window [i - half, i + half], cut off at the ends, at each element."""
    n = F.size(a)

    def at(i: Column) -> Column:
        start = F.greatest(i - half, F.lit(0))
        return REDUCERS[how](F.slice(a, start + 1, F.least(i + half, n - 1) - start + 1))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)).otherwise(F.slice(F.array(REDUCERS[how](a)), 1, 0))


def boxed(a: Column, box: int, how: str) -> Column:
    """The running window of half a box."""
    if box < 1:
        raise ValueError("a box holds at least one element")
    return running(a, box // 2, how)


def flat_index(index: list[Column | int], shape: list[int]) -> Column:
    """0-based place in the flat array; indices count from 1, negative ones from the end."""
    place, step = F.lit(0), 1
    for i, n in zip(index, shape, strict=True):
        k = F.lit(i) if isinstance(i, int) else i
        place = place + (F.when(k < 0, k + n).otherwise(k - 1)) * step
        step *= n
    return place.cast("int")


def element(a: Column, index: list[Column | int], shape: list[int]) -> Column:
    """Null outside the array."""
    return F.get(a, flat_index(index, shape))


def section(a: Column, ranges: list[tuple[int, int] | tuple[int, int, int]], shape: list[int]) -> Column:
    """Inclusive (first, last[, step]) of each axis, as a flat array."""
    places = [0]
    step = 1
    for r, n in zip(ranges, shape, strict=True):
        first, last, by = (*r, 1)[:3]
        places = [p + (k - 1) * step for k in range(first, min(last, n) + 1, by) for p in places]
        step *= n
    return F.transform(F.array(*map(F.lit, places)), lambda p: F.get(a, p))


def over_axis(a: Column, axis: int, shape: list[int], how: str) -> Column:
    """Reduce along one axis; the rest keeps its order."""
    inner, n, outer = prod(shape[: axis - 1]), shape[axis - 1], prod(shape[axis:])
    starts = F.array(*(F.lit(i + o * inner * n) for o in range(outer) for i in range(inner)))
    return F.transform(starts, lambda s: REDUCERS[how](F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(a, s + k * inner))))


def transpose(a: Column, rows: int, columns: int) -> Column:
    """Of a matrix with so many rows and columns."""
    return F.transform(F.array(*(F.lit(r + c * rows) for r in range(rows) for c in range(columns))), lambda p: F.get(a, p))


def diagonal(a: Column, rows: int, columns: int) -> Column:
    return F.transform(F.array(*(F.lit(i * (rows + 1)) for i in range(min(rows, columns)))), lambda p: F.get(a, p))


def resized(a: Column, n: int) -> Column:
    """Cut off or filled up with 0.0."""
    return F.slice(F.concat(_double(a), F.array_repeat(F.lit(0.0), n)), 1, n)


def scaled(a: Column, scale: Column, offset: Column) -> Column:
    """Stored integers to values; -32768 stands for NaN."""
    return F.transform(a, lambda x: F.when(x == -32768, F.lit(float("nan"))).otherwise(x * scale + offset))


def bit_flags(a: Column, mask: int) -> Column:
    return F.transform(a, lambda x: x.bitwiseAND(mask) != 0)
