"""Exact order statistics of groups of any size: the values at given places of each group in order.

A group is never sorted or gathered.  Its values are counted in ranges that a monotone function of the value gives, so the counts combine before
the shuffle and are the same however the rows are dealt; the range that holds a wanted place is then counted in finer ranges:

    1. 1024 ranges to an octave, apart for each sign
    2. 65,536 equal parts of a range between its least and its largest value
    3. the distinct values of such a part

A range whose least and largest value are equal is done at once, so data with few values take one pass, and where all picked ranges hold few rows
the second pass is left out.  Each pass reads the rows again, but only the picked ranges are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanglass.sources.tables import scratch

OCTAVE, PARTS = 1024, 65_536
FEW = 100_000  # rows of a range whose values are looked at one by one


def coarse_range(x: Column) -> Column:
    """A whole number that never falls as x rises; infinities and NaN (the highest) have their own."""
    size = F.abs(x)
    inner = F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size).otherwise(1.0)) * OCTAVE) + 2_000_000  # at least 900,000
    far = F.when(size == float("inf"), F.lit(10_000_000)).otherwise(inner).cast("bigint")
    return F.when(F.isnan(x), F.lit(20_000_000)).when(x > 0, far).when(x < 0, -far).otherwise(0).cast("bigint")


def _fine_range(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.floor((x - low) / (high - low) * PARTS), F.lit(PARTS - 1)).cast("int")


def joined(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that takes nulls as equal, without the columns of ``b`` that are joined on; of no columns, ``b`` is one row."""
    if not columns:
        return a.join(F.broadcast(b), F.lit(True), how) if how == "left" else a.crossJoin(F.broadcast(b))
    renamed = b.select(*(F.col(c).alias(f"__j{i}") for i, c in enumerate(columns)), *(c for c in b.columns if c not in columns))
    on = reduce(lambda p, q: p & q, [a[c].eqNullSafe(renamed[f"__j{i}"]) for i, c in enumerate(columns)])
    return a.join(renamed, on, how).drop(*(f"__j{i}" for i in range(len(columns))))


def _counted(rows: DataFrame, within: list[str], by: str) -> DataFrame:
    """Of each range its rows, least and largest value, and the rows of ``within`` up to its end."""
    ranges = rows.groupBy(*within, by).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high"))
    upto = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return ranges.withColumn("__upto", F.sum("__n").over(upto))


def at_places(df: DataFrame, keys: list[str], x: str | Column, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys.., n, a column for each place): of each group its number of values that are not null, and the values at places.

    A place is a function of n, counted from 0; a place outside the group gives null.  NaN is the highest value, null keys are a group
    of their own, -0.0 equals 0.0.  Groups without values and empty tables give no rows.
    """
    value = (F.col(x) if isinstance(x, str) else x).cast("double")
    rows = df.select(*keys, value.alias("__x")).filter("__x IS NOT NULL").withColumn("__a", coarse_range(F.col("__x")))
    first = _counted(rows, keys, "__a").withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), place(F.col("__all")).cast("bigint").alias("place")) for name, place in places.items())))
    first = first.withColumn("__w", wanted).select(*keys, "__a", "__low", "__high", "__n", "__upto", F.col("__all").alias("n"), "__w.*")
    inside = (F.col("place") < F.col("__upto")) & (F.col("place") >= F.col("__upto") - F.col("__n"))
    of_first = (F.col("place").isNull() | (F.col("place") < 0) | (F.col("place") >= F.col("n"))) & (F.col("__upto") == F.col("n"))  # kept once, without a value
    first = first.filter(inside | of_first).withColumn("place", F.when(inside, F.col("place") - F.col("__upto") + F.col("__n")))
    picked = scratch(first.drop("__upto"), "ranks")

    open_ones = picked.filter("place IS NOT NULL AND __low < __high")
    answer = picked.select(*keys, "n", "name", F.when(F.col("place").isNotNull() & (F.col("__low") == F.col("__high")), F.col("__low")).alias("value"))
    most = open_ones.agg(F.max("__n")).first()[0]
    if most is not None:
        if most <= FEW:
            values = _values(joined(rows, open_ones.select(*keys, "__a").distinct(), [*keys, "__a"]), open_ones, [*keys, "__a"], keys)
        else:
            second = _refined(rows, open_ones.drop("__n"), keys)
            left = second.filter("__low < __high")
            values = second.filter("__low = __high").select(*keys, "name", F.col("__low").alias("found"))
            if not left.isEmpty():
                values = values.unionByName(_last(rows, left, keys))
        answer = joined(answer, values, [*keys, "name"], "left").withColumn("value", F.coalesce("value", "found")).drop("found")
    columns = [F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in places]
    return answer.groupBy(*keys, "n").agg(*columns)


def _refined(rows: DataFrame, picked: DataFrame, keys: list[str]) -> DataFrame:
    """Picked ranges, cut into parts: the part that holds each place, and the place in it."""
    edges = picked.select(*keys, "__a", F.col("__low").alias("__from"), F.col("__high").alias("__to")).distinct()
    inside = joined(rows, edges, [*keys, "__a"]).withColumn("__b", _fine_range(F.col("__x"), F.col("__from"), F.col("__to")))
    parts = _counted(inside, [*keys, "__a", "__from", "__to"], "__b")
    found = joined(picked.drop("__low", "__high"), parts, [*keys, "__a"]).filter("place < __upto AND place >= __upto - __n")
    return scratch(found.withColumn("place", F.col("place") - F.col("__upto") + F.col("__n")).drop("__n", "__upto"), "ranks")


def _last(rows: DataFrame, picked: DataFrame, keys: list[str]) -> DataFrame:
    """The values themselves, counted in the parts that are left."""
    parts = picked.select(*keys, "__a", "__b", "__from", "__to").distinct()
    inside = joined(rows, parts, [*keys, "__a"]).filter(_fine_range(F.col("__x"), F.col("__from"), F.col("__to")) == F.col("__b"))
    return _values(inside, picked, [*keys, "__a", "__b"], keys)


def _values(inside: DataFrame, picked: DataFrame, within: list[str], keys: list[str]) -> DataFrame:
    """(keys.., name, found): the values at the picked places, from the counts of the distinct values of each range."""
    counts = inside.groupBy(*within, "__x").agg(F.count(F.lit(1)).alias("__c"))
    upto = Window.partitionBy(*within).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("__upto", F.sum("__c").over(upto))
    found = joined(picked.select(*within, "name", "place"), counts, within)
    return found.filter("place < __upto AND place >= __upto - __c").select(*keys, "name", F.col("__x").alias("found"))


# ---- medians and quantiles by the rules of tables, images and calibration reports


def half(low: str, high: str) -> Column:
    return (F.col(low) + F.col(high)) / 2


def _middle(name: str, first: Callable[[Column], Column], n: Callable[[Column], Column]) -> dict[str, Callable[[Column], Column]]:
    """The one or two middle places of the ``n`` values from ``first`` on; none where there are no values."""
    some = lambda f: lambda k: F.when(n(k) > 0, f(k))
    return {f"__{name}0": some(lambda k: first(k) + F.floor((n(k) - 1) / 2)), f"__{name}1": some(lambda k: first(k) + F.floor(n(k) / 2))}


def medians(df: DataFrame, keys: list[str], x: str | Column, name: str = "median") -> DataFrame:
    """(keys.., n, median): the mean of the middle two of an even number."""
    found = at_places(df, keys, x, _middle("m", lambda n: F.lit(0), lambda n: n))
    return found.select(*keys, "n", half("__m0", "__m1").alias(name))


def fractiles(df: DataFrame, keys: list[str], x: str | Column, fractions: dict[str, float]) -> DataFrame:
    """(keys.., n, a column for each fraction f): the values at floor((n - 1) f + 0.01)."""
    return at_places(df, keys, x, {name: (lambda n, f=f: F.floor((n - 1) * F.lit(f) + 0.01)) for name, f in fractions.items()})


def deviations_from(df: DataFrame, middle: DataFrame, keys: list[str], x: str, name: str = "madfm") -> DataFrame:
    """(keys.., name): the median of the absolute deviations from each group's ``median`` in ``middle`` (keys.., median)."""
    apart = joined(df.select(*keys, F.col(x).cast("double").alias("__v")), middle, keys)
    return medians(apart.select(*keys, F.abs(F.col("__v") - F.col("median")).alias("__d")), keys, "__d", name).drop("n")


def median_deviations(df: DataFrame, keys: list[str], x: str, name: str = "madfm") -> DataFrame:
    """(keys.., median, madfm): the median of the absolute deviations from the median."""
    middle = medians(df, keys, x, "median").drop("n")
    return joined(middle, deviations_from(df, middle, keys, x, name), keys)


def median_and_halves(df: DataFrame, keys: list[str], x: str | Column) -> DataFrame:
    """(keys.., n, median, q1, q3): q1 and q3 are the medians of the lower and the upper half, without the middle value; 0 of an empty half."""
    low = _middle("l", lambda n: F.lit(0), lambda n: F.floor(n / 2))
    high = _middle("h", lambda n: n - F.floor(n / 2), lambda n: F.floor(n / 2))
    found = at_places(df, keys, x, _middle("m", lambda n: F.lit(0), lambda n: n) | low | high)
    return found.select(*keys, "n", half("__m0", "__m1").alias("median"), F.coalesce(half("__l0", "__l1"), F.lit(0.0)).alias("q1"), F.coalesce(half("__h0", "__h1"), F.lit(0.0)).alias("q3"))
