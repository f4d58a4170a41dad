"""Aggregates with the table language's rules.  ``row`` is the column that gives rows their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count(x: Column | None = None) -> Column:
    """Every row counts, nulls too."""
    return F.count(F.lit(1))


def total(x: Column) -> Column:
    """0.0 of nothing."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def mean(x: Column) -> Column:
    return F.avg(x.cast("double"))


def first(x: Column, row: Column) -> Column:
    """First value in row order that is not null."""
    return F.min_by(x, F.when(x.isNotNull(), row))


def last(x: Column, row: Column) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), row))


def of_first_row(x: Column, row: Column) -> Column:
    """What an expression without an aggregate means in a group: its value on the first row, null or not."""
    return F.min_by(F.struct(x.alias("v")), row)["v"]


def product(x: Column) -> Column:
    return F.product(x.cast("double"))


def sumsqr(x: Column) -> Column:
    return F.sum(x.cast("double") * x.cast("double"))


def variance(x: Column, sample: bool = False) -> Column:
    """Of the population; a sample's is null under two values."""
    return F.when(F.count(x) > 1, F.var_samp(x)) if sample else F.var_pop(x)


def stddev(x: Column, sample: bool = False) -> Column:
    return F.sqrt(variance(x, sample))


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x.cast("double") * x.cast("double")))


def any_true(x: Column) -> Column:
    return F.coalesce(F.bool_or(x), F.lit(False))


def all_true(x: Column) -> Column:
    return F.coalesce(F.bool_and(x), F.lit(True))


def count_true(x: Column) -> Column:
    return F.count_if(x)


def count_false(x: Column) -> Column:
    return F.count_if(~x)


def median(x: Column) -> Column:
    """Mean of the middle two.  Spark's buffer holds a group's distinct values; ``operators.ranks.medians`` is for groups of any size."""
    return F.median(x.cast("double"))


def values(x: Column, row: Column) -> Column:
    """The values in row order, nulls too; the result is a cell, so a group has to fit in one."""
    return F.transform(F.array_sort(F.collect_list(F.struct(row.alias("r"), x.alias("v")))), lambda s: s["v"])


def row_ids(row: Column) -> Column:
    return F.array_sort(F.collect_list(row))


def histogram(x: Column, bins: int = 10, low: float = 0.0, high: float = 1.0) -> Column:
    """Counts of equal bins; the upper edge belongs to the last, values outside count nowhere."""
    at = F.when(x == high, F.lit(bins - 1)).otherwise(F.floor((x - low) * bins / (high - low)))
    inside = x.between(low, high)
    return F.array(*(F.count_if(inside & (at == i)) for i in range(bins)))
