"""Row-level operators: order, sets of rows, changes, grouping of runs, exact group quantiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanglass.operators import ranks
from spanglass.sources.tables import scratch


def with_row_id(df: DataFrame, order: list[str | Column], name: str = "row_id") -> DataFrame:
    """Row numbers from 0 in a given order (that of the partitions, if none is given), without gathering the rows in one task.

    Rows are sorted into ranges, which are written once: their bounds come from a sample, and a second reading might draw other ones.
    Each range's size, one number, gives where its numbering starts.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    at = scratch(placed.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("bigint"), 33)), "row-ids")
    sizes = at.groupBy("__p").agg((F.max("__m") + 1).alias("n"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return at.join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + F.col("__m")).drop("__p", "__m", "__start")


def ordered(df: DataFrame, *keys: tuple[str, bool], row: str = "row_id") -> DataFrame:
    """ORDER BY: (column, ascending); null is the lowest value, ties keep row order."""
    return df.orderBy(*(F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in keys), row)


def sorted_table(df: DataFrame, *keys: tuple[str, bool], row: str = "row_id") -> DataFrame:
    """The table's own sort: undefined cells are the highest."""
    return df.orderBy(*(F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in keys), row)


def first_of_each(df: DataFrame, *columns: str, row: str = "row_id") -> DataFrame:
    """DISTINCT on some columns that keeps the first row; a min that combines before the shuffle."""
    rest = [c for c in df.columns if c not in columns]
    best = df.groupBy(*columns).agg(F.min(F.struct(F.col(row), *(F.col(c).alias(f"_{i}") for i, c in enumerate(rest)))).alias("b"))
    return best.select(*columns, *(F.col(f"b._{i}").alias(c) for i, c in enumerate(rest))).select(*df.columns)


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def common_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def other_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def concatenated(*tables: DataFrame) -> DataFrame:
    """Tables with identical schemas, one after another."""
    if any(t.schema.simpleString() != tables[0].schema.simpleString() for t in tables):
        raise ValueError("concatenated tables need identical schemas")
    return reduce(DataFrame.unionAll, tables)


# ---- changes; each gives a new table


def first_matching(df: DataFrame, where: Column, limit: int, row: str) -> Column:
    """Whether a row is among the first ``limit`` matching ones, by the row id of the last of them (the one value that is fetched)."""
    hit = F.coalesce(where, F.lit(False))
    if limit <= 0:
        return F.lit(False)
    last = df.filter(where).select(row).orderBy(row).offset(limit - 1).limit(1).collect()
    return hit & (F.col(row) <= last[0][0]) if last else hit


def updated(df: DataFrame, values: dict[str, Column], where: Column | None = None, limit: int | None = None, row: str = "row_id") -> DataFrame:
    """All new values are computed from the old row."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    if limit is not None:
        hit = first_matching(df, hit, limit, row)
    return df.select(*(F.when(hit, values[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns))


def deleted(df: DataFrame, where: Column | None = None, limit: int | None = None, row: str = "row_id") -> DataFrame:
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return df.filter(~(first_matching(df, hit, limit, row) if limit is not None else hit))


def inserted(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns that the new rows lack are null."""
    extra = set(rows.columns) - set(df.columns)
    if extra:
        raise ValueError(f"no such columns: {sorted(extra)}")
    return df.unionByName(rows, allowMissingColumns=True)


DEFAULTS = {"boolean": False, "string": "", "double": 0.0, "float": 0.0}


def with_new_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """ADD COLUMN: filled with the type's default."""
    return df.withColumn(name, F.lit(DEFAULTS.get(kind, 0)).cast(kind))


def with_new_rows(df: DataFrame, n: int) -> DataFrame:
    """ADD ROW: n rows of defaults."""
    return df.unionByName(df.sparkSession.range(n).select(*(F.lit(DEFAULTS.get(t, 0)).cast(t).alias(c) for c, t in df.dtypes)))


# ---- groups


def runs(df: DataFrame, keys: list[str], order: str, within: list[str] | None = None, name: str = "run") -> DataFrame:
    """Number the runs of equal neighbouring keys, in an order, separately for each ``within``."""
    w = Window.partitionBy(*(within or [])).orderBy(order)
    changed = reduce(lambda a, b: a | b, [~F.col(k).eqNullSafe(F.lag(k).over(w)) for k in keys])
    begins = df.withColumn("__new", F.when(F.row_number().over(w) == 1, 0).otherwise(changed.cast("int")))
    return begins.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def group_fractile(df: DataFrame, keys: list[str], x: str, f: float, name: str) -> DataFrame:
    """The value at floor((n - 1) f) of each group, exactly; no group is gathered or sorted (``ranks``)."""
    return ranks.at_places(df, keys, x, {name: lambda n: F.floor((n - 1) * F.lit(f))}).drop("n")
