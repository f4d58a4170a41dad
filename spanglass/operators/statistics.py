"""Reports of statistics over several groupings of the same rows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanglass.operators import ranks
from spanglass.sources.tables import scratch

#: What calibration tables are grouped by, besides all rows together.
GROUPINGS = {"field": "field_id", "spw": "spectral_window_id", "antenna": "antenna1", "observation": "observation_id"}
SORTED = 250_000  # rows that a task sorts, besides what the last group adds
#: Amplitude, phase, real and imaginary part of a gain (g_re, g_im).
AXES = {"amp": lambda: F.hypot("g_re", "g_im"), "phase": lambda: F.atan2("g_im", "g_re"), "real": lambda: F.col("g_re"), "imag": lambda: F.col("g_im")}


def calibration_report(gains: DataFrame, axis: str | Column = "amp", groupings: dict[str, str] | None = None, use_flags: bool = True) -> DataFrame:
    """(grouping, key, 16 statistics) of one value of a calibration table: over all rows, and by field, window, antenna and observation.

    npts, flagged_npts, total_npts, sum, sumsq, min, max, mean, median, medabsdevmed, q1, q3, quartile, var, stddev, rms.
    Variance is the population's.  q1 and q3 are the medians of the lower and the upper half without the middle value, 0 where a half is empty.
    With ``use_flags`` flagged values only count in flagged_npts and total_npts.  Null values count nowhere; a group without a value that counts has no row.
    The key of all rows together is null.
    """
    groupings = GROUPINGS if groupings is None else groupings
    value = AXES[axis]() if isinstance(axis, str) else axis
    no_key = F.lit(None).cast("bigint")
    groups = F.explode(F.array(F.struct(F.lit("all").alias("grouping"), no_key.alias("key")), *(F.struct(F.lit(name).alias("grouping"), F.col(c).cast("bigint").alias("key")) for name, c in groupings.items())))
    d = gains.select(value.cast("double").alias("__v"), F.coalesce(F.col("flag"), F.lit(False)).alias("__flag"), groups.alias("__g")).filter("__v IS NOT NULL").select("__g.*", "__v", "__flag")
    keys = ["grouping", "key"]
    used = d.filter("NOT __flag") if use_flags else d
    v = F.when(~F.col("__flag"), F.col("__v")) if use_flags else F.col("__v")
    sums = d.groupBy(*keys).agg(
        F.count(v).alias("npts"), F.count_if("__flag").alias("flagged_npts"), F.count(F.lit(1)).alias("total_npts"), F.sum(v).alias("sum"), F.sum(v * v).alias("sumsq"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.sqrt(F.avg(v * v)).alias("rms"),
    )
    # Groups of few rows are moved once and sorted; counted in ranges, they would leave about as many rows.
    sums = scratch(sums.filter("npts > 0"), "report-sums")
    many = sums.filter(F.col("npts") > ranks.FEW).select(F.col("grouping").alias("__grouping"), F.col("key").alias("__key"))
    is_many = F.col("grouping").eqNullSafe(F.col("__grouping")) & F.col("key").eqNullSafe(F.col("__key"))
    moved = sums.filter(F.col("npts") <= ranks.FEW).agg(F.sum("npts")).first()[0] or 0
    few = used.join(F.broadcast(many), is_many, "left_anti").repartition(moved // SORTED + 1, *keys)
    found = _sorted_ranks(few, keys)
    if not many.isEmpty():
        large = used.join(F.broadcast(many), is_many, "left_semi")
        # A group has more than FEW rows, so there are few medians: they go to the rows, not the rows to them.
        halves = scratch(ranks.median_and_halves(large, keys, "__v").drop("n"), "report-halves")
        spread = ranks.deviations_from(large, F.broadcast(halves.select(*keys, "median")), keys, "__v", "medabsdevmed")
        found = found.unionByName(ranks.joined(halves, spread, keys))
    out = ranks.joined(sums, found, keys)
    return out.withColumn("quartile", F.col("q3") - F.col("q1")).withColumn("stddev", F.sqrt("var"))


def _sorted_ranks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., median, q1, q3, medabsdevmed) of groups that each fit in a task: one shuffle, and two sorts after it."""
    by_value = Window.partitionBy(*keys).orderBy("__v")
    whole = by_value.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, part = F.col("__n"), F.floor(F.col("__n") / 2)

    def at(rank: str, place: Column, value: str) -> Column:
        return F.max(F.when(F.col(rank) - 1 == place, F.col(value)))

    def middle(first: Column, n: Column, rank: str = "__r", value: str = "__v") -> Column:
        """The mean of the one or two middle values of the ``n`` from place ``first`` on; null of none."""
        return F.when(F.max(n) > 0, (at(rank, first + F.floor((n - 1) / 2), value) + at(rank, first + F.floor(n / 2), value)) / 2)

    d = rows.select(*keys, "__v").withColumn("__r", F.row_number().over(by_value)).withColumn("__n", F.count(F.lit(1)).over(whole))
    d = d.withColumn("__m", (at("__r", F.floor((n - 1) / 2), "__v").over(whole) + at("__r", F.floor(n / 2), "__v").over(whole)) / 2)
    d = d.withColumn("__d", F.abs(F.col("__v") - F.col("__m"))).withColumn("__s", F.row_number().over(Window.partitionBy(*keys).orderBy("__d")))
    none, start = F.lit(0.0), F.lit(0)
    return d.groupBy(*keys).agg(F.max("__m").alias("median"), F.coalesce(middle(start, part), none).alias("q1"), F.coalesce(middle(n - part, part), none).alias("q3"), middle(start, n, "__s", "__d").alias("medabsdevmed"))
