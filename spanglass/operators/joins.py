"""Joins by time, position and row number."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanglass.functions import sky
from spanglass.operators.ranks import joined
from spanglass.sources.tables import scratch


PARTS = 256  # ranges of time
CELL_POINTS = 64  # of a cell of the sky
RANGES, PIECE = 64, 2000  # of values, and rows of a piece of such a range


def _with_neighbours(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str]) -> DataFrame:
    """Each left row with the last right row at or before its time and the first at or after it, as structs.

    Time is cut into ranges, and a task sorts a range of a key, not its whole history.  What a range needs from beyond its ends is one right row on each side, which is carried
    over from the ranges' own first and last rows (as many as there are ranges).  Nothing is multiplied.  Left rows without a time have no neighbours.
    """
    right = right.filter(F.col(time).isNotNull())
    first, last = right.agg(F.min(time), F.max(time)).first()
    first, width = (first or 0), (((last - first) / PARTS) or 1) if first is not None else 1
    place = F.least(F.greatest(F.floor((F.col(time) - first) / width), F.lit(-1)), F.lit(PARTS + 1)).cast("int")
    cut = F.when(F.col(time).isNotNull(), place).alias("__cut")  # least and greatest pass over nulls
    packed = F.struct(F.col(time).alias("time"), *values)
    kind, left_kind = right.select(packed).schema[0].dataType, left.select(F.struct(*left.columns)).schema[0].dataType
    a = left.select(*by, cut, F.col(time).alias("__t"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(kind).alias("__right"))
    b = right.select(*by, cut, F.col(time).alias("__t"), F.lit(None).cast(left_kind).alias("__left"), packed.alias("__right"))

    ends = b.groupBy(*by, "__cut").agg(F.min_by("__right", "__t").alias("__first"), F.max_by("__right", "__t").alias("__last"))
    wanted = a.filter("__cut IS NOT NULL").select(*by, "__cut").distinct().select(*by, "__cut", F.lit(None).cast(kind).alias("__first"), F.lit(None).cast(kind).alias("__last"))
    cells = ends.unionByName(wanted).groupBy(*by, "__cut").agg(F.first("__first", ignorenulls=True).alias("__first"), F.first("__last", ignorenulls=True).alias("__last"))
    ranges = Window.partitionBy(*by).orderBy("__cut")
    carried = cells.select(
        *by, "__cut", F.last("__last", ignorenulls=True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("__from_before"), F.first("__first", ignorenulls=True).over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("__from_after")
    )
    # Right rows come first at equal times looking back, and count as well looking ahead.
    both = a.unionByName(b).withColumn("__side", F.col("__left").isNotNull().cast("int"))
    back = Window.partitionBy(*by, "__cut").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by, "__cut").orderBy(F.desc("__t"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("before", F.last("__right", ignorenulls=True).over(back)).withColumn("after", F.last("__right", ignorenulls=True).over(ahead)).filter("__side = 1")
    near = joined(both, carried, [*by, "__cut"], "left")
    within = F.col("__cut").isNotNull()
    return near.select("__left.*", F.when(within, F.coalesce("before", "__from_before")).alias("before"), F.when(within, F.coalesce("after", "__from_after")).alias("after"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str]) -> DataFrame:
    """The nearest right row in time; at equal distance the earlier.  Left rows without one have nulls."""
    d = _with_neighbours(left, right, by, time, values)
    earlier = F.col("after").isNull() | (F.col("before").isNotNull() & (F.col(time) - F.col("before.time") <= F.col("after.time") - F.col(time)))
    pick = F.when(earlier, F.col("before")).otherwise(F.col("after"))
    return d.withColumn("__pick", pick).select(*left.columns, F.col("__pick.time").alias(f"{time}_of"), *(F.col(f"__pick.{v}").alias(v) for v in values))


def interpolated(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """``value`` between the neighbouring right rows, linear in time; held beyond the ends."""
    d = _with_neighbours(left, right, by, time, [value])
    span = F.col("after.time") - F.col("before.time")
    share = F.when(span > 0, (F.col(time) - F.col("before.time")) / span).otherwise(0.0)
    line = F.col(f"before.{value}") + share * (F.col(f"after.{value}") - F.col(f"before.{value}"))
    return d.select(*left.columns, F.when(F.col("before").isNull(), F.col(f"after.{value}")).when(F.col("after").isNull(), F.col(f"before.{value}")).otherwise(line).alias(value))


def interpolated_gain(left: DataFrame, right: DataFrame, by: list[str], time: str) -> DataFrame:
    """Gains (g_re, g_im, flag) between the neighbouring solutions: amplitude and phase linear in time, the phase by the shorter way round.

    Flagged if one of the two is, or if there is no solution at all; held beyond the ends, and at a solution's own time.
    """
    d = _with_neighbours(left, right, by, time, ["g_re", "g_im", "flag"])
    a, b = F.col("before"), F.col("after")
    between = F.coalesce(b["time"] > a["time"], F.lit(False))
    share = F.when(between, (F.col(time) - a["time"]) / (b["time"] - a["time"]))
    size = lambda g: F.hypot(g["g_re"], g["g_im"])
    turn = F.atan2(b["g_im"] * a["g_re"] - b["g_re"] * a["g_im"], b["g_re"] * a["g_re"] + b["g_im"] * a["g_im"])
    amplitude, phase = size(a) + share * (size(b) - size(a)), F.atan2(a["g_im"], a["g_re"]) + share * turn
    held = F.coalesce(a, b)
    return d.select(
        *left.columns, F.when(between, amplitude * F.cos(phase)).otherwise(held["g_re"]).alias("g_re"), F.when(between, amplitude * F.sin(phase)).otherwise(held["g_im"]).alias("g_im"),
        F.coalesce(F.when(between, a["flag"] | b["flag"]).otherwise(held["flag"]), F.lit(True)).alias("flag"),
    )


def by_row_number(fact: DataFrame, dim: DataFrame, key: str, prefix: str) -> DataFrame:
    """Look up rows of a subtable by its row_id; Spark broadcasts it if its size allows."""
    renamed = dim.select(F.col("row_id").alias(key), *(F.col(c).alias(f"{prefix}{c}") for c in dim.columns if c != "row_id"))
    return fact.join(renamed, key, "left")


def in_cones(points: DataFrame, cones: DataFrame, lon: str, lat: str) -> DataFrame:
    """Pairs of points and cones (cone_id, lon0, lat0, radius) that hold them.

    The sky is cut into bands of declination and these into cells of about the same width; a cone is filed in every cell that it touches, so the
    join is by cell.  The width is that of the middle cone, but at least a 64th of the widest, which bounds the cells of a cone.
    """
    middle, widest = cones.agg(F.percentile_approx("radius", 0.5), F.max("radius")).first()
    width = max(middle or 0.0, (widest or 1.0) / 64, math.pi / 10_000)
    turn = 2 * math.pi
    band = lambda x: F.floor(x / width).cast("int")
    nearest = F.least(F.abs(F.col("__band") * width), F.abs((F.col("__band") + 1) * width))
    least = F.when((F.col("__band") < 0) & (F.col("__band") + 1 > 0), 0.0).otherwise(nearest)  # of a band's declinations, from the equator
    n = F.greatest(F.floor(turn * F.cos(F.least(least, F.lit(math.pi / 2))) / width), F.lit(1)).cast("int")
    filed = cones.withColumn("__band", F.explode(F.sequence(band(F.col("lat0") - F.col("radius")), band(F.col("lat0") + F.col("radius"))))).withColumn("__n", n)
    polar = F.abs("lat0") + F.col("radius") >= math.pi / 2 - 1e-9
    half = F.when(polar, math.pi).otherwise(F.asin(F.least(F.sin("radius") / F.cos("lat0"), F.lit(1.0))) + 1e-9)
    place = lambda x: F.floor(x / turn * F.col("__n")).cast("int")
    begin, end = place(F.col("lon0") - half), place(F.col("lon0") + half)
    cells = F.transform(F.sequence(begin, F.least(end, begin + F.col("__n") - 1)), lambda k: F.pmod(k, F.col("__n")))
    filed = filed.withColumn("__cell", F.explode(F.array_distinct(cells))).drop("__n")
    placed = points.withColumn("__band", band(F.col(lat))).withColumn("__n", n).withColumn("__cell", F.least(place(F.pmod(F.col(lon), F.lit(turn))), F.col("__n") - 1)).drop("__n")
    near = placed.join(filed, ["__band", "__cell"])
    return near.filter(sky.distance(F.col(lon), F.col(lat), F.col("lon0"), F.col("lat0")) <= F.col("radius")).drop("__band", "__cell")


def cone_summaries(points: DataFrame, cones: DataFrame, lon: str, lat: str, of: str) -> DataFrame:
    """(cone_id, n, first): how many points each cone (cone_id, lon0, lat0, radius) holds, and the least ``of`` of them; no row for an empty cone.

    As in ``in_cones``, but cells hold some 64 points each, however many there are, and only those on a cone's edge are looked at point by point.  The cells that lie
    whole in a cone make one run in each band; it is put together from blocks of 1, 2, 4 ... cells, which are summed up once.  So a cone's share of the work
    grows with the square root of the points.
    """
    total = points.count()
    cone_count, middle, widest = cones.agg(F.count(F.lit(1)), F.percentile_approx("radius", 0.5), F.max("radius")).first()
    width = max(min(math.sqrt(4 * math.pi * CELL_POINTS / max(total, 1)), middle or 1.0), (widest or 1.0) / 64, math.pi / 10_000)
    turn, levels = 2 * math.pi, math.ceil(math.log2(2 * math.pi / width)) + 1
    band = lambda x: F.floor(x / width).cast("int")
    low, high = F.col("__band") * F.lit(width), (F.col("__band") + 1) * F.lit(width)
    equator = (F.col("__band") < 0) & (F.col("__band") + 1 > 0)
    cells = F.greatest(F.floor(turn * F.cos(F.least(F.when(equator, 0.0).otherwise(F.least(F.abs(low), F.abs(high))), F.lit(math.pi / 2))) / width), F.lit(1)).cast("int")
    place = F.least(F.floor(F.pmod(F.col("__lon"), F.lit(turn)) / turn * F.col("__n")).cast("int"), F.col("__n") - 1)
    placed = points.select(F.col(of).alias("__of"), F.col(lon).alias("__lon"), F.col(lat).alias("__lat"), band(F.col(lat)).alias("__band")).withColumn("__n", cells).withColumn("__cell", place).drop("__n")

    # Half of a cone's extent in longitude at a declination; between a band's ends it has no minimum, and one maximum at most.
    half = lambda d: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.cos("radius") - F.sin(d) * F.sin("lat0")) / (F.cos(d) * F.cos("lat0")))))
    hard = (F.abs("lat0") + F.col("radius") >= math.pi / 2 - 1e-3) | (F.cos(low) * F.cos(high) * F.cos("lat0") < 0.01) | (F.greatest(F.abs(low), F.abs(high)) >= math.pi / 2)  # by the poles all cells are looked at
    summit = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin("lat0") / F.cos("radius"))))
    bulge = F.when(summit.between(low - 1e-6, high + 1e-6), F.asin(F.least(F.lit(1.0), F.sin("radius") / F.cos("lat0")))).otherwise(0.0)
    dealt = cones.repartition(int(min(max((cone_count or 0) / 2000, 8), 2000)), "cone_id")  # a small file has one task, but its cones have much to file
    filed = dealt.select("cone_id", "lon0", "lat0", "radius", F.explode(F.sequence(band(F.col("lat0") - F.col("radius") - 1e-9), band(F.col("lat0") + F.col("radius") + 1e-9))).alias("__band"))
    filed = filed.filter("radius >= 0").withColumn("__n", cells).withColumn("__hard", hard).withColumn("__h0", half(low)).withColumn("__h1", half(high))
    filed = filed.withColumn("__out", F.when(F.col("__hard"), math.pi).otherwise(F.greatest("__h0", "__h1", bulge) + 1e-6)).withColumn("__in", F.when(F.col("__hard"), 0.0).otherwise(F.least("__h0", "__h1") - 1e-6))
    at = lambda x: (F.pmod(F.col("lon0"), F.lit(turn)) + x) / turn * F.col("__n")
    filed = filed.withColumn("__o0", F.floor(at(-F.col("__out"))).cast("int")).withColumn("__o1", F.least(F.floor(at(F.col("__out"))).cast("int"), F.col("__o0") + F.col("__n") - 1))
    filed = filed.withColumn("__i0", F.ceil(at(-F.col("__in"))).cast("int")).withColumn("__i1", F.least(F.floor(at(F.col("__in"))).cast("int"), F.col("__o0") + F.col("__n")))
    run = (F.col("__in") > 1e-3) & (F.col("__i0") < F.col("__i1"))

    none = F.array().cast("array<int>")
    some = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    edge = F.when(run, F.concat(some(F.col("__o0"), F.col("__i0") - 1), some(F.col("__i1"), F.col("__o1")))).otherwise(some(F.col("__o0"), F.col("__o1")))
    edges = filed.withColumn("__cell", F.explode(edge)).select("cone_id", "lon0", "lat0", "radius", "__band", F.pmod("__cell", "__n").alias("__cell"))
    looked_at = (cone_count or 0) * (8 * (middle or 0.0) / width + 4) * CELL_POINTS
    parts = int(min(max(looked_at / 1_000_000, 8), 2000))
    near = placed.repartition(parts, "__band", "__cell").hint("shuffle_hash").join(edges.repartition(parts, "__band", "__cell"), ["__band", "__cell"])
    held = near.filter(sky.distance(F.col("__lon"), F.col("__lat"), F.col("lon0"), F.col("lat0")) <= F.col("radius")).select("cone_id", F.lit(1).cast("bigint").alias("n"), F.col("__of").alias("first"))

    block = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    blocks = placed.groupBy("__band", "__cell").agg(F.count(F.lit(1)).alias("n"), F.min("__of").alias("first")).withColumn("__level", block)
    blocks = blocks.groupBy("__band", "__level", F.expr("shiftright(__cell, __level)").alias("__block")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    runs = filed.filter(run).select("cone_id", "__band", "__n", F.explode(F.array(*(F.struct((F.col("__i0") + k * F.col("__n")).alias("a"), (F.col("__i1") + k * F.col("__n")).alias("b")) for k in (-1, 0, 1)))).alias("__r"))
    runs = runs.select("cone_id", "__band", F.greatest("__r.a", F.lit(0)).alias("__a"), F.least("__r.b", "__n").alias("__b")).filter("__a < __b").withColumn("__level", block)
    runs = runs.withColumn("__a", F.expr("shiftright(__a + shiftleft(1, __level) - 1, __level)")).withColumn("__b", F.expr("shiftright(__b, __level)")).filter("__a < __b")
    ends = F.explode(F.filter(F.array(F.when(F.col("__a") % 2 == 1, F.col("__a")), F.when(F.col("__b") % 2 == 1, F.col("__b") - 1)), lambda x: x.isNotNull()))
    whole = runs.select("cone_id", "__band", "__level", ends.alias("__block")).join(blocks, ["__band", "__level", "__block"]).select("cone_id", "n", "first")
    return held.unionByName(whole).groupBy("cone_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def exceeding(left: DataFrame, right: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
    """Pairs of rows with equal ``by`` of which the right one's ``high`` is above the left one's ``low``.

    There may be as many as the product of both sides.  So left rows are filed by ranges of ``low``, and these in pieces of some thousand rows; a right row goes to
    every piece that holds something below it, and hardly any pair is looked at in vain.  A task holds few pieces at a time, and pairs stream by.
    """
    left = left.filter(F.col(low).isNotNull() & ~F.isnan(F.col(low).cast("double")))
    number = F.col(low).cast("double")
    rows, first, last = left.agg(F.count(F.lit(1)), *(f(F.when(F.abs(number) < float("inf"), number)) for f in (F.min, F.max))).first()
    first, width = first or 0.0, ((last or 0.0) - (first or 0.0)) / RANGES or 1.0
    place = lambda x: F.least(F.greatest(F.floor((x - first) / width), F.lit(0)), F.lit(RANGES - 1)).cast("int")
    ranged = left.withColumn("__range", place(number))
    pieces = scratch(ranged.groupBy(*by, "__range").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("__pieces")), "pieces")
    filed = ranged.join(pieces, [*by, "__range"]).withColumn("__piece", F.pmod(F.xxhash64(*left.columns), F.col("__pieces")).cast("int")).drop("__pieces")
    top = F.when(F.isnan(F.col(high).cast("double")), RANGES - 1).otherwise(place(F.col(high).cast("double")))
    dealt = right.filter(F.col(high).isNotNull()).repartition(int(min(max(rows / PIECE / 8, 8), 2000)), *right.columns)  # a small file has one task, but its rows go to many pieces
    above = dealt.withColumn("__top", top).join(pieces, by).filter("__range <= __top")
    above = above.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1))).drop("__top", "__pieces")
    parts, at = int(min(max(rows / PIECE, 8), 2000)), [*by, "__range", "__piece"]
    both = filed.repartition(parts, *at).hint("shuffle_hash").join(above.repartition(parts, *at), at)
    return both.filter(F.col(high) > F.col(low)).drop("__range", "__piece")


def in_intervals(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs of points and intervals [start, end) that hold them, by buckets of ``width``."""
    bucket = lambda x: F.floor(F.col(x) / width)
    filed = intervals.withColumn("__bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return points.withColumn("__bucket", bucket(at)).join(filed, [*by, "__bucket"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bucket")


def nearest_field(fields: DataFrame, calibrators: DataFrame, limit: int = 500) -> DataFrame:
    """For each field (field_id, lon, lat) the calibrator (cal_id, cal_lon, cal_lat) at the least angle; ties to the smaller id.

    Calibrators are an observing set-up; their number is checked before they become a literal of the plan.
    """
    known = calibrators.select("cal_id", "cal_lon", "cal_lat").limit(limit + 1).collect()
    if len(known) > limit:
        raise ValueError(f"over {limit} calibrators")
    angles = F.array(*(F.struct(sky.distance(F.col("lon"), F.col("lat"), F.lit(c.cal_lon), F.lit(c.cal_lat)).alias("angle"), F.lit(c.cal_id).alias("cal_id")) for c in known))
    return fields.withColumn("__best", F.array_min(angles)).select(*fields.columns, "__best.cal_id", "__best.angle")


def has_all(df: DataFrame, key: str, item: str, wanted: list) -> DataFrame:
    """Keys that hold all wanted items."""
    return df.filter(F.col(item).isin(wanted)).groupBy(key).agg(F.count_distinct(item).alias("n")).filter(F.col("n") == len(set(wanted))).select(key)
