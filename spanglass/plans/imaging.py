"""Registered queries of transforms, feathering, gridding by the spheroidal kernel, beam sets, datasets and flag versions."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanglass.operators import beams, fourier, gridding
from spanglass.plans.catalogue import _VIS, query, table, vis
from spanglass.sources.dataset import Dataset
from spanglass.sources.flag_versions import FlagVersions
from spanglass.sources.tables import shared_folder

# ---- planes: one for each return flag, 50 x 7 pixels

_NX, _NY = 50, 7
_PLANE = "SELECT l_returnflag AS k, CAST(l_quantity AS INTEGER) - 1 AS x, CAST(l_linenumber AS INTEGER) - 1 AS y, sum(l_extendedprice) / 1e4 AS value, sum(l_discount) AS low, max(l_tax) > 0 AS mask FROM lineitem GROUP BY ALL"


def planes(spark, sf) -> DataFrame:
    c = F.col
    return table(spark, sf, "lineitem").groupBy(c("l_returnflag").alias("k"), (c("l_quantity").cast("int") - 1).alias("x"), (c("l_linenumber").cast("int") - 1).alias("y")).agg((F.sum("l_extendedprice") / 1e4).alias("value"), F.sum("l_discount").alias("low"), (F.max("l_tax") > 0).alias("mask"))


def _dft(source: str, re: str, im: str, sign: int) -> str:
    """A plane's transform as a sum over all its pixels, in SQL."""
    angle = f"({sign} * 2 * pi() * ((s.x - {_NX // 2}) * (f.x - {_NX // 2}) / {_NX}.0::DOUBLE + (s.y - {_NY // 2}) * (f.y - {_NY // 2}) / {_NY}.0::DOUBLE))"
    return f"SELECT s.k, f.x, f.y, sum({re} * cos({angle}) - {im} * sin({angle})) AS re, sum({re} * sin({angle}) + {im} * cos({angle})) AS im FROM {source} AS s, (SELECT CAST(a AS INTEGER) AS x, CAST(b AS INTEGER) AS y FROM range({_NX}) AS ra(a), range({_NY}) AS rb(b)) AS f GROUP BY ALL"


@query("fourier_planes", f"WITH p AS ({_PLANE}) SELECT k, x, y, 0.0 + round(re, 3) AS re, 0.0 + round(im, 3) AS im FROM ({_dft('p', 'value', '0', -1)})")
def fourier_planes(spark, sf):
    p = planes(spark, sf).select("k", "x", "y", F.col("value").alias("re"))
    return fourier.transformed(p, ["k"], (_NX, _NY)).select("k", "x", "y", F.round("re", 3).alias("re"), F.round("im", 3).alias("im"))


_BEAM = (3.0, 2.0, 0.4)
_COS, _SIN = math.cos(_BEAM[2] + math.pi / 2), math.sin(_BEAM[2] + math.pi / 2)
_FX, _FY = f"((x - {_NX // 2}) / {_NX}.0::DOUBLE)", f"((y - {_NY // 2}) / {_NY}.0::DOUBLE)"
_LOW = f"exp(-pi() * pi() / (4 * ln(2)) * (pow({_FX} * {_COS!r} + {_FY} * {_SIN!r}, 2) * {_BEAM[0] ** 2} + pow({_FY} * {_COS!r} - {_FX} * {_SIN!r}, 2) * {_BEAM[1] ** 2}))"


@query(
    "feathered_planes",
    f"""WITH p AS ({_PLANE}), h AS ({_dft("p", "value", "0", -1)}), l AS ({_dft("p", "low", "0", -1)}),
        c AS (SELECT h.k, h.x, h.y, h.re * (1 - {_LOW.replace("(x ", "(h.x ").replace("(y ", "(h.y ")}) + l.re * 1.2 * 2.25 / 6 AS re, h.im * (1 - {_LOW.replace("(x ", "(h.x ").replace("(y ", "(h.y ")}) + l.im * 1.2 * 2.25 / 6 AS im FROM h JOIN l ON h.k = l.k AND h.x = l.x AND h.y = l.y),
        i AS ({_dft("c", "re", "im", 1)})
        SELECT i.k, i.x, i.y, 0.0 + round(i.re / {_NX * _NY}, 3) AS value, coalesce(mask, false) AS mask FROM i LEFT JOIN p ON i.k = p.k AND i.x = p.x AND i.y = p.y""",
)
def feathered_planes(spark, sf):
    p = planes(spark, sf)
    out = fourier.feathered(p.select("k", "x", "y", "value", "mask"), p.select("k", "x", "y", F.col("low").alias("value"), "mask"), ["k"], (_NX, _NY), (1.5, 1.5), _BEAM, factor=1.2)
    return out.select("k", "x", "y", F.round("value", 3).alias("value"), "mask")


# ---- gridding

_SAMPLES = "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS row, l_extendedprice / 1000 AS u, l_quantity * 0.7 AS v, 1.0::DOUBLE + l_tax AS re, l_discount AS im, 1.0::DOUBLE + l_linenumber AS w, CAST(floor(l_partkey % 40 / 10.0 + 0.5) AS INTEGER) AS plane FROM lineitem"


def _horner(coefficients: tuple, x: str) -> str:
    out = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r})"
    return out


def _kernel_sql(distance: str) -> str:
    n = f"(abs({distance}) / 3.0::DOUBLE)"
    inner, outer = f"({n} * {n} - 0.5625)", f"({n} * {n} - 1.0)"
    g = gridding
    return f"(CASE WHEN {n} > 1 THEN 0 WHEN {n} < 0.75 THEN (1 - {n} * {n}) * {_horner(g.P_INNER, inner)} / {_horner(g.Q_INNER, inner)} ELSE (1 - {n} * {n}) * {_horner(g.P_OUTER, outer)} / {_horner(g.Q_OUTER, outer)} END)"


_TAPS = f"""s AS ({_SAMPLES}), i AS (SELECT unnest(range(-3, 4)) AS i),
  tu AS (SELECT row, CAST(floor(u / 2.5 + 0.5) AS INTEGER) + i AS gu, {_kernel_sql("(u / 2.5 - floor(u / 2.5 + 0.5) - i)")} AS k FROM s, i), tv AS (SELECT row, CAST(floor(v / 2.5 + 0.5) AS INTEGER) + i AS gv, {_kernel_sql("(v / 2.5 - floor(v / 2.5 + 0.5) - i)")} AS k FROM s, i),
  nu AS (SELECT row, gu, k / sum(k) OVER (PARTITION BY row) AS k FROM tu), nv AS (SELECT row, gv, k / sum(k) OVER (PARTITION BY row) AS k FROM tv),
  t AS (SELECT row, CAST(gu AS INTEGER) AS gu, CAST(gv AS INTEGER) AS gv, nu.k * nv.k AS k FROM nu JOIN nv USING (row) WHERE nu.k > 0 AND nv.k > 0),
  g AS (SELECT plane, gu, gv, sum(k * w * re) AS re, sum(k * w * im) AS im, sum(k * w) AS weight FROM t JOIN s USING (row) GROUP BY ALL)"""


def samples(spark, sf) -> DataFrame:
    c = F.col
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (c("l_extendedprice") / 1000).alias("u"), (c("l_quantity") * 0.7).alias("v"), (1 + c("l_tax")).alias("re"), c("l_discount").alias("im"), (1.0 + c("l_linenumber")).alias("imaging_weight"), gridding.w_plane(c("l_partkey") % 40, 10.0).alias("plane"))


@query("gridded_planes", f"WITH {_TAPS} SELECT plane, gu, gv, 0.0 + round(re, 4) AS re, 0.0 + round(im, 4) AS im, round(weight, 4) AS weight FROM g")
def gridded_planes(spark, sf):
    g = gridding.gridded(samples(spark, sf), 2.5, ["plane"])
    return g.select("plane", "gu", "gv", *(F.round(x, 4).alias(x) for x in ("re", "im", "weight")))


@query(
    "degridded_samples",
    f"""WITH {_TAPS}, m AS (SELECT row, sum(k * g.re / g.weight) AS re, sum(k * g.im / g.weight) AS im FROM t JOIN s USING (row) JOIN g USING (plane, gu, gv) GROUP BY row)
        SELECT plane, count(*) AS n, round(sum(m.re), 2) AS model, round(sum(s.re), 2) AS data, 0.0 + round(sum(m.im), 2) AS model_im, round(sum(pow(m.re - s.re, 2) + pow(m.im - s.im, 2)), 3) AS misfit FROM m JOIN s USING (row) GROUP BY plane""",
)
def degridded_samples(spark, sf):
    s = samples(spark, sf)
    g = gridding.gridded(s, 2.5, ["plane"])
    mean = g.select("plane", "gu", "gv", (F.col("re") / F.col("weight")).alias("re"), (F.col("im") / F.col("weight")).alias("im"))
    row = F.struct("u", "v", "re", "im", "plane")  # all that the sums need goes along
    both = gridding.degridded(s.select(row.alias("row"), "plane", "u", "v"), mean, 2.5, "row", ["plane"]).select("row.*", "model_re", "model_im")
    misfit = F.pow(F.col("model_re") - F.col("re"), 2) + F.pow(F.col("model_im") - F.col("im"), 2)
    return both.groupBy("plane").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("model_re"), 2).alias("model"), F.round(F.sum("re"), 2).alias("data"), F.round(F.sum("model_im"), 2).alias("model_im"), F.round(F.sum(misfit), 3).alias("misfit"))


# ---- beams: a set for each brand

_BEAMS = "SELECT p_brand AS brand, p_partkey AS part, 2.0::DOUBLE + p_size / 10.0 AS major, 1.0::DOUBLE + p_partkey % 9 / 10.0 AS minor, p_partkey % 31 / 10.0::DOUBLE AS angle FROM part"


def beam_sets(spark, sf) -> DataFrame:
    c = F.col
    return table(spark, sf, "part").select(c("p_brand").alias("brand"), c("p_partkey").alias("part"), (2.0 + c("p_size") / 10).alias("major"), (1.0 + c("p_partkey") % 9 / 10).alias("minor"), (c("p_partkey") % 31 / 10).alias("angle"))


@query(
    "beam_extremes",
    f"""WITH b AS (SELECT *, pi() / (4 * ln(2)) * major * minor AS area FROM ({_BEAMS})), o AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY area, part) AS r, count(*) OVER (PARTITION BY brand) AS n FROM b)
        SELECT brand, count(*) AS n, arg_min(part, (area, part)) AS smallest, arg_min(part, (-area, part)) AS largest, max(part) FILTER (r = (n + 1) // 2) AS middle, round(max(area), 6) AS largest_area FROM o GROUP BY brand""",
)
def beam_extremes(spark, sf):
    return beams.beam_extremes(beam_sets(spark, sf), ["brand"], ["part"]).select("brand", "n", F.col("smallest.part").alias("smallest"), F.col("largest.part").alias("largest"), F.col("median.part").alias("middle"), F.round("largest.area", 6).alias("largest_area"))


@query("common_beams", f"SELECT brand, max(major) AS major, max(minor) AS minor, 0.0::DOUBLE AS angle FROM ({_BEAMS}) GROUP BY brand UNION ALL SELECT brand || ' turned', max(major), max(minor), 0.7::DOUBLE FROM ({_BEAMS}) GROUP BY brand")
def common_beams(spark, sf):
    """Of beams that point one way the common one has the largest of both widths; the angle is told apart by the set."""
    b = beam_sets(spark, sf)
    both = b.withColumn("angle", F.lit(0.0)).unionByName(b.withColumn("angle", F.lit(0.7)).withColumn("brand", F.concat("brand", F.lit(" turned"))))
    return beams.common_beams(both, ["brand"], ["part"]).select("brand", *(F.round(c, 9).alias(c) for c in ("major", "minor", "angle")))


_OF = {"a": "({0} * {0} * sin({2}) * sin({2}) + {1} * {1} * cos({2}) * cos({2}))", "b": "(({0} * {0} - {1} * {1}) * sin({2}) * cos({2}))", "c": "({0} * {0} * cos({2}) * cos({2}) + {1} * {1} * sin({2}) * sin({2}))"}
_DELTA = {k: f"({v.format('major', 'minor', 'angle')} - {v.format('2.5', '1.25', '0.6')})" for k, v in _OF.items()}


@query(
    "beam_deconvolution",
    f"""WITH d AS (SELECT part, {_DELTA["a"]} AS a, {_DELTA["b"]} AS b, {_DELTA["c"]} AS c FROM ({_BEAMS})), e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS large, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS small FROM d)
        SELECT part, CASE WHEN small >= 0 THEN round(sqrt(large), 6) END AS major, CASE WHEN small >= 0 THEN round(sqrt(small), 6) END AS minor FROM e""",
)
def beam_deconvolution(spark, sf):
    found = beams.deconvolved(F.col("major"), F.col("minor"), F.col("angle"), F.lit(2.5), F.lit(1.25), F.lit(0.6))
    return beam_sets(spark, sf).withColumn("d", found).select("part", F.round("d.major", 6).alias("major"), F.round("d.minor", 6).alias("minor"))


# ---- datasets and flag versions


@query(
    "dataset_report",
    """SELECT 'main' AS table_name, 'antenna1' AS column_name, 'refers to nothing' AS issue, 'antenna' AS detail, count(*) AS n FROM lineitem WHERE l_suppkey % 30 >= 25 UNION ALL
       SELECT 'main', 'state_id', 'refers to nothing', 'state', count(*) FROM lineitem WHERE l_linenumber - 2 >= (SELECT count(*) FROM region) OR l_linenumber - 2 < -1 UNION ALL
       SELECT 'data_description', 'spectral_window_id', 'refers to nothing', 'spectral_window', count(*) FROM part WHERE p_size % 40 >= (SELECT count(*) FROM nation) UNION ALL
       SELECT 'spectral_window', 'chan_freq', 'another size than told', 'num_chan', count(*) FROM nation WHERE n_nationkey % 4 = 3 UNION ALL
       SELECT 'field', 'row_id', 'row numbers are not 0, 1, 2 ...', '', count(*) FROM customer""",
)
def dataset_report(spark, sf):
    """A dataset made of the tables, with faults of each kind."""
    c = F.col
    main = table(spark, sf, "lineitem").select((c("l_suppkey") % 30).cast("int").alias("antenna1"), (c("l_partkey") % 25).cast("int").alias("antenna2"), (c("l_linenumber") - 2).cast("int").alias("state_id"))
    antenna = table(spark, sf, "nation").select(c("n_nationkey").cast("bigint").alias("row_id"), c("n_name").alias("name"))
    windows = table(spark, sf, "nation").select(c("n_nationkey").cast("bigint").alias("row_id"), F.lit(2).alias("num_chan"), F.when(c("n_nationkey") % 4 == 3, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("chan_freq"))
    link = table(spark, sf, "part").select(c("p_partkey").alias("row_id"), (c("p_size") % 40).cast("int").alias("spectral_window_id"))
    state = table(spark, sf, "region").select(c("r_regionkey").cast("bigint").alias("row_id"))
    field = table(spark, sf, "customer").select((c("c_custkey") + 5).alias("row_id"))
    return Dataset({"main": main, "antenna": antenna, "spectral_window": windows, "data_description": link, "state": state, "field": field}).report(schemas=False).withColumnsRenamed({"table": "table_name", "column": "column_name"})


@query("flag_version_restored", f"SELECT baseline, corr, chan, count_if(flag)::BIGINT AS before, count_if(flag OR chan < 10)::BIGINT AS either, count_if(flag AND chan < 10)::BIGINT AS common FROM ({_VIS}) GROUP BY ALL")
def flag_version_restored(spark, sf):
    """Flags saved, changed, and restored in each way; keys tell the table's rows apart."""
    v = vis(spark, sf).groupBy("baseline", "corr", "chan").agg(F.collect_list("flag").alias("f")).select("baseline", "corr", "chan", F.posexplode("f").alias("i", "flag"))
    keys = ["baseline", "corr", "chan", "i"]
    store = FlagVersions(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}", keys)
    store.save(v, "first", "as read")
    saved = store.flags("first")
    cut = saved.withColumn("flag", F.col("chan") < 10)
    out = None
    for name, how in (("before", "replace"), ("either", "or"), ("common", "and")):
        part = store.restore(cut, "first", how).groupBy("baseline", "corr", "chan").agg(F.count_if("flag").alias(name))
        out = part if out is None else out.join(part, ["baseline", "corr", "chan"])
    return out
