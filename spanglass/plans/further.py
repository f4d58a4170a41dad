"""More registered queries, in the same register as ``catalogue``: joins, functions, arrays, flags, calibration, summaries and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanglass.functions import aggregates as ag
from spanglass.functions import arrays, logic, sky
from spanglass.functions import time as mjd
from spanglass.operators import joins, lattice, rows, selection, visibilities
from spanglass.plans.catalogue import _CUBE, _UV, _VIS, cube, query, table, uv, vis

# ---- joins and subqueries


@query("inner_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_totalprice > 100000")
def inner_join(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf, "orders").filter("o_totalprice > 100000").join(c, "o_custkey").select("o_orderkey", "c_mktsegment")


@query("right_join", "SELECT n_name, s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 3000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def right_join(spark, sf):
    s = table(spark, sf, "supplier").filter("s_acctbal > 3000").withColumnRenamed("s_nationkey", "n_nationkey")
    return s.join(table(spark, sf, "nation"), "n_nationkey", "right").select("n_name", "s_suppkey")


@query("theta_join", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal > c_acctbal + 5000")
def theta_join(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") + 5000).alias("least"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    return joins.exceeding(c, s, ["nation"], "least", "s_acctbal").select("c_custkey", "s_suppkey")


@query("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_subquery(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("scalar_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > 0.95 * (SELECT avg(p_retailprice) FROM part WHERE p_size < 10)")
def scalar_subquery(spark, sf):
    p = table(spark, sf, "part")
    mean = p.filter("p_size < 10").agg(F.avg("p_retailprice").alias("m")).scalar()
    return p.filter(F.col("p_retailprice") > 0.95 * mean).select("p_partkey")


@query("index_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (7, 19, 100) OR o_custkey BETWEEN 300 AND 320")
def index_lookup(spark, sf):
    return table(spark, sf, "orders").filter(logic.in_ranges(F.col("o_custkey"), (7, 7), (19, 19), (100, 100), (300, 320))).select("o_orderkey", "o_custkey", "o_totalprice")


# ---- functions of scalars


@query("bitwise", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 21) AS x, ~p_size AS n FROM part")
def bitwise(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", s.bitwiseAND(12).alias("a"), s.bitwiseOR(3).alias("o"), s.bitwiseXOR(21).alias("x"), F.bitwise_not(s).alias("n"))


@query("ilike_and_glob", "SELECT p_partkey, p_brand ILIKE 'bRAND#1%' AS i, p_name GLOB '*a?e*' AS g FROM part")
def ilike_and_glob(spark, sf):
    return table(spark, sf, "part").select("p_partkey", logic.ilike(F.col("p_brand"), "bRAND#1%").alias("i"), logic.glob(F.col("p_name"), "*a?e*").alias("g"))


@query("trims_and_case", "SELECT c_custkey, lower(c_name) AS low, ltrim('  ' || c_name || ' ') AS l, rtrim(' ' || c_name || '  ') AS r, trim('  ' || c_name || ' ') AS t FROM customer")
def trims_and_case(spark, sf):
    n = F.col("c_name")
    return table(spark, sf, "customer").select("c_custkey", F.lower(n).alias("low"), logic.left_trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("l"), logic.right_trim(F.concat(F.lit(" "), n, F.lit("  "))).alias("r"), logic.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("t"))


@query("inverse_and_hyperbolic", "SELECT p_partkey, round(asin(x), 8) AS a, round(acos(x), 8) AS b, round(atan(x), 8) AS c, round(atan2(x, 0.3), 8) AS d, round(sinh(x), 8) AS e, round(cosh(x), 8) AS f, round(tanh(x), 8) AS g FROM (SELECT p_partkey, p_size / 60.0::DOUBLE AS x FROM part)")
def inverse_and_hyperbolic(spark, sf):
    x = F.col("x")
    made = {"a": F.asin(x), "b": F.acos(x), "c": F.atan(x), "d": F.atan2(x, F.lit(0.3)), "e": F.sinh(x), "f": F.cosh(x), "g": F.tanh(x)}
    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 60.0).alias("x")).select("p_partkey", *(F.round(v, 8).alias(k) for k, v in made.items()))


@query("conversions", "SELECT s_suppkey, CAST(trunc(s_acctbal) AS BIGINT) AS i, CAST(s_suppkey AS DOUBLE) AS d, CAST(s_suppkey AS VARCHAR) AS s, s_acctbal <> 0 AS b FROM supplier")
def conversions(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").cast("bigint").alias("i"), F.col("s_suppkey").cast("double").alias("d"), F.col("s_suppkey").cast("string").alias("s"), logic.truth(F.col("s_acctbal"), "double").alias("b"))


@query("smaller_larger_sign", "SELECT s_suppkey, least(s_acctbal, 1000.0::DOUBLE) AS low, greatest(s_acctbal, 1000.0::DOUBLE) AS high, CASE WHEN s_acctbal < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sgn, trunc(s_acctbal / 7) AS whole, round(s_acctbal % 7, 6) AS rest FROM supplier")
def smaller_larger_sign(spark, sf):
    b = F.col("s_acctbal")
    return table(spark, sf, "supplier").select("s_suppkey", logic.smaller(b, F.lit(1000.0)).alias("low"), logic.larger(b, F.lit(1000.0)).alias("high"), logic.sign(b).alias("sgn"), logic.truncated(b / 7).alias("whole"), F.round(b % 7, 6).alias("rest"))


@query("nearness_and_iif", "SELECT p_partkey, abs(p_retailprice - 1500) <= 1e-3 * greatest(p_retailprice, 1500) AS close, abs(p_size - 25) <= 2 AS close_abs, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind FROM part")
def nearness_and_iif(spark, sf):
    p, s = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", logic.near(p, F.lit(1500.0), 1e-3).alias("close"), logic.near_abs(s, F.lit(25), 2).alias("close_abs"), logic.iif(s > 25, F.lit("big"), F.lit("small")).alias("kind"))


@query("date_names", "SELECT o_orderkey, strftime(o_orderdate, '%b') AS mon, strftime(o_orderdate, '%a') AS dow FROM orders")
def date_names(spark, sf):
    t = mjd.mjd_of(F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", mjd.month_name(t).alias("mon"), mjd.weekday_name(t).alias("dow"))


@query("angles_and_doppler", "SELECT p_partkey, round(1 / (1 - v) - 1, 8) AS z, round((1 - (1 - v) * (1 - v)) / (1 + (1 - v) * (1 - v)), 8) AS beta, round(cos(d) * cos(a), 8) AS x, round(sin(d), 8) AS w FROM (SELECT p_partkey, p_size / 100.0::DOUBLE AS v, radians(p_partkey * 7.31 % 360) AS a, radians(p_size) AS d FROM part)")
def angles_and_doppler(spark, sf):
    v = F.col("p_size") / 100.0
    x, _, z = sky.cosines(F.radians(F.col("p_partkey") * 7.31 % 360), F.radians("p_size"))
    return table(spark, sf, "part").select("p_partkey", F.round(sky.doppler(v, "radio", "z"), 8).alias("z"), F.round(sky.doppler(v, "radio", "beta"), 8).alias("beta"), F.round(x, 8).alias("x"), F.round(z, 8).alias("w"))


# ---- aggregates, changes and arrays


@query("group_products", "SELECT p_type, round(ln(product(1 + p_size / 1000.0)), 6) AS log_product, CAST(count_if(NOT p_size > 25) AS BIGINT) AS small FROM part GROUP BY 1")
def group_products(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.round(F.ln(ag.product(1 + F.col("p_size") / 1000.0)), 6).alias("log_product"), ag.count_false(F.col("p_size") > 25).alias("small"))


@query("group_cells", "SELECT user_id, array_to_string(list(event_type ORDER BY event_id), ',') AS kinds, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id % 10 = 0 GROUP BY 1")
def group_cells(spark, sf):
    e = table(spark, sf, "events").filter("event_id % 10 = 0")
    return e.groupBy("user_id").agg(F.array_join(ag.values(F.col("event_type"), F.col("event_id")), ",").alias("kinds"), F.size(ag.row_ids(F.col("event_id"))).cast("bigint").alias("n"))


@query("limited_changes", "WITH h AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier WHERE s_acctbal < 2000) SELECT s.s_suppkey, CASE WHEN k BETWEEN 6 AND 10 THEN 0.0::DOUBLE ELSE s_acctbal END AS s_acctbal FROM supplier s LEFT JOIN h ON s.s_suppkey = h.s_suppkey WHERE coalesce(k, 99) > 5")
def limited_changes(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    kept = rows.deleted(s, F.col("s_acctbal") < 2000, limit=5, row="s_suppkey")
    return rows.updated(kept, {"s_acctbal": F.lit(0.0)}, F.col("s_acctbal") < 2000, limit=5, row="s_suppkey")


_E = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def cells(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


@query("array_moments", f"SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS sumsq, round(list_var_pop(e), 8) AS variance, round(list_stddev_samp(e), 8) AS sigma, list_sort(e)[CAST(floor((len(e) - 1) * 0.25) AS BIGINT) + 1] AS q1, len(list_filter(e, lambda x: x > 0)) > 0 AS any_up, CAST(len(list_filter(e, lambda x: x > 0)) AS BIGINT) AS positive FROM {_E}")
def array_moments(spark, sf):
    e, up = F.col("e"), F.transform("e", lambda x: x > 0)
    return cells(spark, sf).select("vec_id", F.round(arrays.sumsqr(e), 6).alias("sumsq"), F.round(arrays.variance(e), 8).alias("variance"), F.round(arrays.stddev(e, sample=True), 8).alias("sigma"), arrays.fractile(e, 0.25).alias("q1"), arrays.REDUCERS["any"](up).alias("any_up"), arrays.count_true(up).cast("bigint").alias("positive"))


@query("array_shapes", f"SELECT vec_id, e[1 + 2 + 8 * 3] AS one, round(e[1] + e[10] + e[19] + e[28] + e[37] + e[46] + e[55] + e[64], 6) AS trace, e[1 + 8] AS turned, round(e[1] + e[2] + e[9] + e[10], 6) AS corner FROM {_E}")
def array_shapes(spark, sf):
    e, shape = F.col("e"), [8, 8]
    return cells(spark, sf).select("vec_id", arrays.element(e, [3, 4], shape).alias("one"), F.round(arrays.total(arrays.diagonal(e, 8, 8)), 6).alias("trace"), F.get(arrays.transpose(e, 8, 8), F.lit(1)).alias("turned"), F.round(arrays.total(arrays.section(e, [(1, 2), (1, 2)], shape)), 6).alias("corner"))


# ---- visibilities


@query("scalar_average", f"WITH v AS (SELECT *, CASE WHEN flag THEN 0 ELSE weight END AS w FROM ({_VIS})) SELECT baseline, corr, round(coalesce(sum(w * sqrt(re * re + im * im)) / nullif(sum(w), 0), avg(sqrt(re * re + im * im))), 4) AS amplitude, bool_and(flag) AS flag, round(sum(w), 4) AS weight FROM v GROUP BY ALL")
def scalar_average(spark, sf):
    d = visibilities.averaged_over(vis(spark, sf), ["baseline", "corr"], scalar=True)
    return d.select("baseline", "corr", F.round("amplitude", 4).alias("amplitude"), "flag", F.round("weight", 4).alias("weight"))


@query("quack_end", f"WITH v AS (SELECT baseline, time, flag, max(time) OVER (PARTITION BY baseline) AS t1 FROM ({_VIS})) SELECT baseline, CAST(count_if(flag OR t1 - time < 300) AS BIGINT) AS flagged FROM v GROUP BY 1")
def quack_end(spark, sf):
    d = visibilities.quack(vis(spark, sf).withColumnRenamed("flag", "flag_row"), 300.0, end=True, scan=["baseline"])
    return d.groupBy("baseline").agg(F.count_if("flag_row").alias("flagged"))


@query("manual_flags", f"SELECT corr, CAST(count_if(flag OR (baseline BETWEEN 10 AND 19 AND chan < 8)) AS BIGINT) AS flagged, count(*) AS total FROM ({_VIS}) GROUP BY 1")
def manual_flags(spark, sf):
    return visibilities.flag_summary(visibilities.flag_where(vis(spark, sf), F.col("baseline").between(10, 19) & (F.col("chan") < 8)), ["corr"])


@query("briggs_weights", f"WITH c AS (SELECT *, CAST(round(u / 40) AS INTEGER) AS iu, CAST(round(v / 40) AS INTEGER) AS iv FROM ({_UV})), d AS (SELECT iu, iv, sum(weight) AS density FROM c GROUP BY ALL), m AS (SELECT sum(density * density) / sum(density) AS mean FROM d) SELECT iu, iv, round(sum(weight / (1 + density * pow(5 * pow(10, -0.5), 2) / mean)), 4) AS w FROM c JOIN d USING (iu, iv), m GROUP BY ALL")
def briggs_weights(spark, sf):
    d = visibilities.cells(visibilities.weighted(uv(spark, sf), 40.0, "briggs", 0.5), 40.0)
    return d.groupBy("iu", "iv").agg(F.round(F.sum("imaging_weight"), 4).alias("w"))


@query("stokes_i", f"WITH v AS (SELECT baseline, time, corr, min(re) AS re FROM ({_VIS}) WHERE corr IN (1, 2) GROUP BY ALL) SELECT baseline, time, round((max(CASE WHEN corr = 1 THEN re END) + max(CASE WHEN corr = 2 THEN re END)) / 2, 4) AS i, round((max(CASE WHEN corr = 1 THEN re END) - max(CASE WHEN corr = 2 THEN re END)) / 2, 4) AS q FROM v GROUP BY ALL")
def stokes_i(spark, sf):
    v = vis(spark, sf).groupBy("baseline", "time", "corr").agg(F.min("re").alias("re"), F.min("im").alias("im"))
    return visibilities.stokes(v, ["baseline", "time"], 1, 2).select("baseline", "time", F.round("i_re", 4).alias("i"), F.round("q_re", 4).alias("q"))


_MAIN = "SELECT l_suppkey % 10 AS field_id, CAST(l_linenumber AS INTEGER) AS scan_number, CAST(l_orderkey AS DOUBLE) AS time, l_returnflag = 'R' AS flag_row, l_suppkey AS antenna1, l_partkey % 27 AS antenna2, l_quantity AS interval FROM lineitem"


@query("scan_summary", f"SELECT field_id, scan_number, min(time) AS first_time, max(time) AS last_time, count(*) AS n_rows, round(avg(CASE WHEN flag_row THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS unflagged, count(DISTINCT (antenna1, antenna2)) AS n_baselines, round(avg(interval), 4) AS interval FROM ({_MAIN}) GROUP BY ALL")
def scan_summary(spark, sf):
    c = F.col
    d = table(spark, sf, "lineitem").select((c("l_suppkey") % 10).alias("field_id"), c("l_linenumber").cast("int").alias("scan_number"), c("l_orderkey").cast("double").alias("time"), (c("l_returnflag") == "R").alias("flag_row"), c("l_suppkey").alias("antenna1"), (c("l_partkey") % 27).alias("antenna2"), c("l_quantity").alias("interval"))
    s = visibilities.scan_summary(d, ["field_id"])
    return s.select("field_id", "scan_number", c("begin").alias("first_time"), c("end").alias("last_time"), "n_rows", F.round("unflagged", 6).alias("unflagged"), "n_baselines", F.round("interval", 4).alias("interval"))


@query("calibration_statistics", f"SELECT baseline, count(*) FILTER (NOT flag) AS npts, round(avg(sqrt(re * re + im * im)) FILTER (NOT flag), 3) AS mean, round(stddev_pop(sqrt(re * re + im * im)) FILTER (NOT flag), 3) AS sigma, round(sqrt(avg(re * re + im * im) FILTER (NOT flag)), 3) AS rms FROM ({_VIS}) GROUP BY 1")
def calibration_statistics(spark, sf):
    g = vis(spark, sf).withColumnsRenamed({"re": "g_re", "im": "g_im"})
    return visibilities.calibration_statistics(g, ["baseline"]).select("baseline", "npts", *(F.round(x, 3).alias(x) for x in ("mean", "sigma", "rms")))


@query("split_windows", "SELECT s_suppkey AS row_id, CAST(3 AS INTEGER) AS num_chan, round(1e9 + s_suppkey + 2.5, 6) AS ref_frequency, 6.0::DOUBLE AS total_bandwidth FROM supplier")
def split_windows(spark, sf):
    freq = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: 1e9 + F.col("s_suppkey") + i)
    w = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), freq.alias("chan_freq"), F.array_repeat(F.lit(1.0), 16).alias("chan_width"))
    return visibilities.split_windows(w, 2, 7, 2).select("row_id", "num_chan", F.round("ref_frequency", 6).alias("ref_frequency"), "total_bandwidth")


@query("antenna_selection", "SELECT l_orderkey, l_partkey FROM lineitem WHERE (l_suppkey IN (3, 4, 5) OR l_partkey % 27 IN (3, 4, 5)) AND l_linenumber BETWEEN 2 AND 3")
def antenna_selection(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("antenna1", F.col("l_suppkey")).withColumn("antenna2", F.col("l_partkey") % 27).withColumn("scan_number", F.col("l_linenumber"))
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("row_id"), F.col("n_name").alias("name"))
    return selection.select(d, {"antenna": names}, antenna=[(3, 5)], scan=[(2, 3)]).select("l_orderkey", "l_partkey")


# ---- images


@query("image_flux", f"SELECT z, round(CAST(sum(value) AS DOUBLE) / 22.5, 4) AS flux FROM ({_CUBE}) WHERE mask GROUP BY z")
def image_flux(spark, sf):
    return lattice.flux(cube(spark, sf), ["z"], 22.5).select("z", F.round("flux", 4).alias("flux"))


@query("image_dispersion", f"SELECT x, y, round(sqrt(greatest(sum(value * z * z) / sum(value) - (sum(value * z) / sum(value)) * (sum(value * z) / sum(value)), 0)), 5) AS moment2 FROM (SELECT x, y, CAST(z AS DOUBLE) AS z, CAST(value AS DOUBLE) AS value FROM ({_CUBE}) WHERE mask) GROUP BY x, y HAVING sum(value) <> 0")
def image_dispersion(spark, sf):
    d = cube(spark, sf).withColumn("value", F.col("value").cast("double"))
    return lattice.moments(d, ["x", "y"], F.col("z").cast("double"), 1.0).select("x", "y", F.round("moment2", 5).alias("moment2"))


@query("position_velocity", f"SELECT CAST(x // 10 AS INTEGER) AS step, z, value FROM ({_CUBE}) WHERE mask AND y = 3 AND x % 10 = 0 AND x BETWEEN 0 AND 90")
def position_velocity(spark, sf):
    return lattice.position_velocity(cube(spark, sf), (0, 3), (90, 3), 10).withColumnRenamed("offset", "step")


@query("beam_corrected", f"WITH p AS (SELECT x, y, z, value, mask, exp(-((x - 50) * (x - 50)) / 1000.0::DOUBLE) AS pb FROM ({_CUBE})) SELECT x, y, z, round(value / pb, 3) AS value FROM p WHERE mask AND pb >= 0.2")
def beam_corrected(spark, sf):
    c, x = cube(spark, sf), F.col("x").cast("double")  # the square of a large whole number would not fit in one
    beam = c.withColumn("value", F.exp(-((x - 50) * (x - 50)) / 1000.0)).withColumn("mask", F.lit(True))
    return lattice.pb_corrected(c, beam, ["x", "y", "z"]).filter("mask").select("x", "y", "z", F.round("value", 3).alias("value"))


@query("polygon_region", f"SELECT x, z, count(*) AS n FROM ({_CUBE}) WHERE x > 10.5 AND x < 40.5 AND z > 5.5 AND z < 20.5 GROUP BY ALL")
def polygon_region(spark, sf):
    inside = lattice.in_polygon("x", "z", [(10.5, 5.5), (40.5, 5.5), (40.5, 20.5), (10.5, 20.5)])
    return cube(spark, sf).filter(inside).groupBy("x", "z").agg(F.count(F.lit(1)).alias("n"))
