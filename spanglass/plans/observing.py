"""Registered queries of whole datasets: split, summaries and uv coverage.  Orders are main rows, lines their data, nations windows and fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanglass.functions.sky import C
from spanglass.operators import joins, lattice, summaries, transform, visibilities
from spanglass.plans.catalogue import _CUBE, _VIS, cube, query, table, vis
from spanglass.sources.dataset import Dataset

_MAIN = """SELECT o_orderkey AS row_id, CAST(o_custkey % 25 AS INTEGER) AS antenna1, CAST(o_orderkey % 24 AS INTEGER) AS antenna2, CAST(o_orderkey % 25 AS INTEGER) AS data_desc_id, CAST(o_custkey % 23 AS INTEGER) AS field_id, CAST(o_custkey % 5 AS INTEGER) AS state_id,
  CAST(o_orderkey % 2 AS INTEGER) AS observation_id, 0 AS array_id, CAST(floor(o_totalprice / 40000) AS INTEGER) AS scan_number, CAST(epoch(o_orderdate) AS DOUBLE) AS time, CAST(10 + o_custkey % 3 AS DOUBLE) AS interval, o_orderstatus = 'F' AS flag_row, o_totalprice AS price FROM orders"""
_DATA = "SELECT l_orderkey AS row_id, CAST(l_linenumber AS INTEGER) AS corr, CAST(l_quantity AS INTEGER) - 1 AS chan, l_extendedprice AS re, l_discount AS im, l_returnflag = 'R' AS flag, 1.0::DOUBLE + l_tax AS weight FROM lineitem"


def observed(spark, sf) -> Dataset:
    c, i = F.col, (lambda x: x.cast("int"))
    o, n, r = (table(spark, sf, t) for t in ("orders", "nation", "region"))
    main = o.select(
        c("o_orderkey").alias("row_id"), i(c("o_custkey") % 25).alias("antenna1"), i(c("o_orderkey") % 24).alias("antenna2"), i(c("o_orderkey") % 25).alias("data_desc_id"), i(c("o_custkey") % 23).alias("field_id"), i(c("o_custkey") % 5).alias("state_id"),
        i(c("o_orderkey") % 2).alias("observation_id"), F.lit(0).alias("array_id"), i(F.floor(c("o_totalprice") / 40_000)).alias("scan_number"), F.unix_timestamp(c("o_orderdate").cast("timestamp")).cast("double").alias("time"), (10.0 + c("o_custkey") % 3).alias("interval"),
        (c("o_orderstatus") == "F").alias("flag_row"), c("o_totalprice").alias("price"), F.array(c("o_totalprice") / 100, -c("o_custkey").cast("double"), F.lit(0.0)).alias("uvw"),
    )
    data = table(spark, sf, "lineitem").select(c("l_orderkey").alias("row_id"), i(c("l_linenumber")).alias("corr"), (i(c("l_quantity")) - 1).alias("chan"), c("l_extendedprice").alias("re"), c("l_discount").alias("im"), (c("l_returnflag") == "R").alias("flag"), (1 + c("l_tax")).alias("weight"))
    key = c("n_nationkey").cast("bigint").alias("row_id")
    freq = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda k: 1e9 + c("n_nationkey") * 1e8 + k * 1e6)
    windows = n.select(key, c("n_name").alias("name"), F.lit(50).alias("num_chan"), freq.alias("chan_freq"), F.array_repeat(F.lit(-1e6), 50).alias("chan_width"), F.lit(0.0).alias("ref_frequency"), F.lit(0.0).alias("total_bandwidth"))
    links = n.select(key, i(24 - c("n_nationkey")).alias("spectral_window_id"), i(c("n_regionkey")).alias("polarization_id"))
    return Dataset({
        "main": main, "vis": data, "spectral_window": windows, "data_description": links, "field": n.select(key, c("n_name").alias("name")), "antenna": n.select(key, c("n_name").alias("name")),
        "polarization": r.select(c("r_regionkey").cast("bigint").alias("row_id"), F.lit(2).alias("num_corr"), F.array(i(c("r_regionkey")) + 5, F.lit(12)).alias("corr_type")),
        "state": r.select(c("r_regionkey").cast("bigint").alias("row_id"), F.when(c("r_regionkey") == 0, F.lit("CAL,TARGET")).otherwise(c("r_name")).alias("obs_mode")),
        "observation": r.filter("r_regionkey < 2").select(c("r_regionkey").cast("bigint").alias("row_id"), c("r_name").alias("observer")),
    })


# ---- split

_CHANNELS = {3: (5, 24), 7: (0, 49), 12: (10, 22)}
_KEPT = f"""w AS (SELECT * FROM (VALUES {", ".join(str((k, *v)) for k, v in _CHANNELS.items())}) AS v(win, a, b)), m0 AS ({_MAIN}), m1 AS (SELECT m0.*, w.* FROM m0 JOIN w ON 24 - m0.data_desc_id = win WHERE price > 50000),
  d AS ({_DATA}), whole AS (SELECT row_id, bool_and(flag) AS whole FROM d GROUP BY 1), m AS (SELECT m1.*, row_number() OVER (ORDER BY time, m1.row_id) - 1 AS new FROM m1 LEFT JOIN whole USING (row_id) WHERE NOT flag_row AND NOT coalesce(whole, false))"""


def _split(spark, sf) -> Dataset:
    return transform.split(observed(spark, sf), F.col("price") > 50_000, _CHANNELS, width=4, keep_flags=False)


@query(
    "split_data",
    f"""WITH {_KEPT} SELECT new AS row_id, corr, CAST((chan - a) // 4 AS INTEGER) AS chan, round(coalesce(avg(re) FILTER (NOT flag), avg(re)), 4) AS re, 0.0 + round(coalesce(avg(im) FILTER (NOT flag), avg(im)), 4) AS im, bool_and(flag) AS flag, round(coalesce(sum(weight) FILTER (NOT flag), sum(weight)), 4) AS weight
        FROM d JOIN m USING (row_id) WHERE chan BETWEEN a AND b GROUP BY ALL""",
)
def split_data(spark, sf):
    v = _split(spark, sf)["vis"]
    return v.select("row_id", "corr", "chan", F.round("re", 4).alias("re"), F.round("im", 4).alias("im"), "flag", F.round("weight", 4).alias("weight"))


@query("split_main", f"WITH {_KEPT}, f AS (SELECT field_id, dense_rank() OVER (ORDER BY field_id) - 1 AS nf, new FROM m), l AS (SELECT data_desc_id, dense_rank() OVER (ORDER BY data_desc_id) - 1 AS nd, new FROM m) SELECT m.new AS row_id, time, antenna1, CAST(nf AS INTEGER) AS field_id, CAST(nd AS INTEGER) AS data_desc_id FROM m JOIN f ON m.new = f.new JOIN l ON m.new = l.new")
def split_main(spark, sf):
    return _split(spark, sf).main.select("row_id", "time", "antenna1", "field_id", "data_desc_id")


@query(
    "split_windows_of_dataset",
    f"""WITH {_KEPT}, k AS (SELECT DISTINCT win, a, b FROM m), c AS (SELECT win, (i - a) // 4 AS bin, 1e9 + win * 1e8 + i * 1e6 AS freq FROM k, (SELECT unnest(range(50)) AS i) WHERE i BETWEEN a AND b),
        n AS (SELECT win, bin, avg(freq) AS freq, count(*) * 1e6 AS width FROM c GROUP BY ALL)
        SELECT dense_rank() OVER (ORDER BY win) - 1 AS row_id, CAST(count(*) AS INTEGER) AS num_chan, min(freq) AS ref_frequency, sum(width) AS total_bandwidth, max(freq) AS last FROM n GROUP BY win""",
)
def split_windows_of_dataset(spark, sf):
    return _split(spark, sf)["spectral_window"].select("row_id", "num_chan", "ref_frequency", "total_bandwidth", F.try_element_at("chan_freq", F.lit(-1)).alias("last"))


# ---- summaries


@query(
    "scan_listing",
    f"""WITH d AS ({_DATA}), s AS (SELECT row_id, avg(CASE WHEN flag THEN 0.0 ELSE 1.0 END) AS share FROM d GROUP BY 1), m AS (SELECT m.*, n_name, CASE WHEN flag_row THEN 0 ELSE coalesce(share, 1) END AS good, 24 - data_desc_id AS win FROM ({_MAIN}) AS m LEFT JOIN s USING (row_id) JOIN nation ON field_id = n_nationkey),
        i AS (SELECT observation_id, scan_number, string_agg(round(v, 6)::VARCHAR, ',' ORDER BY win) AS intervals FROM (SELECT observation_id, scan_number, win, avg(interval) AS v FROM m GROUP BY ALL) GROUP BY ALL),
        t AS (SELECT observation_id, scan_number, string_agg(DISTINCT mode, ',' ORDER BY mode) AS intents FROM (SELECT observation_id, scan_number, unnest(string_split(CASE WHEN r_regionkey = 0 THEN 'CAL,TARGET' ELSE r_name END, ',')) AS mode FROM m JOIN region ON state_id = r_regionkey) GROUP BY ALL)
        SELECT observation_id, scan_number, count(*) AS n_rows, string_agg(DISTINCT field_id::VARCHAR, ',' ORDER BY field_id::VARCHAR) AS field_ids, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS field_names, string_agg(DISTINCT win::VARCHAR, ',' ORDER BY win::VARCHAR) AS window_ids,
          min(time - interval / 2) AS start, max(time + interval / 2) AS finish, round(avg(interval), 6) AS mean_interval, round(sum(good), 4) AS unflagged, count(DISTINCT (antenna1, antenna2)) AS n_baselines, any_value(intents) AS intents, any_value(intervals) AS intervals
        FROM m JOIN i USING (observation_id, scan_number) JOIN t USING (observation_id, scan_number) GROUP BY observation_id, scan_number""",
)
def scan_listing(spark, sf):
    s = summaries.scans(observed(spark, sf))
    text = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ",").alias(c)
    intervals = F.array_join(F.transform("intervals", lambda x: F.round(x, 6).cast("string")), ",").alias("intervals")
    return s.select("observation_id", "scan_number", "n_rows", text("field_ids"), text("field_names"), text("window_ids"), F.col("begin").alias("start"), F.col("end").alias("finish"), F.round("interval", 6).alias("mean_interval"), F.round("unflagged", 4).alias("unflagged"), "n_baselines", text("intents"), intervals)


@query(
    "window_listing",
    """SELECT n_nationkey::BIGINT AS spectral_window_id, n_name AS name, 1e9 + n_nationkey * 1e8 AS first_frequency, -1e6 AS channel_width, 1e9 + n_nationkey * 1e8 + 24.5e6 AS centre_frequency, 5e7 AS bandwidth, (24 - n_nationkey)::VARCHAR AS links, 2 AS n_correlations FROM nation""",
)
def window_listing(spark, sf):
    w = summaries.windows(observed(spark, sf))
    links = F.array_join(F.transform("data_desc_ids", lambda x: x.cast("string")), ",").alias("links")
    return w.select("spectral_window_id", "name", "first_frequency", "channel_width", "centre_frequency", "bandwidth", links, F.size("correlations").alias("n_correlations"))


@query(
    "field_listing",
    f"""WITH d AS ({_DATA}), s AS (SELECT row_id, avg(CASE WHEN flag THEN 0.0 ELSE 1.0 END) AS share FROM d GROUP BY 1), m AS (SELECT field_id, CASE WHEN flag_row THEN 0 ELSE coalesce(share, 1) END AS good FROM ({_MAIN}) LEFT JOIN s USING (row_id))
        SELECT n_nationkey::BIGINT AS field_id, any_value(n_name) AS name, count(good) AS n_rows, round(coalesce(sum(good), 0), 4) AS unflagged FROM nation LEFT JOIN m ON n_nationkey = field_id GROUP BY 1""",
)
def field_listing(spark, sf):
    return summaries.fields(observed(spark, sf)).select("field_id", "name", "n_rows", F.round("unflagged", 4).alias("unflagged"))


@query("antenna_listing", f"SELECT n_nationkey::BIGINT AS antenna_id, any_value(n_name) AS name, count(row_id) AS n_rows FROM nation LEFT JOIN ({_MAIN}) AS m ON n_nationkey IN (antenna1, antenna2) GROUP BY 1")
def antenna_listing(spark, sf):
    return summaries.antennas(observed(spark, sf)).select("antenna_id", "name", "n_rows")


@query(
    "uv_coverage",
    f"""SELECT m.row_id, antenna1, antenna2, field_id, CAST(24 - data_desc_id AS INTEGER) AS spectral_window_id, 0.0 + round(s * price / 100 * f, 3) AS u, 0.0 + round(-s * o_custkey * f, 3) AS v FROM (SELECT *, (1e9 + (24 - data_desc_id) * 1e8 + 24.5e6) / {C!r} AS f FROM ({_MAIN})) AS m JOIN orders ON row_id = o_orderkey, (VALUES (1), (-1)) AS x(s) WHERE antenna1 <> antenna2 AND NOT flag_row""",
)
def uv_coverage(spark, sf):
    u = summaries.uv_coverage(observed(spark, sf), mirrored=True)
    return u.select("row_id", "antenna1", "antenna2", "field_id", "spectral_window_id", F.round("u", 3).alias("u"), F.round("v", 3).alias("v"))


# ---- gains in time, spectral flags, image reductions


@query(
    "gain_interpolation",
    """WITH l AS (SELECT event_id, user_id % 10 AS k, epoch(ts)::DOUBLE AS time FROM events), r AS (SELECT user_id % 10 AS k, floor(epoch(ts) / 600) * 600.0::DOUBLE AS time, 1 + avg(value) / 100 AS size, sum(value) AS angle, max(value) > 95 AS flag FROM events WHERE user_id % 10 < 9 GROUP BY ALL),
        g AS (SELECT k, time, size, flag, size * cos(angle) AS re, size * sin(angle) AS im FROM r),
        n AS (SELECT l.event_id, l.time, a.time AS ta, b.time AS tb, a.size AS sa, b.size AS sb, a.re AS ra, a.im AS ia, b.re AS rb, b.im AS ib, a.flag AS fa, b.flag AS fb FROM l ASOF LEFT JOIN g AS a ON l.k = a.k AND l.time >= a.time ASOF LEFT JOIN g AS b ON l.k = b.k AND l.time <= b.time),
        p AS (SELECT *, (time - ta) / (tb - ta) AS s, atan2(ib * ra - rb * ia, rb * ra + ib * ia) AS turn, coalesce(tb > ta, false) AS between_two FROM n)
        SELECT event_id, round(CASE WHEN between_two THEN (sa + s * (sb - sa)) * cos(atan2(ia, ra) + s * turn) ELSE coalesce(ra, rb) END, 6) AS g_re, round(CASE WHEN between_two THEN (sa + s * (sb - sa)) * sin(atan2(ia, ra) + s * turn) ELSE coalesce(ia, ib) END, 6) AS g_im, coalesce(CASE WHEN between_two THEN fa OR fb ELSE coalesce(fa, fb) END, true) AS flag FROM p""",
)
def gain_interpolation(spark, sf):
    c = F.col
    e = table(spark, sf, "events").select("event_id", (c("user_id") % 10).alias("k"), F.unix_micros(c("ts").cast("timestamp")).cast("double").alias("us"), "value")
    left = e.select("event_id", "k", (c("us") / 1e6).alias("time"))
    solutions = e.filter("k < 9").groupBy("k", (F.floor(c("us") / 600e6) * 600.0).alias("time")).agg((1 + F.avg("value") / 100).alias("size"), F.sum("value").alias("angle"), (F.max("value") > 95).alias("flag"))
    right = solutions.select("k", "time", (c("size") * F.cos("angle")).alias("g_re"), (c("size") * F.sin("angle")).alias("g_im"), "flag")
    out = joins.interpolated_gain(left, right, ["k"], "time")
    return out.select("event_id", F.round("g_re", 6).alias("g_re"), F.round("g_im", 6).alias("g_im"), "flag")


@query(
    "rflag_spectral",
    f"""WITH v AS (SELECT baseline, corr, chan, avg(re) AS re, avg(im) AS im, bool_and(flag) AS flag FROM ({_VIS}) GROUP BY ALL), m AS (SELECT baseline, corr, median(re) FILTER (NOT flag) AS mr, median(im) FILTER (NOT flag) AS mi FROM v GROUP BY ALL),
        d AS (SELECT v.*, CASE WHEN NOT flag THEN abs(re - mr) END AS dr, CASE WHEN NOT flag THEN abs(im - mi) END AS di FROM v JOIN m USING (baseline, corr)), s AS (SELECT baseline, corr, 1.4826 * median(dr) AS sr, 1.4826 * median(di) AS si FROM d GROUP BY ALL),
        c AS (SELECT corr, chan, avg(x) AS m FROM (SELECT corr, chan, unnest([dr, di]) AS x FROM d WHERE NOT flag) GROUP BY ALL), q AS (SELECT corr, median(m) AS mid FROM c GROUP BY 1), t AS (SELECT corr, 1.5 * (any_value(mid) + 1.4826 * median(abs(m - mid))) AS top FROM c JOIN q USING (corr) GROUP BY 1)
        SELECT corr, CAST(count_if(flag OR coalesce(sr > 60000 OR si > 60000 OR sr < 10 OR si < 10, false) OR coalesce(dr > top OR di > top, false)) AS BIGINT) AS flagged, count(*) AS total FROM d JOIN s USING (baseline, corr) JOIN t USING (corr) GROUP BY corr""",
)
def rflag_spectral(spark, sf):
    v = vis(spark, sf).groupBy("baseline", "corr", "chan").agg(F.avg("re").alias("re"), F.avg("im").alias("im"), F.bool_and("flag").alias("flag"))
    return visibilities.flag_summary(visibilities.rflag_spectral(v, ["corr"], ["baseline", "corr"], 1.5, low=10.0, high=60_000.0), ["corr"])


@query(
    "image_reductions",
    f"""WITH c AS ({_CUBE}), s AS (SELECT z, list_sort(list(value::DOUBLE)) AS v, count(*) AS n, avg(value) AS m FROM c GROUP BY z), d AS (SELECT z, avg(abs(value - m)) AS avdev FROM c JOIN s USING (z) GROUP BY z)
        SELECT s.z, n AS nelem, list_sum(v) AS sum, v[1] AS min, v[n] AS max, v[CAST(floor((n - 1) * 0.5 + 0.01) AS BIGINT) + 1] AS median, v[CAST(floor((n - 1) * 0.9 + 0.01) AS BIGINT) + 1] AS fractile, round(avdev, 3) AS avdev, (SELECT count(*) FROM c WHERE c.z = s.z AND mask) AS good FROM s JOIN d USING (z)""",
)
def image_reductions(spark, sf):
    c = cube(spark, sf)
    r = lattice.reductions(c, ["z"], 0.9).select("z", "nelem", "sum", "min", "max", "median", "fractile", F.round("avdev", 3).alias("avdev"))
    return r.join(lattice.mask_counts(c, ["z"]).select("z", F.col("ntrue").alias("good")), "z")


_LINE = [(3, 1), (60, 7)]


@query(
    "line_profile",
    f"""WITH c AS ({_CUBE}), l AS (SELECT i, 3 + i AS x, 1 + (2 * i * 6 + 57) // 114 AS y FROM (SELECT unnest(range(58)) AS i)), w AS (SELECT * FROM (VALUES (0, -1), (0, 0), (0, 1)) AS v(dx, dy))
        SELECT CAST(i AS INTEGER) AS place, z, round(avg(value), 4) AS value FROM l, w JOIN c ON c.x = l.x + dx AND c.y = l.y + dy GROUP BY i, z""",
)
def line_profile(spark, sf):
    return lattice.line_profile(cube(spark, sf), *_LINE, ["z"], width=3).select(F.col("offset").alias("place"), "z", F.round("value", 4).alias("value"))


@query(
    "regridded_nearest",
    f"""WITH c AS (SELECT x, y, sum(value) AS value, bool_and(mask) AS mask FROM ({_CUBE}) GROUP BY ALL) SELECT t.x, t.y, c.value, c.mask FROM (SELECT DISTINCT x, y FROM c) AS t JOIN c ON c.x = floor(t.x * 0.7::DOUBLE + 1.2::DOUBLE + 0.5) AND c.y = floor(t.y * 1.1::DOUBLE - 0.4::DOUBLE + 0.5)""",
)
def regridded_nearest(spark, sf):
    plane = cube(spark, sf).groupBy("x", "y").agg(F.sum("value").alias("value"), F.bool_and("mask").alias("mask"))
    return lattice.regridded(plane, plane.select("x", "y"), ("x", "y"), F.col("x") * 0.7 + 1.2, F.col("y") * 1.1 - 0.4, how="nearest")


@query(
    "regridded_linear",
    f"""WITH c AS (SELECT x, y, sum(value) AS value, bool_and(mask) AS mask FROM ({_CUBE}) GROUP BY ALL), t AS (SELECT x AS ox, y AS oy, x * 0.7::DOUBLE + 1.2 AS sx, y * 0.9::DOUBLE + 0.3 AS sy FROM c), o AS (SELECT * FROM (VALUES (0), (1)) AS a(dx), (VALUES (0), (1)) AS b(dy)),
        w AS (SELECT ox, oy, floor(sx) + dx AS x, floor(sy) + dy AS y, abs(1 - dx - (sx - floor(sx))) * abs(1 - dy - (sy - floor(sy))) AS w FROM t, o)
        SELECT ox AS x, oy AS y, round(sum(w * value), 3) AS value, bool_and(mask) AS mask FROM w JOIN c USING (x, y) WHERE w > 0 GROUP BY ox, oy HAVING sum(w) > 1 - 1e-9""",
)
def regridded_linear(spark, sf):
    plane = cube(spark, sf).groupBy("x", "y").agg(F.sum("value").alias("value"), F.bool_and("mask").alias("mask"))
    out = lattice.regridded(plane, plane.select("x", "y"), ("x", "y"), F.col("x") * 0.7 + 1.2, F.col("y") * 0.9 + 0.3)
    return out.select("x", "y", F.round("value", 3).alias("value"), "mask")
