"""Registered queries of spectral axes, frames, phase centres, sidereal time, fits, bandpasses and calibration reports, in the same register as ``catalogue``.

Spectra are the embeddings' cells, a channel each; rows in time and baselines are stood in for by the star schema.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanglass.functions import earth
from spanglass.functions import time as mjd
from spanglass.functions.sky import C
from spanglass.operators import bandpass, geometry, polynomials, spectral, statistics, visibilities
from spanglass.plans.catalogue import _VIS, query, table, vis

# ---- spectral axes

_BETA = "((20000 * 0.0145021 * cos(0.3) * cos(row * 0.01) + 20000 * -0.865863 * cos(0.3) * sin(row * 0.01) + 20000 * 0.500071 * sin(0.3)) / 299792458.0)"
_SPECTRA = f"""SELECT row, label, chan, (1.4e9 + 1e6 * chan) * f AS freq, 1e6 * f AS width, re, re * re AS im, re > 1.5 AS flag, CAST(1 + chan % 3 AS DOUBLE) AS weight
  FROM (SELECT *, sqrt((1 + {_BETA}) / (1 - {_BETA})) AS f FROM (SELECT vec_id AS row, label, unnest(range(len(embedding))) AS chan, unnest(embedding)::DOUBLE AS re FROM embeddings))"""


def spectra(spark, sf) -> DataFrame:
    """Spectra in the local standard of rest, moved to the barycentre: each row by its own direction."""
    d = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), "label", F.posexplode("embedding").alias("chan", "x"))
    re = F.col("x").cast("double")
    d = d.select("row", "label", "chan", (1.4e9 + 1e6 * F.col("chan")).alias("freq"), F.lit(1e6).alias("width"), re.alias("re"), (re * re).alias("im"), (re > 1.5).alias("flag"), (1.0 + F.col("chan") % 3).alias("weight"))
    return spectral.moved(d, earth.frame_factor("LSRK", "BARY", F.col("row") * 0.01, F.lit(0.3)))


@query(
    "spectral_overlap",
    f"""WITH s AS ({_SPECTRA}), k AS (SELECT unnest(range(30)) AS k),
        o AS (SELECT *, (least(freq + width / 2, 1.4005e9 + (k + 0.5) * 2.5e6) - greatest(freq - width / 2, 1.4005e9 + (k - 0.5) * 2.5e6)) / width AS share FROM s JOIN k ON freq + width / 2 > 1.4005e9 + (k - 0.5) * 2.5e6 AND freq - width / 2 < 1.4005e9 + (k + 0.5) * 2.5e6),
        w AS (SELECT *, CASE WHEN bool_and(flag) OVER g OR NOT flag THEN weight * share END AS w, bool_and(flag) OVER g AS all_flagged FROM o WINDOW g AS (PARTITION BY label, k))
        SELECT label, CAST(k AS INTEGER) AS chan, 0.0 + round(sum(w * re) / sum(w), 6) AS re, 0.0 + round(sum(w * im) / sum(w), 6) AS im, bool_and(all_flagged) AS flag, 0.0 + round(sum(w), 3) AS weight FROM w GROUP BY label, k""",
)
def spectral_overlap(spark, sf):
    d = spectral.on_axis(spectra(spark, sf), ["label"], 1.4005e9, 2.5e6, 30, "overlap")
    return d.select("label", "chan", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"), "flag", F.round("weight", 3).alias("weight"))


@query(
    "spectral_linear",
    f"""WITH s AS (SELECT row, (freq - 1.4e9) / 0.75e6 AS p, re, flag, lead((freq - 1.4e9) / 0.75e6) OVER g AS q, lead(re) OVER g AS re2, lead(flag) OVER g AS flag2 FROM ({_SPECTRA}) WINDOW g AS (PARTITION BY row ORDER BY chan)), k AS (SELECT unnest(range(60)) AS k)
        SELECT row, CAST(k AS INTEGER) AS chan, 0.0 + round(re + (k - p) / (q - p) * (re2 - re), 6) AS re, flag OR flag2 AS flag FROM s JOIN k ON p <= k AND k < q""",
)
def spectral_linear(spark, sf):
    d = spectral.on_axis(spectra(spark, sf), ["row"], 1.4e9, 0.75e6, 60, "linear")
    return d.select("row", "chan", F.round("re", 6).alias("re"), "flag")


@query(
    "spectral_nearest",
    f"""WITH s AS (SELECT *, floor((freq - 1.431e9) / -1.7e6 + 0.5) AS k FROM ({_SPECTRA}) WHERE NOT flag)
        SELECT label, CAST(k AS INTEGER) AS chan, 0.0 + round(sum(weight * re) / sum(weight), 6) AS re, sum(weight) AS weight FROM s WHERE k BETWEEN 0 AND 24 GROUP BY label, k""",
)
def spectral_nearest(spark, sf):
    d = spectral.on_axis(spectra(spark, sf).filter("NOT flag"), ["label"], 1.431e9, -1.7e6, 25, "nearest")
    return d.select("label", "chan", F.round("re", 6).alias("re"), "weight")


@query(
    "output_channels",
    """WITH w AS (SELECT nation.n_nationkey AS spw, c AS chan, 1e9 + n_nationkey * 1e8 + c * 2e6 * CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -1 END AS freq FROM nation, (SELECT DISTINCT p_size - 1 AS c FROM part) AS p)
       SELECT spw, CAST((chan - 2) // 4 AS INTEGER) AS chan, (min(freq) + max(freq)) / 2 AS freq, max(freq) - min(freq) + 2e6 AS width FROM w WHERE chan BETWEEN 2 AND 21 GROUP BY spw, (chan - 2) // 4""",
)
def output_channels(spark, sf):
    channels = table(spark, sf, "part").select((F.col("p_size") - 1).alias("chan")).distinct()
    turn = F.when(F.col("spw") % 2 == 0, 1).otherwise(-1)
    windows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("spw")).crossJoin(F.broadcast(channels))  # sizes 1 to 50
    windows = windows.select("spw", "chan", (1e9 + F.col("spw") * 1e8 + F.col("chan") * 2e6 * turn).alias("freq"), F.lit(-2e6).alias("width"))
    return spectral.output_channels(windows, 2, 4, 5, ["spw"])


# ---- phase centres and sidereal time

_AXES = [["-sin({r})", "cos({r})", "0.0"], ["-sin({d}) * cos({r})", "-sin({d}) * sin({r})", "cos({d})"], ["cos({d}) * cos({r})", "cos({d}) * sin({r})", "sin({d})"]]
_OLD, _NEW = ([[v.format(r=r, d=d) for v in row] for row in _AXES] for r, d in (("ra", "dec"), ("1.1", "0.35")))
_TURNED = [" + ".join(f"({' + '.join(f'({_NEW[i][k]}) * ({_OLD[j][k]})' for k in range(3))}) * {'uvw'[j]}" for j in range(3)) for i in range(3)]


@query(
    "uvw_reprojection",
    f"""WITH d AS (SELECT l_orderkey AS row, l_linenumber AS line, l_extendedprice / 10 AS u, -l_quantity * 20 AS v, l_tax * 1000 AS w, l_discount AS re, 1.4e9 + l_linenumber * 1e8 AS freq, 0.2 * n_nationkey AS ra, 0.04 * n_nationkey - 0.5 AS dec FROM lineitem JOIN nation ON l_suppkey % 25 = n_nationkey),
        n AS (SELECT *, {_TURNED[0]} AS u2, {_TURNED[1]} AS v2, {_TURNED[2]} AS w2 FROM d)
        SELECT row, line, 0.0 + round(u2, 4) AS u, 0.0 + round(v2, 4) AS v, 0.0 + round(w2, 4) AS w, 0.0 + round(w2 - w, 4) AS shift, 0.0 + round(re * cos(-2 * pi() / {C!r} * (w2 - w) * freq), 4) AS re, 0.0 + round(re * sin(-2 * pi() / {C!r} * (w2 - w) * freq), 4) AS im FROM n""",
)
def uvw_reprojection(spark, sf):
    c = F.col
    d = table(spark, sf, "lineitem").select(c("l_orderkey").alias("row"), c("l_linenumber").alias("line"), (c("l_suppkey") % 25).cast("int").alias("field_id"), (c("l_extendedprice") / 10).alias("u"), (-c("l_quantity") * 20).alias("v"), (c("l_tax") * 1000).alias("w"), c("l_discount").alias("re"), F.lit(0.0).alias("im"), (1.4e9 + c("l_linenumber") * 1e8).alias("freq"))
    fields = table(spark, sf, "nation").select(c("n_nationkey").alias("row_id"), (0.2 * c("n_nationkey")).alias("ra"), (0.04 * c("n_nationkey") - 0.5).alias("dec"))
    out = geometry.phase_shifted(geometry.reprojected(d, fields, (1.1, 0.35)))
    return out.select("row", "line", *(F.round(x, 4).alias(x) for x in ("u", "v", "w", "shift", "re", "im")))


def _turn(x: str, of: str = "360.0") -> str:
    return f"(({x}) - {of} * floor(({x}) / {of}))"


def _sidereal(m: str) -> str:
    """Greenwich apparent sidereal time in radians, in SQL."""
    t = f"(({m} - 51544.5) / 36525.0)"
    node, sun, moon = (f"radians({_turn(x)})" for x in (f"125.04452 - 1934.136261 * {t}", f"280.4665 + 36000.7698 * {t}", f"218.3165 + 481267.8813 * {t}"))
    mean = f"radians({_turn(f'280.46061837 + 360.98564736629 * ({m} - 51544.5) + {t} * {t} * (0.000387933 - {t} / 38710000.0)')})"
    nutation = f"(-17.2 * sin({node}) - 1.32 * sin(2 * {sun}) - 0.23 * sin(2 * {moon}) + 0.21 * sin(2 * {node}))"
    obliquity = f"radians(23.4392911 - 0.0130042 * {t} + (9.2 * cos({node}) + 0.57 * cos(2 * {sun}) + 0.1 * cos(2 * {moon}) - 0.09 * cos(2 * {node})) / 3600)"
    return f"({mean} + radians({nutation} / 3600) * cos({obliquity}))"


_TURN = "6.283185307179586"


@query(
    "sidereal_time",
    f"""WITH e AS (SELECT event_id, date_diff('microsecond', TIMESTAMP '1858-11-17', ts) / 86400e6 AS m, user_id * 0.01 AS lon FROM events),
        s AS (SELECT *, {_sidereal("m")} AS g FROM e), l AS (SELECT *, {_turn("g + lon", _TURN)} AS last FROM s)
        SELECT event_id, 0.0 + round(last * (43200 / pi()), 2) AS seconds, 0.0 + round({_turn("last - event_id % 600 / 100.0 + pi()", _TURN)} - pi(), 6) AS hour_angle FROM l""",
)
def sidereal_time(spark, sf):
    m, lon = mjd.mjd_of(F.col("ts")), F.col("user_id") * 0.01
    return table(spark, sf, "events").select("event_id", F.round(earth.sidereal_seconds(m, lon), 2).alias("seconds"), F.round(earth.hour_angle(m, lon, F.col("event_id") % 600 / 100.0), 6).alias("hour_angle"))


@query(
    "rise_and_set",
    f"""WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1858-11-17', CAST(o_orderdate AS DATE))::DOUBLE AS m, o_custkey % 100 / 50.0 AS lon, o_orderkey % 29 / 10.0 - 1.4 AS lat, o_custkey % 628 / 100.0 AS ra, o_orderkey % 313 / 100.0 - 1.56 AS d FROM orders),
        h AS (SELECT *, (sin(-0.014538592669112763) - sin(lat) * sin(d)) / (cos(lat) * cos(d)) AS low, {_turn(f"{_sidereal('m')} + lon", _TURN)} AS last FROM o),
        a AS (SELECT *, {_turn("ra - acos(greatest(-1.0, least(1.0, low))) - last", _TURN)} / ({_TURN} * 1.00273790935) AS r, {_turn("ra + acos(greatest(-1.0, least(1.0, low))) - last", _TURN)} / ({_TURN} * 1.00273790935) AS f FROM h)
        SELECT o_orderkey, low <= -1 AS never_sets, low >= 1 AS never_rises, CASE WHEN low <= -1 THEN 86400 WHEN low >= 1 THEN 0 ELSE CAST(round(r * 86400) AS BIGINT) END AS rise,
          CASE WHEN low <= -1 THEN 0 WHEN low >= 1 THEN 86400 ELSE CAST(round((f + CASE WHEN f < r THEN 1 / 1.00273790935 ELSE 0 END) * 86400) AS BIGINT) END AS set FROM a""",
)
def rise_and_set(spark, sf):
    c = F.col
    o = table(spark, sf, "orders").select("o_orderkey", F.floor(mjd.mjd_of(c("o_orderdate"))).cast("double").alias("m"), (c("o_custkey") % 100 / 50.0).alias("lon"), (c("o_orderkey") % 29 / 10.0 - 1.4).alias("lat"), (c("o_custkey") % 628 / 100.0).alias("ra"), (c("o_orderkey") % 313 / 100.0 - 1.56).alias("d"))
    rise, fall = earth.rise_and_set_in_day(c("m"), c("lon"), c("lat"), c("ra"), c("d"), math.radians(-0.833))
    seconds = lambda t: F.round(c(t) * 86_400).cast("bigint")
    d = o.withColumn("__r", rise).withColumn("__s", fall)
    always, never = (c("__r") == 1) & (c("__s") == 0), (c("__r") == 0) & (c("__s") == 1)
    return d.select("o_orderkey", always.alias("never_sets"), never.alias("never_rises"), seconds("__r").alias("rise"), seconds("__s").alias("set"))


# ---- fits


def _orthogonal(order: int) -> str:
    """Weighted polynomial fits in SQL by orthogonal polynomials, each from the two before; rows without weight are where the fit is wanted."""
    ctes = ["p0 AS (SELECT *, 1.0::DOUBLE AS q0, 0.0::DOUBLE AS qm FROM d)", "f0 AS (SELECT *, sum(w * y) OVER g / sum(w) OVER g AS fit, sum(w) OVER g AS n0 FROM p0 WINDOW g AS (PARTITION BY baseline, corr))"]
    for k in range(1, order + 1):
        b = f"n{k - 1} / n{k - 2} * q{k - 2}" if k > 1 else "0"
        ctes.append(f"p{k} AS (SELECT *, (x - sum(w * x * q{k - 1} * q{k - 1}) OVER g / n{k - 1}) * q{k - 1} - {b} AS q{k} FROM f{k - 1} WINDOW g AS (PARTITION BY baseline, corr))")
        ctes.append(f"f{k} AS (SELECT * REPLACE (fit + q{k} * sum(w * y * q{k}) OVER g / sum(w * q{k} * q{k}) OVER g AS fit), sum(w * q{k} * q{k}) OVER g AS n{k} FROM p{k} WINDOW g AS (PARTITION BY baseline, corr))")
    return f"""WITH v AS (SELECT baseline, corr, 2.0 * chan / 49 - 1 AS x, re AS y, weight AS w, NULL::INTEGER AS chan FROM ({_VIS}) WHERE NOT flag),
        d AS (FROM v UNION ALL BY NAME SELECT baseline, corr, 2.0 * chan / 49 - 1 AS x, 0.0 AS y, 0.0 AS w, chan FROM (SELECT DISTINCT baseline, corr FROM v), (VALUES (0), (24), (49)) AS c(chan)), {", ".join(ctes)}
        SELECT baseline, corr, chan, {order} AS degree, 0.0 + round(fit, 3) AS fit FROM f{order} WHERE chan IS NOT NULL"""


@query("polynomial_fits", " UNION ALL ".join(f"(FROM ({_orthogonal(k)}))" for k in (1, 2, 4)))
def polynomial_fits(spark, sf):
    v = vis(spark, sf).filter("NOT flag")
    x, parts = polynomials.scaled(F.col("chan"), 0.0, 49.0), []
    for order in (1, 2, 4):
        at = polynomials.fitted(v, ["baseline", "corr"], x, ["re"], order, F.col("weight")).withColumn("chan", F.explode(F.array(F.lit(0), F.lit(24), F.lit(49))))
        parts.append(at.select("baseline", "corr", "chan", F.lit(order).alias("degree"), F.round(polynomials.evaluated(F.col("c_re"), x, order), 3).alias("fit")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "continuum_line",
    f"""WITH v AS (SELECT baseline, corr, chan, avg(re) AS re, bool_and(flag) AS flag, max(weight) AS weight FROM ({_VIS}) GROUP BY ALL), w AS (SELECT *, CASE WHEN (chan < 20 OR chan > 30) AND NOT flag THEN weight ELSE 0 END AS w FROM v),
        m AS (SELECT *, sum(w * chan) OVER g / sum(w) OVER g AS xm, sum(w * re) OVER g / sum(w) OVER g AS ym FROM w WINDOW g AS (PARTITION BY baseline, corr))
        SELECT baseline, corr, chan, 0.0 + round(re - ym - (chan - xm) * sum(w * (chan - xm) * (re - ym)) OVER g / sum(w * (chan - xm) * (chan - xm)) OVER g, 3) AS re FROM m WINDOW g AS (PARTITION BY baseline, corr)""",
)
def continuum_line(spark, sf):
    v = vis(spark, sf).groupBy("baseline", "corr", "chan").agg(F.avg("re").alias("re"), F.avg("im").alias("im"), F.bool_and("flag").alias("flag"), F.max("weight").alias("weight"))
    d = visibilities.continuum_subtracted(v, ["baseline", "corr"], (F.col("chan") < 20) | (F.col("chan") > 30), order=1)
    return d.select("baseline", "corr", "chan", F.round("re", 3).alias("re"))


# ---- bandpasses

_SIZE, _ANGLE = "(1 + 0.05 * {a} + 0.003 * chan)", "(0.3 * {a} + 0.002 * chan * ({a} - 2) + 0.1 * corr * {a})"


def _gain(a: str):
    """The gain that visibilities are made with: (amplitude, phase) of an antenna at (chan, corr)."""
    return F.expr(_SIZE.format(a=a)), F.expr(_ANGLE.format(a=a))


@query(
    "bandpass_solution",
    f"""WITH k AS (SELECT DISTINCT l_linenumber % 2 AS corr, CAST(l_quantity AS INTEGER) - 1 AS chan FROM lineitem WHERE l_returnflag <> 'R'), a AS (SELECT unnest(range(6)) AS antenna),
        g AS (SELECT corr, chan, antenna, {_SIZE.format(a="antenna")} AS size, {_ANGLE.format(a="antenna")} - {_ANGLE.format(a="0")} AS angle FROM k, a),
        n AS (SELECT *, sqrt(avg(size * size) OVER w) AS rms, atan2(sum(sin(angle)) OVER w, sum(cos(angle)) OVER w) AS mean FROM g WINDOW w AS (PARTITION BY corr, antenna))
        SELECT CAST(corr AS INTEGER) AS corr, chan, CAST(antenna AS INTEGER) AS antenna, 0.0 + round(size / rms * cos(angle - mean), 4) AS re, 0.0 + round(size / rms * sin(angle - mean), 4) AS im, false AS flag FROM n""",
)
def bandpass_solution(spark, sf):
    """Solved from visibilities of every baseline, time and weight in the table, with wild values where they are flagged."""
    c = F.col
    d = table(spark, sf, "lineitem").select((c("l_linenumber") % 2).alias("corr"), (c("l_quantity").cast("int") - 1).alias("chan"), (c("l_suppkey") % 6).cast("int").alias("antenna1"), (c("l_partkey") % 6).cast("int").alias("antenna2"), (1 + c("l_tax") * 100).alias("weight"), (c("l_returnflag") == "R").alias("flag"), "l_extendedprice")
    (s1, p1), (s2, p2) = _gain("antenna1"), _gain("antenna2")
    wild = F.when(c("flag"), c("l_extendedprice")).otherwise(0.0)
    d = d.withColumn("re", s1 * s2 * F.cos(p1 - p2) + wild).withColumn("im", s1 * s2 * F.sin(p1 - p2))
    flat = bandpass.normalised(bandpass.solve_bandpass(d, ["corr"], 6), ["corr", "antenna"])
    return flat.select("corr", "chan", "antenna", F.round("g_re", 4).alias("re"), F.round("g_im", 4).alias("im"), "flag")


# ---- reports


_STATS = ["npts", "flagged_npts", "total_npts", "round(sum, 3) AS sum", "round(sumsq, 1) AS sumsq", "min", "max", "round(mean, 4) AS mean", "median", "medabsdevmed", "q1", "q3", "q3 - q1 AS quartile", "round(var, 2) AS var", "round(stddev, 4) AS stddev", "round(rms, 4) AS rms"]
_MIDDLE = "avg(v) FILTER (r IN (({n} + 1) // 2, ({n} + 2) // 2))"


@query(
    "calibration_report",
    f"""WITH d AS (SELECT l_extendedprice AS v, l_returnflag = 'R' AS flag, l_linenumber AS field, l_quantity::BIGINT % 4 AS spw, l_suppkey AS antenna, year(l_shipdate) AS observation FROM lineitem),
        e AS (SELECT v, flag, 'all' AS grouping, NULL::BIGINT AS key FROM d UNION ALL SELECT v, flag, 'field', field FROM d UNION ALL SELECT v, flag, 'spw', spw FROM d UNION ALL SELECT v, flag, 'antenna', antenna FROM d UNION ALL SELECT v, flag, 'observation', observation FROM d),
        t AS (SELECT grouping, key, count(*) AS total_npts, CAST(count_if(flag) AS BIGINT) AS flagged_npts FROM e GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY grouping, key ORDER BY v) AS r, count(*) OVER (PARTITION BY grouping, key) AS n FROM e WHERE NOT flag),
        s AS (SELECT grouping, key, count(*) AS npts, sum(v) AS sum, sum(v * v) AS sumsq, min(v) AS min, max(v) AS max, avg(v) AS mean, var_pop(v) AS var, stddev_pop(v) AS stddev, sqrt(avg(v * v)) AS rms, {_MIDDLE.format(n="n")} AS median,
                {_MIDDLE.format(n="(n // 2)")} AS q1, avg(v) FILTER (r - (n - n // 2) IN ((n // 2 + 1) // 2, (n // 2 + 2) // 2)) AS q3 FROM o GROUP BY ALL),
        m AS (SELECT o.grouping, o.key, median(abs(v - median)) AS medabsdevmed FROM o JOIN s ON o.grouping = s.grouping AND o.key IS NOT DISTINCT FROM s.key GROUP BY ALL)
        SELECT s.grouping, s.key, {", ".join(_STATS)} FROM s JOIN t ON s.grouping = t.grouping AND s.key IS NOT DISTINCT FROM t.key JOIN m ON s.grouping = m.grouping AND s.key IS NOT DISTINCT FROM m.key""",
)
def calibration_report(spark, sf):
    c = F.col
    d = table(spark, sf, "lineitem").select(c("l_extendedprice").alias("v"), (c("l_returnflag") == "R").alias("flag"), c("l_linenumber").alias("field"), (c("l_quantity").cast("bigint") % 4).alias("spw"), c("l_suppkey").alias("antenna"), F.year("l_shipdate").alias("observation"))
    r = statistics.calibration_report(d, c("v"), {k: k for k in ("field", "spw", "antenna", "observation")})
    return r.selectExpr("grouping", "key", *_STATS)
