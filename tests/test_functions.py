import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanglass.functions import aggregates as ag
from spanglass.functions import arrays, logic, sky
from spanglass.functions import complex as cx
from spanglass.functions import time as mjd


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def lit(v, kind="boolean"):
    return F.lit(v).cast(kind)


def test_logic_with_nulls(spark):
    t, f, n = lit(True), lit(False), lit(None)
    assert one(spark, logic.all_of(t, f), logic.all_of(f, n), logic.any_of(t, n), logic.any_of(f, t)) == (False, None, None, True)
    x = F.lit(5)
    assert one(spark, logic.is_in(x, [1, None]), logic.not_in(x, [1, None]), logic.is_in(lit(None, "int"), [1])) == (False, True, None)
    assert one(spark, logic.iif(n, F.lit(1), F.lit(2)), logic.like(F.lit("a\\b"), "a\\_"), logic.glob(F.lit("SRC_01"), "SRC*1")) == (2, True, True)


def test_arithmetic(spark):
    d = lambda v: F.lit(float(v))
    assert one(spark, logic.divide_int(F.lit(-7), F.lit(2)), F.lit(-7) % F.lit(3)) == (-3, -1)
    got = one(spark, logic.divide(d(1), d(0)), logic.divide(d(-1), d(0)), logic.divide(d(0), d(0)), logic.divide(d(3), d(2)), logic.log(d(0)), logic.log(d(-1)))
    assert got[:2] == (math.inf, -math.inf) and math.isnan(got[2]) and got[3] == 1.5 and got[4] == -math.inf and math.isnan(got[5])
    assert one(spark, logic.sign(d(0.0)), logic.sign(d(-2.0)), logic.near(d(0), d(0)), logic.near(d(1), d(1 + 1e-14)), logic.equals(d("nan"), d("nan"))) == (1.0, -1.0, True, True, False)


def test_text(spark):
    assert one(spark, logic.byte_length(F.lit("né")), logic.substring(F.lit("abcdef"), 2, 3), logic.trim(F.lit("  a b\t")), logic.capitalize(F.lit("hello wORLD"))) == (3, "cde", "a b", "Hello WORLD")


@pytest.mark.parametrize(("value", "wanted"), [(10, True), (14, True), (13, False), (40, True), (41, False), (100, True), (3, False)])
def test_in_ranges(spark, value, wanted):
    assert one(spark, logic.in_ranges(F.lit(value), (10, 40, 2), (100, None))) == (wanted,)


def test_dates(spark):
    t = F.lit(51544.75)
    assert one(spark, mjd.year(t), mjd.month(t), mjd.day(t), mjd.weekday(t), mjd.week(t), mjd.date_text(t), mjd.time_text(t)) == (2000, 1, 1, 5, 1, "2000/01/01", "18:00:00.000")
    assert one(spark, mjd.mjd_of(F.lit("2000-01-01 18:00:00").cast("timestamp_ntz")))[0] == 51544.75
    assert one(spark, mjd.tai_of_utc(t, [(41317.0, 10), (51179.0, 32)]))[0] == pytest.approx(51544.75 + 32 / 86400, abs=1e-12)


def test_sky(spark):
    a = lambda v: F.lit(math.radians(v))
    got = one(spark, sky.distance(a(0), a(0), a(90), a(0)), sky.normalised(a(270)), *sky.galactic(a(192.85948), a(27.12825)), sky.hms(a(45)), sky.dms(a(-12.5)))
    assert got[0] == pytest.approx(math.pi / 2) and got[1] == pytest.approx(-math.pi / 2) and got[3] == pytest.approx(math.pi / 2, abs=1e-5)
    assert got[4:] == ("03h00m00.000", "-012.30.00.000")
    lon, lat = one(spark, *sky.rotated(*sky.galactic(a(33), a(-21)), sky.GALACTIC, inverse=True))
    assert (math.degrees(lon), math.degrees(lat)) == (pytest.approx(33), pytest.approx(-21))
    z = F.lit(0.5)
    back = sky.doppler(sky.doppler(sky.doppler(z, "z", "beta"), "beta", "radio"), "radio", "z")
    assert one(spark, back)[0] == pytest.approx(0.5)
    assert one(spark, *sky.itrf(a(0), a(0), F.lit(10.0))) == (pytest.approx(6378147.0), 0.0, 0.0)


def test_complex(spark):
    z, w = cx.of(F.lit(3.0), F.lit(-4.0)), cx.of(F.lit(1.0), F.lit(2.0))
    q, t, m, n, zero = one(spark, cx.over(z, w), cx.times(z, cx.conj(w)), cx.modulus(z), cx.norm(z), cx.over(z, cx.of(F.lit(0), F.lit(0))))
    want = complex(3, -4) / complex(1, 2)
    assert (q.re, q.im) == (pytest.approx(want.real), pytest.approx(want.imag)) and (t.re, t.im) == (-5.0, -10.0) and (m, n, zero) == (5.0, 25.0, None)


def test_arrays_against_numpy(spark):
    x = np.random.default_rng(1).normal(size=11)
    a = F.array(*(F.lit(float(v)) for v in x))
    got = one(spark, arrays.total(a), arrays.variance(a), arrays.variance(a, True), arrays.rms(a), arrays.median(a), arrays.fractile(a, 0.3), arrays.avdev(a))
    want = x.sum(), x.var(), x.var(ddof=1), math.sqrt((x * x).mean()), np.median(x), np.sort(x)[3], np.abs(x - x.mean()).mean()
    assert got == pytest.approx(want)
    run = one(spark, arrays.running(a, 2, "median"), arrays.boxed(a, 3, "stddev"))
    assert run[0] == pytest.approx([np.median(x[max(0, i - 2) : i + 3]) for i in range(11)])
    assert run[1] == pytest.approx([x[max(0, i - 1) : i + 2].std() for i in range(11)])
    e = F.array().cast("array<double>")
    assert one(spark, arrays.mean(e), arrays.median(e), arrays.running(e, 1, "sum"), arrays.total(e)) == (None, None, [], 0.0)


def test_column_major_cells(spark):
    m = np.arange(6).reshape(2, 3, order="F")  # [row, column], first index fastest
    a = F.array(*(F.lit(int(v)) for v in m.flatten(order="F")))
    got = one(spark, arrays.element(a, [1, 2], [2, 3]), arrays.element(a, [-1, -1], [2, 3]), arrays.section(a, [(1, 2), (2, 3)], [2, 3]), arrays.over_axis(a, 1, [2, 3], "sum"), arrays.over_axis(a, 2, [2, 3], "sum"), arrays.transpose(a, 2, 3), arrays.diagonal(a, 2, 3), arrays.resized(a, 8))
    assert got[0] == 2 and got[1] == 5 and got[2] == [2, 3, 4, 5] and got[3] == m.sum(axis=0).tolist() and got[4] == m.sum(axis=1).tolist()
    assert got[5] == m.T.flatten(order="F").tolist() and got[6] == [0, 3] and got[7] == [0, 1, 2, 3, 4, 5, 0, 0]


def test_aggregates(spark):
    d = spark.createDataFrame([(0, None, True), (1, 3.0, None), (2, 1.0, False), (3, 2.0, True)], "r long, x double, b boolean")
    x, r, b = F.col("x"), F.col("r"), F.col("b")
    row = d.agg(ag.count(x), ag.total(x), ag.first(x, r), ag.last(x, r), ag.of_first_row(x, r), ag.product(x), ag.values(x, r), ag.any_true(b), ag.all_true(b), ag.median(x), ag.histogram(x, 2, 1.0, 3.0)).first()
    assert tuple(row) == (4, 6.0, 3.0, 2.0, None, 6.0, [None, 3.0, 1.0, 2.0], True, False, 2.0, [1, 2])
    none = d.filter("r > 9").agg(ag.total(x), ag.any_true(b), ag.all_true(b), ag.mean(x)).first()
    assert tuple(none) == (0.0, False, True, None)
