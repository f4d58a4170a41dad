import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanglass.operators import bandpass, polynomials, visibilities


def test_polynomials_of_any_order(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(x), float(rng.normal()), float(rng.normal()), float(rng.uniform(0, 2))) for k in range(4) for x in rng.uniform(-1, 1, 60)]
    d = spark.createDataFrame(rows, "k int, x double, y double, z double, w double").repartition(3)
    for order in (0, 1, 2, 4, 9):
        got = {r.k: r for r in polynomials.fitted(d, ["k"], F.col("x"), ["y", "z"], order, F.col("w")).collect()}
        for k in range(4):
            x, y, z, w = (np.array([r[j] for r in rows if r[0] == k]) for j in (1, 2, 3, 4))
            for v, c in ((y, got[k].c_y), (z, got[k].c_z)):
                want = np.polynomial.chebyshev.chebfit(x, v, order, w=np.sqrt(w))
                assert c == pytest.approx(want.tolist(), abs=1e-9)
    fit = polynomials.fitted(d, ["k"], F.col("x"), ["y"], 4, F.col("w"))
    at = d.join(fit, "k").select("k", "x", polynomials.evaluated(F.col("c_y"), F.col("x"), 4).alias("p"), "c_y").collect()
    assert all(r.p == pytest.approx(np.polynomial.chebyshev.chebval(r.x, r.c_y), abs=1e-12) for r in at)


def test_points_that_do_not_count_and_fits_that_fail(spark):
    nan = float("nan")
    rows = [("ok", 0.0, 1.0, 1.0), ("ok", 1.0, 2.0, 1.0), ("ok", 0.5, nan, 1.0), ("ok", 0.5, 99.0, 0.0), ("ok", 0.5, 99.0, -1.0), ("ok", None, 99.0, 1.0), ("ok", 0.5, 99.0, nan), ("few", 0.0, 1.0, 1.0), ("same", 0.5, 1.0, 1.0), ("same", 0.5, 2.0, 1.0)]
    d = spark.createDataFrame(rows, "k string, x double, y double, w double")
    got = {r.k: (r.n, r.c_y) for r in polynomials.fitted(d, ["k"], F.col("x"), ["y"], 1, F.col("w")).collect()}
    assert got["ok"] == (2, pytest.approx([1.0, 1.0])) and got["few"] == (1, None) and got["same"] == (2, None)
    fewer = {r.k: r.c_y for r in polynomials.fitted(d, ["k"], F.col("x"), ["y"], 2, F.col("w"), fewer=True).collect()}
    assert fewer["few"] == pytest.approx([1.0, 0.0, 0.0]) and fewer["ok"] == pytest.approx([1.0, 1.0, 0.0])
    left = {(r.k, r.x): r.y for r in polynomials.residuals(d, ["k"], F.col("x"), ["y"], 1, F.col("w")).collect() if r.k != "ok"}
    assert left[("few", 0.0)] == 1.0
    with pytest.raises(ValueError):
        polynomials.fitted(d, ["k"], F.col("x"), ["y"], 32)
    assert polynomials.fitted(d.filter("false"), ["k"], F.col("x"), ["y"], 1).collect() == []


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_continuum_of_any_order_goes(spark, order):
    rng = np.random.default_rng(order)
    coefficients = rng.normal(size=(2, order + 1))
    rows = []
    for b in (0, 1):
        for c in range(40):
            p = np.polynomial.polynomial.polyval(c / 39, coefficients[b])
            line = 5.0 if 15 <= c < 20 else 0.0
            rows.append((b, c, float(p + line), float(-2 * p), c == 3, 1.0 + c % 3))
    rows = [r if r[1] != 3 else (*r[:2], 1e6, 1e6, *r[4:]) for r in rows]
    d = spark.createDataFrame(rows, "baseline int, chan int, re double, im double, flag boolean, weight double")
    out = visibilities.continuum_subtracted(d, ["baseline"], ~F.col("chan").between(15, 19), order).filter("chan <> 3").collect()
    assert all(r.re == pytest.approx(5.0 if 15 <= r.chan < 20 else 0.0, abs=1e-9) and r.im == pytest.approx(0, abs=1e-9) for r in out) and len(out) == 78


def planted(antennas, channels):
    rng = np.random.default_rng(4)
    amp = 1 + 0.3 * rng.normal(size=(antennas, 1)) ** 2 + 0.2 * np.sin(np.linspace(0, 3, channels))[None, :] * rng.uniform(0.2, 1, (antennas, 1))
    phase = rng.uniform(-3, 3, (antennas, 1)) + np.linspace(0, 4, channels)[None, :] * rng.uniform(-1, 1, (antennas, 1))
    return amp * np.exp(1j * phase)


def test_bandpass_finds_planted_gains(spark):
    antennas, channels = 6, 70
    g = planted(antennas, channels)
    rng = np.random.default_rng(8)
    rows = []
    for t in range(3):
        for a in range(antennas):
            for b in range(a, antennas):
                if 5 in (a, b):
                    continue  # nothing ties the last antenna to the others
                for c in range(channels):
                    v = g[a, c] * np.conj(g[b, c]) if a != b else 100
                    bad = bool(rng.random() < 0.1) and t > 0
                    rows.append((0, c, t, a, b, float(v.real) if not bad else 1e9, float(v.imag), bad, float(rng.uniform(0.5, 2))))
    d = spark.createDataFrame(rows, "spw int, chan int, t int, antenna1 int, antenna2 int, re double, im double, flag boolean, weight double").repartition(4)
    got = bandpass.solve_bandpass(d, ["spw"], antennas, reference=2)
    want = g * np.exp(-1j * np.angle(g[2]))[None, :]
    found = got.collect()
    assert len(found) == antennas * channels
    for r in found:
        if r.antenna == 5:
            assert r.flag and (r.g_re, r.g_im) == (1, 0)
        else:
            assert not r.flag and complex(r.g_re, r.g_im) == pytest.approx(want[r.antenna, r.chan], abs=1e-6)
    corrected = visibilities.gain_corrected(d.filter("antenna1 < antenna2 AND NOT flag"), got.filter("NOT flag"), ["spw", "chan"]).collect()
    assert all(r.re == pytest.approx(1, abs=1e-5) and r.im == pytest.approx(0, abs=1e-5) for r in corrected)

    flat = bandpass.normalised(got, ["spw", "antenna"]).collect()
    for a in range(5):
        s = np.array([complex(r.g_re, r.g_im) for r in sorted(flat, key=lambda r: r.chan) if r.antenna == a])
        assert np.sqrt(np.mean(np.abs(s) ** 2)) == pytest.approx(1) and np.angle((s / np.abs(s)).sum()) == pytest.approx(0, abs=1e-9)
        assert np.abs(s) == pytest.approx(np.abs(want[a]) / np.sqrt(np.mean(np.abs(want[a]) ** 2)), abs=1e-6)


def test_polynomials_through_a_bandpass(spark):
    freq = np.linspace(1.4e9, 1.5e9, 50)
    x = np.linspace(-1, 1, 50)
    g = np.exp(0.2 + 0.1 * x - 0.3 * x**2) * np.exp(1j * (2 + 5 * x + 1.5 * x**3))
    rows = [(7, c, float(freq[c]), float(g[c].real), float(g[c].imag)) for c in range(50)] + [(8, 0, 1e9, 1.0, 0.0)]
    d = spark.createDataFrame(rows, "antenna int, chan int, freq double, g_re double, g_im double")
    fit = bandpass.bandpass_polynomials(d, ["antenna"], 3, 4)
    r = fit.filter("antenna = 7").first()
    assert (r.low, r.high) == (1.4e9, 1.5e9) and r.amplitude[0] / 2 == pytest.approx(0.2 - 0.15, abs=1e-9) and len(r.phase) == 5
    re, im = bandpass.polynomial_gain(F.col("amplitude"), F.col("phase"), F.col("freq"), F.col("low"), F.col("high"), (3, 4))
    for q in d.join(fit, "antenna").select("antenna", "chan", re.alias("re"), im.alias("im")).collect():
        want = g[q.chan] if q.antenna == 7 else 1
        assert complex(q.re, q.im) == pytest.approx(want, abs=1e-8)


def test_unwrapped_phases(spark):
    true = np.cumsum(np.random.default_rng(3).uniform(-3, 3, 40))
    wrapped = [(i, math.remainder(float(p), 2 * math.pi)) for i, p in enumerate(true)]
    d = spark.createDataFrame([(0, *r) for r in wrapped], "k int, chan int, phase double")
    got = [r.phase for r in bandpass.unwrapped(d, ["k"], "chan", "phase").orderBy("chan").collect()]
    assert np.diff(got) == pytest.approx(np.diff(true))
