import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanglass.functions import earth
from spanglass.operators import geometry, spectral
from spanglass.plans import catalogue, instruments  # noqa: F401 (adds its queries to the register)


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


# ---- sidereal time, rise and set


def test_sidereal_time_against_worked_examples(spark):
    day = F.lit(46_895.0)  # 1987 April 10, 0h UT
    r = one(spark, mean=earth.mean_sidereal(day) * (43_200 / math.pi), apparent=earth.sidereal_seconds(day), later=earth.mean_sidereal(F.lit(46_895.0 + 69_660 / 86_400)) * (43_200 / math.pi), noon=earth.mean_sidereal(F.lit(51_544.5)) * 12 / math.pi)
    assert r.mean == pytest.approx(13 * 3600 + 10 * 60 + 46.3668, abs=2e-3)
    assert r.apparent == pytest.approx(13 * 3600 + 10 * 60 + 46.1351, abs=0.01)
    assert r.later == pytest.approx(8 * 3600 + 34 * 60 + 57.0896, abs=2e-3)
    assert r.noon == pytest.approx(18.697374558, abs=1e-7)
    east = one(spark, a=earth.sidereal_seconds(day, math.pi / 2), b=earth.hour_angle(day, 0.0, F.lit(0.0)))
    assert (east.a - r.apparent) % 86_400 == pytest.approx(21_600) and -math.pi <= east.b < math.pi


def test_azimuth_and_elevation(spark):
    # Venus from Washington, 1987 April 10, 19:21:00 UT; azimuth is counted from north here.
    lon, lat = -math.radians(77 + 3 / 60 + 56 / 3600), math.radians(38 + 55 / 60 + 17 / 3600)
    az, el = earth.azimuth_elevation(F.lit(46_895.0 + 69_660 / 86_400), lon, F.lit(lat), F.lit(math.radians(347.3193375)), F.lit(math.radians(-6.719891667)))
    r = one(spark, az=az, el=el)
    assert math.degrees(r.az) == pytest.approx(180 + 68.0337, abs=2e-3) and math.degrees(r.el) == pytest.approx(15.1249, abs=2e-3)


def test_rise_and_set(spark):
    lat, lon = math.radians(34.0), math.radians(-107.6)
    cases = [(58_849.3, 1.0, 0.3), (58_849.9, 4.0, -0.7), (60_000.0, 6.2, 0.0), (60_000.5, 0.1, 1.3), (60_000.5, 0.1, -1.3), (60_000.5, 0.1, math.pi / 2)]
    d = spark.createDataFrame(cases, "mjd double, ra double, dec double")
    for horizon in (0.0, math.radians(-0.833)):
        rise, fall = earth.rise_and_set(F.col("mjd"), lon, F.lit(lat), F.col("ra"), F.col("dec"), horizon)
        up = lambda t: earth.azimuth_elevation(t, lon, F.lit(lat), F.col("ra"), F.col("dec"))[1]
        rows = d.withColumn("rise", rise).withColumn("fall", fall).select("*", up(F.col("rise")).alias("a"), up(F.col("fall")).alias("b"), up((F.col("rise") + F.col("fall")) / 2).alias("m"), up(F.col("rise") - 0.01).alias("before")).collect()
        for r in rows[:3]:
            day = math.floor(r.mjd)
            assert day <= r.rise < day + 1 and r.rise < r.fall < r.rise + 1
            assert r.a == pytest.approx(horizon, abs=1e-6) and r.b == pytest.approx(horizon, abs=1e-6) and r.m > horizon > r.before
        assert [(r.rise - 60_000, r.fall - 60_000) for r in rows[3:]] == [(1, 0), (0, 1), (1, 0)]


def test_rise_and_set_round_times_of_the_day_and_not_dates(spark, tmp_path):
    """An order whose star sets 81014.50000003 s after midnight: as a date in days that is told to a microsecond only."""
    d = spark.sql("SELECT 456584L AS o_orderkey, 48632L AS o_custkey, TIMESTAMP '1998-04-08' AS o_orderdate")
    d.write.parquet(f"{tmp_path}/orders.parquet")
    sql = catalogue.ORACLE["rise_and_set"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = catalogue.QUERIES["rise_and_set"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == duckdb.connect().sql(sql).fetchall() == [(456584, False, False, 55610, 81015)]


# ---- frames


def test_earth_velocity_against_a_published_value(spark):
    v = earth.earth_velocity(F.lit(53_411.52501161 - 0.5 + 0.5))
    r = one(spark, x=v[0], y=v[1], z=v[2])
    unit = 149_597_870_700 / 86_400
    want = [-0.1091874268116823e-1 * unit, -0.1246525461732862e-1 * unit, -0.5404773180966231e-2 * unit]
    assert [r.x, r.y, r.z] == pytest.approx(want, abs=12)


def test_frames_lead_back_and_along_any_way(spark):
    ra, dec, mjd = F.lit(1.2), F.lit(-0.4), F.lit(58_000.25)
    more = {"mjd": mjd, "site": (F.lit(-1.9), F.lit(0.59), F.lit(6.37e6)), "velocity": F.lit(2.5e4)}
    frames = ["REST", "LSRK", "LSRD", "GALACTO", "LGROUP", "CMB", "BARY", "GEO", "TOPO"]
    names = {f"{a}_{b}": earth.frame_factor(a, b, ra, dec, **more) for a in frames for b in frames}
    r = one(spark, **names)
    for a in frames:
        assert r[f"{a}_{a}"] == 1.0
        for b in frames:
            assert r[f"{a}_{b}"] * r[f"{b}_{a}"] == pytest.approx(1, abs=1e-14)
            for c in frames:
                assert r[f"{a}_{b}"] * r[f"{b}_{c}"] == pytest.approx(r[f"{a}_{c}"], abs=1e-13)
    beta = (20_000 * (0.0145021 * math.cos(-0.4) * math.cos(1.2) - 0.865863 * math.cos(-0.4) * math.sin(1.2) + 0.500071 * math.sin(-0.4))) / 299_792_458
    assert r.LSRK_BARY == pytest.approx(math.sqrt((1 + beta) / (1 - beta)), abs=1e-15)
    assert r.REST_LSRK < 1 < r.LSRK_REST and abs(r.GEO_TOPO - 1) < 2e-6 and abs(r.BARY_GEO - 1) < 1.1e-4
    for bad in (("LSRK", "XX", {}), ("BARY", "GEO", {}), ("GEO", "TOPO", {"mjd": mjd}), ("REST", "BARY", {})):
        with pytest.raises(ValueError):
            earth.frame_factor(bad[0], bad[1], ra, dec, **bad[2])


# ---- output channels and axes


def test_output_channels(spark):
    w = spark.createDataFrame([(s, c, s * 100 + 10.0 + c * (1 if s else -1), -1.0) for s in (0, 1) for c in range(8)], "spw int, chan int, freq double, width double")
    got = {(r.spw, r.chan): (r.freq, r.width) for r in spectral.output_channels(w, 1, 3, 2, ["spw"]).collect()}
    assert got == {(0, 0): (8.0, 3.0), (0, 1): (5.0, 3.0), (1, 0): (112.0, 3.0), (1, 1): (115.0, 3.0)}
    down = {r.chan: r.freq for r in spectral.output_channels(w.filter("spw = 1"), 6, -2, 3).collect()}
    assert down == {0: 115.5, 1: 113.5, 2: 111.5}
    for bad in ((6, 3, 1), (0, 3, 3), (0, 0, 1), (0, 1, 0)):
        with pytest.raises(ValueError):
            spectral.output_channels(w, *bad, ["spw"])


def spectra(rng, rows, step):
    """Random spectra: rows, channels at uneven places, in rising or falling order."""
    out = []
    for r in range(rows):
        n = int(rng.integers(1, 12))
        f = np.cumsum(rng.uniform(0.4, 2.0, n)) + rng.uniform(-4, 3)
        f = f[::-1] if r % 2 else f
        for c in range(n):
            out.append((r, c, float(f[c]), float(rng.uniform(0.2, 3)), float(rng.normal()), float(rng.normal()), bool(rng.random() < 0.3), float(rng.uniform(0.5, 2))))
    return out


@pytest.mark.parametrize("step", [1.0, -0.7, 2.5])
@pytest.mark.parametrize("how", spectral.MODES)
def test_axis_against_plain_loops(spark, how, step):
    rng = np.random.default_rng(abs(int(step * 10)))
    rows, first, n = spectra(rng, 25, step), 2.0 if step > 0 else 9.0, 9
    d = spark.createDataFrame(rows, "row int, chan int, freq double, width double, re double, im double, flag boolean, weight double").repartition(3)
    got = {(r.row, r.chan): r for r in spectral.on_axis(d, ["row"], first, step, n, how).collect()}
    want = {}
    for row in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == row), key=lambda r: (r[2] - first) / step)
        p = [(r[2] - first) / step for r in mine]
        for k in range(n):
            centre = first + k * step
            if how in ("overlap", "nearest"):
                shares = []
                for r in mine:
                    low, high = max(r[2] - r[3] / 2, centre - abs(step) / 2), min(r[2] + r[3] / 2, centre + abs(step) / 2)
                    shares.append(max(0.0, high - low) / r[3] if how == "overlap" else float(math.floor((r[2] - first) / step + 0.5) == k))
                hit = [(r, s) for r, s in zip(mine, shares, strict=True) if s > 1e-12]
                use = [(r, s) for r, s in hit if not r[6]] or hit
                if use:
                    w = sum(r[7] * s for r, s in use)
                    want[row, k] = (sum(r[4] * r[7] * s for r, s in use) / w, sum(r[5] * r[7] * s for r, s in use) / w, all(r[6] for r, _ in hit), w)
                continue
            if len(mine) == 1:
                if abs(mine[0][2] - centre) <= mine[0][3] / 2:
                    want[row, k] = (mine[0][4], mine[0][5], mine[0][6], mine[0][7])
                continue
            gap = next((i for i in range(len(p) - 1) if p[i] <= k < p[i + 1]), None)
            if gap is None:
                continue
            t = (k - p[gap]) / (p[gap + 1] - p[gap])
            line = [(1 - t) * mine[gap][j] + t * mine[gap + 1][j] for j in (4, 5, 7)]
            if how == "cubic" and 0 < gap < len(p) - 2:
                at = range(gap - 1, gap + 3)
                for j, c in ((0, 4), (1, 5)):
                    line[j] = sum(mine[i][c] * math.prod((k - p[m]) / (p[i] - p[m]) for m in at if m != i) for i in at)
                want[row, k] = (*line[:2], any(mine[i][6] for i in at), line[2])
            else:
                want[row, k] = (*line[:2], mine[gap][6] or mine[gap + 1][6], line[2])
    assert set(got) == set(want) and want
    for key, (re, im, flag, weight) in want.items():
        r = got[key]
        assert (r.re, r.im, r.weight) == pytest.approx((re, im, weight), abs=1e-9) and r.flag == flag, key


def test_channels_on_the_axis_stay_as_they_are(spark):
    d = spark.createDataFrame([(0, c, 10.0 + c, 1.0, float(c * c), 1.0, c == 3, 2.0) for c in range(6)], "row int, chan int, freq double, width double, re double, im double, flag boolean, weight double")
    for how in spectral.MODES:
        got = sorted((r.chan, r.re, r.im, r.flag, r.weight) for r in spectral.on_axis(d, ["row"], 10.0, 1.0, 6, how).collect())
        assert got == [(c, float(c * c), 1.0, c == 3, 2.0) for c in range(6)]
    moved = spectral.moved(d, F.lit(2.0)).filter("chan = 1").first()
    assert (moved.freq, moved.width) == (22.0, 2.0)
    assert spectral.on_axis(d.filter("false"), ["row"], 0.0, 1.0, 3).collect() == []
    for bad in ((0.0, 3, "linear"), (1.0, 0, "linear"), (1.0, 3, "best")):
        with pytest.raises(ValueError):
            spectral.on_axis(d, ["row"], 0.0, *bad)


# ---- phase centres


def test_turned_there_and_back(spark):
    fields = spark.createDataFrame([(0, 1.0, 0.5), (1, 1.3, -0.2)], "row_id int, ra double, dec double")
    rows = spark.createDataFrame([(i, i % 3, 10.0 * i, 5.0 - i, 1.0 * i, 1.0, 2.0, 1.4e9) for i in range(9)], "id int, field_id int, u double, v double, w double, re double, im double, freq double")
    there = geometry.reprojected(rows, fields, (1.1, 0.4))
    assert there.columns == ["id", "field_id", "re", "im", "freq", "u", "v", "w", "shift"]
    turned = geometry.phase_shifted(there)
    to = spark.createDataFrame([(0, 1.1, 0.4), (1, 1.1, 0.4)], "row_id int, ra double, dec double")
    for k in (0, 1):
        ra, dec = ((1.0, 0.5), (1.3, -0.2))[k]
        back = geometry.phase_shifted(geometry.reprojected(turned.filter(f"field_id = {k}").drop("shift"), to, (ra, dec)))
        for r in back.collect():
            i = r.id
            assert (r.u, r.v, r.w, r.re, r.im) == pytest.approx((10.0 * i, 5.0 - i, 1.0 * i, 1.0, 2.0), abs=1e-6)
    for r in there.collect():
        if r.field_id == 2:
            assert r.u is None and r["shift"] is None
        else:
            assert r.u**2 + r.v**2 + r.w**2 == pytest.approx((10.0 * r.id) ** 2 + (5.0 - r.id) ** 2 + r.id**2)
    same = geometry.reprojected(rows.filter("field_id = 0"), fields, (1.0, 0.5)).collect()
    assert all((r.u, r.v, r.w, r["shift"]) == pytest.approx((10.0 * r.id, 5.0 - r.id, r.id, 0), abs=1e-9) for r in same)


def test_a_source_at_the_new_centre_has_no_phase(spark):
    """A point at the new phase centre: its phase in the old frame is 2 pi f / c times the new w less the old."""
    old, new, f = (0.7, 0.3), (0.71, 0.29), 1.4e9
    b = np.array([300.0, -120.0, 80.0])
    axes = lambda ra, dec: np.array([[-math.sin(ra), math.cos(ra), 0], [-math.sin(dec) * math.cos(ra), -math.sin(dec) * math.sin(ra), math.cos(dec)], [math.cos(dec) * math.cos(ra), math.cos(dec) * math.sin(ra), math.sin(dec)]])
    u, v, w = axes(*old) @ b
    path = (axes(*new)[2] - axes(*old)[2]) @ b
    angle = 2 * math.pi * f / 299_792_458 * path
    rows = spark.createDataFrame([(0, float(u), float(v), float(w), math.cos(angle), math.sin(angle), f)], "field_id int, u double, v double, w double, re double, im double, freq double")
    fields = spark.createDataFrame([(0, *old)], "row_id int, ra double, dec double")
    r = geometry.phase_shifted(geometry.reprojected(rows, fields, new)).first()
    assert (r.re, r.im) == pytest.approx((1, 0), abs=1e-7) and [r.u, r.v, r.w] == pytest.approx(list(axes(*new) @ b))


def test_baseline_uvw_is_the_tangent_frame(spark):
    x, y, z, gst, ra, dec = 100.0, -50.0, 30.0, 1.9, 0.4, 0.6
    r = one(spark, **dict(zip("uvw", geometry.baseline_uvw(*(F.lit(v) for v in (x, y, z, gst, ra, dec))), strict=True)))
    turn = np.array([[math.cos(gst), -math.sin(gst), 0], [math.sin(gst), math.cos(gst), 0], [0, 0, 1]])
    b = turn @ np.array([x, y, z])
    want = [b @ [-math.sin(ra), math.cos(ra), 0], b @ [-math.sin(dec) * math.cos(ra), -math.sin(dec) * math.sin(ra), math.cos(dec)], b @ [math.cos(dec) * math.cos(ra), math.cos(dec) * math.sin(ra), math.sin(dec)]]
    assert [r.u, r.v, r.w] == pytest.approx(want)
