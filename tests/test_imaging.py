import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanglass.operators import beams, fourier, gridding
from spanglass.sources.dataset import REQUIRED, Dataset
from spanglass.sources.flag_versions import FlagVersions


def long_form(plane, **more):
    return [(*more.values(), x, y, float(v.real), float(v.imag)) for (x, y), v in np.ndenumerate(plane)]


# ---- transforms


@pytest.mark.parametrize("shape", [(8, 6), (9, 5), (1, 7)])
def test_transform_equals_that_of_whole_planes(spark, shape):
    rng = np.random.default_rng(sum(shape))
    planes = [rng.normal(size=shape) + 1j * rng.normal(size=shape) for _ in range(2)]
    d = spark.createDataFrame([r for k, p in enumerate(planes) for r in long_form(p, k=k)], "k int, x int, y int, re double, im double").repartition(3)
    got = {(r.k, r.x, r.y): complex(r.re, r.im) for r in fourier.transformed(d, ["k"], shape).collect()}
    assert len(got) == 2 * shape[0] * shape[1]
    for k, p in enumerate(planes):
        want = np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(p)))
        assert all(got[k, x, y] == pytest.approx(v, abs=1e-9) for (x, y), v in np.ndenumerate(want))
    back = fourier.transformed(fourier.transformed(d, ["k"], shape), ["k"], shape, inverse=True).collect()
    assert all(complex(r.re, r.im) == pytest.approx(planes[r.k][r.x, r.y], abs=1e-9) for r in back)


def test_missing_pixels_are_zero(spark):
    d = spark.createDataFrame([(2, 1, 3.0), (9, 9, 1.0), (0, 0, None)], "x int, y int, re double")
    plane = np.zeros((4, 3))
    plane[2, 1] = 3
    want = np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(plane)))
    got = fourier.transformed(d, [], (4, 3)).collect()
    assert len(got) == 12 and all(complex(r.re, r.im) == pytest.approx(want[r.x, r.y]) for r in got)


def test_feather_keeps_the_large_scale_of_one_and_the_small_scale_of_the_other(spark):
    shape = (32, 24)
    x, y = np.meshgrid(np.arange(32) - 16, np.arange(24) - 12, indexing="ij")
    gauss = lambda w: np.exp(-4 * math.log(2) * (x**2 + y**2) / w**2)
    sky = gauss(3.0) + 0.5
    fft, ifft = lambda p: np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(p))), lambda p: np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(p)))
    fx, fy = np.meshgrid((np.arange(32) - 16) / 32, (np.arange(24) - 12) / 24, indexing="ij")
    low_response = np.exp(-math.pi**2 / (4 * math.log(2)) * (fx**2 + fy**2) * 8.0**2)
    area = 64 / 4.0
    low = ifft(fft(sky) * low_response).real * area  # in units of the large beam
    high = sky - sky.mean()  # without what a dish sees
    rows = lambda p: spark.createDataFrame([(int(i), int(j), float(v), bool(i > 0)) for (i, j), v in np.ndenumerate(p)], "x int, y int, value double, mask boolean")
    got = fourier.feathered(rows(high), rows(low), [], shape, (2.0, 2.0), (8.0, 8.0, 0.0)).collect()
    want = ifft(fft(high) * (1 - low_response) + fft(low) / area).real
    assert all(r.value == pytest.approx(want[r.x, r.y], abs=1e-9) and r.mask == (r.x > 0) for r in got) and len(got) == 32 * 24
    assert np.mean([r.value for r in got]) == pytest.approx(sky.mean(), abs=1e-9)


# ---- gridding


def test_kernel_falls_from_the_middle_to_its_support(spark):
    d = spark.createDataFrame([(float(v),) for v in np.linspace(-3.5, 3.5, 141)], "x double").select("x", gridding.kernel(F.col("x")).alias("k")).orderBy("x").collect()
    k = [r.k for r in d]
    assert k == pytest.approx(k[::-1], abs=1e-12) and k[70] == max(k) and all(v == 0 for r, v in zip(d, k, strict=True) if abs(r.x) > 3)
    assert all(a >= b - 1e-4 for a, b in zip(k[70:], k[71:], strict=False)) and k[129] < 0.02 * k[70]


def test_grid_and_back(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 2), float(u), float(v), 2.0, -1.0, float(w)) for i, (u, v, w) in enumerate(zip(rng.uniform(-20, 20, 200), rng.uniform(-20, 20, 200), rng.uniform(0.5, 2, 200), strict=True))]
    uv = spark.createDataFrame(rows, "row int, plane int, u double, v double, re double, im double, imaging_weight double").repartition(3)
    g = gridding.gridded(uv, 1.5, ["plane"])
    assert g.agg(F.sum("weight")).first()[0] == pytest.approx(sum(r[6] for r in rows))
    assert g.agg(F.sum("re")).first()[0] == pytest.approx(2 * sum(r[6] for r in rows))
    flat = g.select("plane", "gu", "gv", (F.col("re") / F.col("weight")).alias("re"), (F.col("im") / F.col("weight")).alias("im"))
    back = gridding.degridded(uv, flat, 1.5, "row", ["plane"]).collect()
    assert len(back) == 200 and all((r.model_re, r.model_im) == pytest.approx((2, -1), abs=1e-9) for r in back)
    nothing = gridding.degridded(uv.limit(3), flat.filter("false"), 1.5, "row", ["plane"]).collect()
    assert [(r.model_re, r.model_im) for r in nothing] == [(0, 0)] * 3
    cut = gridding.gridded(uv, 1.5, shape=(6, 5)).agg(F.min("gu"), F.max("gu"), F.min("gv"), F.max("gv")).first()
    assert tuple(cut) == (-3, 2, -2, 2)
    assert [r[0] for r in spark.createDataFrame([(-6.0,), (-4.0,), (4.9,), (5.0,)], "w double").select(gridding.w_plane(F.col("w"), 10.0)).collect()] == [-1, 0, 0, 1]


def _plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_gridding_sums_batches_and_not_cells_of_samples(spark):
    rng = np.random.default_rng(8)
    rows = [(None if i % 17 == 0 else "ab"[i % 2], float(u), float(v), None if i % 5 == 0 or v > 0 else 2.0, 1.0, None if i % 7 == 0 else 0.5) for i, (u, v) in enumerate(rng.uniform(-9, 9, (300, 2)))]
    rows += [("a", 1e9, -1e9, 3.0, 1.0, 1.0), ("a", None, 0.0, 3.0, 1.0, 1.0), ("b", float("nan"), 0.0, 3.0, 1.0, 1.0)]
    uv = spark.createDataFrame(rows, "plane string, u double, v double, re double, im double, imaging_weight double").repartition(3)
    g = gridding.gridded(uv, 1.5, ["plane"])
    assert "Generate" not in _plan(g)
    want = {}
    for plane, u, v, re, _, w in rows:
        if u is None or not math.isfinite(u):
            continue
        (nu, ku), (nv, kv) = gridding._taps(np.array([u / 1.5])), gridding._taps(np.array([v / 1.5]))
        for i in range(7):
            for j in range(7):
                if ku[0, i] > 0 and kv[0, j] > 0:
                    sums = want.setdefault((plane, int(nu[0]) + i - 3, int(nv[0]) + j - 3), [None, None])
                    for x, of in enumerate((re, 1.0)):
                        if of is not None and w is not None:
                            sums[x] = (sums[x] or 0.0) + of * w * ku[0, i] * kv[0, j]
    got = {(r.plane, r.gu, r.gv): [r.re, r.weight] for r in g.collect()}
    assert got.keys() == want.keys() and any(a is None for a, _ in want.values())
    assert all(x == (None if y is None else pytest.approx(y)) for k in want for x, y in zip(got[k], want[k], strict=True))


def test_degridding_does_not_multiply_samples(spark):
    rng = np.random.default_rng(5)
    rows = [(float(u), float(v), float(i % 3)) for i, (u, v) in enumerate(rng.uniform(-6, 6, (40, 2)))] * 2 + [(None, 0.0, 1.0), (float("nan"), 0.0, 1.0)]
    uv = spark.createDataFrame(rows, "u double, v double, re double").select(F.struct("u", "v", "re").alias("row"), "u", "v")
    cells = [(i, j, float(x), float(y)) for (i, j), (x, y) in zip([(i, j) for i in range(-3, 4) for j in range(-3, 5)], rng.normal(size=(56, 2)), strict=True)]
    back = gridding.degridded(uv, spark.createDataFrame(cells, "gu int, gv int, re double, im double"), 1.5, "row")
    assert _plan(back).count("Generate") == 1  # of the grid
    got = back.collect()
    assert len(got) == 80 and len({(r.row, r.model_re) for r in got}) == 40  # equal samples keep a row each
    grid = {(i, j): (x, y) for i, j, x, y in cells}
    for r in got:
        (nu, ku), (nv, kv) = gridding._taps(np.array([r.row.u / 1.5])), gridding._taps(np.array([r.row.v / 1.5]))
        want = sum(ku[0, i] * kv[0, j] * np.array(grid.get((nu[0] + i - 3, nv[0] + j - 3), (0.0, 0.0))) for i in range(7) for j in range(7))
        assert (r.model_re, r.model_im) == pytest.approx(tuple(want))


def test_a_point_off_the_centre_comes_out_where_it_is(spark):
    """Samples of a point source, gridded by plane of w, transformed, turned by each plane's w and corrected: the peak is the point, at its flux."""
    n, increment, rng = 32, 2e-3, np.random.default_rng(1)
    px, py = 22, 11
    l, m = (px - 16) * increment, (py - 16) * increment
    cell = 1 / (n * increment)
    u, v, w = (rng.uniform(-12, 12, 4000) * cell, rng.uniform(-12, 12, 4000) * cell, rng.uniform(-400, 400, 4000))
    value = np.exp(-2j * np.pi * (u * l + v * m + w * (math.sqrt(1 - l * l - m * m) - 1)))
    step = 40.0
    uv = spark.createDataFrame([(float(a), float(b), float(c), float(z.real), float(z.imag), 1.0) for a, b, c, z in zip(u, v, w, value, strict=True)], "u double, v double, w double, re double, im double, imaging_weight double")
    g = gridding.gridded(uv.withColumn("plane", gridding.w_plane(F.col("w"), step)), cell, ["plane"], (n, n))
    pixels = g.select("plane", (F.col("gu") + n // 2).alias("x"), (F.col("gv") + n // 2).alias("y"), "re", "im")
    image = gridding.w_screened(fourier.transformed(pixels, ["plane"], (n, n), inverse=True), F.col("plane") * step, increment, (n, n))
    whole = gridding.kernel_corrected(image.groupBy("x", "y").agg((F.sum("re") * n * n / 4000).alias("re"), F.sum("im").alias("im")), (n, n))
    got = {(r.x, r.y): r.re for r in whole.filter("x BETWEEN 6 AND 26 AND y BETWEEN 6 AND 26").collect()}
    assert max(got, key=got.get) == (px, py) and got[px, py] == pytest.approx(1.0, abs=0.05)


# ---- beams


def test_deconvolution_undoes_convolution(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(40):
        a, b = (rng.uniform(2, 5), rng.uniform(0.5, 2), rng.uniform(0, math.pi)), (rng.uniform(1, 4), rng.uniform(0.3, 1), rng.uniform(0, math.pi))
        rows.append((*beams._beam(beams._matrix(*a) + beams._matrix(*b)), *b, *a))
    d = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, major double, minor double, angle double")
    for r in d.withColumn("x", beams.deconvolved(*(F.col(c) for c in "abcdef"))).collect():
        assert (r.x.major, r.x.minor, math.cos(2 * (r.x.angle - r.angle))) == pytest.approx((r.major, r.minor, 1), abs=1e-6)
    one = lambda *v: spark.range(1).select(beams.deconvolved(*(F.lit(float(x)) for x in v)).alias("x")).first().x
    assert one(2, 1, 0.3, 2, 1, 0.3) is None and one(2, 1, 0, 3, 0.5, 0) is None
    assert tuple(one(5, 5, 0, 3, 3, 1)) == pytest.approx((4, 4, 0))


def inside(whole, part):
    root = np.linalg.inv(np.linalg.cholesky(beams._matrix(*whole)))
    return np.linalg.eigvalsh(root @ beams._matrix(*part) @ root.T)[-1] <= 1 + 1e-6


def test_common_beam_encloses_all(spark):
    rng = random.Random(7)
    sets = {"a": [(4.0, 2.0, 0.0), (3.0, 1.0, 0.0)], "b": [(4.0, 2.0, 0.0), (4.0, 2.0, math.pi / 2)], "n": [(0.0, 0.0, 0.0)], "m": [(0.0, 0.0, 0.0), (2.0, 1.0, 0.5)]}
    sets |= {f"r{i}": [(a := rng.uniform(1, 5), rng.uniform(0.3, 1) * a, rng.uniform(0, math.pi)) for _ in range(6)] for i in range(8)}
    d = spark.createDataFrame([(k, c, *b) for k, v in sets.items() for c, b in enumerate(v)], "k string, chan int, major double, minor double, angle double").repartition(3)
    got = {r.k: (r.major, r.minor, r.angle) for r in beams.common_beams(d, ["k"], ["chan"]).collect()}
    assert set(got) == set(sets) - {"n"}
    assert got["a"] == pytest.approx((4, 2, 0)) and got["b"][:2] == pytest.approx((4, 4)) and got["m"] == pytest.approx((2, 1, 0.5))
    for k, whole in got.items():
        assert all(inside(whole, b) for b in sets[k] if b[0] > 0), k
    # Two ellipses: no ellipse of less area encloses both (looked for on a grid of shapes).
    pair = [(4.0, 1.0, 0.2), (3.0, 2.0, 1.3)]
    best = beams.enclosing_beam(pair)
    smaller = [(a, b, t) for a in np.linspace(3.9, 5, 45) for b in np.linspace(1, 4, 61) for t in np.linspace(0, math.pi, 40) if a * b < 0.985 * best[0] * best[1]]
    assert not any(all(inside(s, p) for p in pair) for s in smaller)
    r = beams.beam_extremes(d.filter("k = 'm' OR k = 'b'"), ["k"], ["chan"]).orderBy("k").collect()
    assert [(x.n, x.smallest.chan, x.largest.chan, x["median"].chan) for x in r] == [(2, 0, 0, 0), (1, 1, 1, 1)]


# ---- datasets


@pytest.fixture
def dataset(spark):
    d = Dataset.empty(spark)
    fill = lambda name, rows, names: d[name].sparkSession.createDataFrame(rows, names)

    def table(name, rows):
        """Rows given by some columns, the others null; units stay."""
        given = fill(name, [tuple(r.values()) for r in rows], list(rows[0]))
        return given.select(*((F.col(f.name) if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name, metadata=f.metadata or {}) for f in d[name].schema))

    return d.replaced(
        main=table("main", [{"row_id": i, "antenna1": 0, "antenna2": 1, "data_desc_id": i % 2, "field_id": 0, "observation_id": 0, "processor_id": -1, "state_id": -1} for i in range(4)]),
        antenna=table("antenna", [{"row_id": i, "name": f"A{i}"} for i in range(2)]),
        data_description=table("data_description", [{"row_id": i, "spectral_window_id": i, "polarization_id": 0} for i in range(2)]),
        spectral_window=table("spectral_window", [{"row_id": i, "num_chan": 1, "chan_freq": [1.0], "chan_width": [1.0], "effective_bw": [1.0], "resolution": [1.0], "name": f"w{i}"} for i in range(2)]),
        polarization=table("polarization", [{"row_id": 0, "num_corr": 2, "corr_type": [5, 8]}]),
        field=table("field", [{"row_id": 0, "name": "F"}]),
        observation=table("observation", [{"row_id": 0, "observer": "x"}]),
    )


def test_a_sound_dataset_has_no_issue_and_comes_back(spark, dataset, tmp_path):
    assert dataset.report().collect() == []
    path = f"{tmp_path}/set"
    dataset.save(path)
    again = Dataset.open(spark, path)
    assert set(again.tables) == set(REQUIRED) and again.report().collect() == [] and again.main.count() == 4
    with pytest.raises(Exception, match="(?i)exist"):
        dataset.save(path)
    named = again.described("antenna1.name", "antenna2.name", "spectral_window.name", "polarization.num_corr", "field.name", "state.obs_mode").orderBy("row_id").collect()
    assert [(r.antenna1_name, r.antenna2_name, r.spectral_window_name, r.polarization_num_corr, r.field_name, r.state_obs_mode) for r in named] == [("A0", "A1", f"w{i % 2}", 2, "F", None) for i in range(4)]
    assert again.with_main(again.main.limit(1)).main.count() == 1
    with pytest.raises(KeyError):
        again["nothing"]


def test_each_fault_has_its_row(spark, dataset):
    main = dataset.main.withColumn("antenna2", F.lit(7)).withColumn("field_id", F.lit(-1)).withColumn("state_id", F.when(F.col("row_id") == 0, 3).otherwise(-1)).withColumn("data_desc_id", F.when(F.col("row_id") > 1, F.col("data_desc_id")))
    main = main.withColumn("time", F.col("time").cast("string")).withMetadata("exposure", {"unit": "d"}).withMetadata("uvw", {})
    antenna = dataset["antenna"].unionByName(dataset["antenna"].filter("row_id = 1")).drop("mount")
    windows = dataset["spectral_window"].withColumn("num_chan", F.col("row_id").cast("int"))
    bad = Dataset({k: v for k, v in dataset.tables.items() if k != "pointing"}).replaced(main=main, antenna=antenna, spectral_window=windows)
    sizes = [("spectral_window", c, "another size than told", 1) for c in ("chan_freq", "chan_width", "effective_bw", "resolution")]
    assert sorted(((r.table, r.column, r.issue, r.n) for r in bad.report().collect()), key=str) == sorted([
        ("main", "antenna2", "refers to nothing", 4), ("main", "field_id", "refers to nothing", 4), ("main", "state_id", "refers to nothing", 1), ("main", "data_desc_id", "refers to nothing", 2),
        ("antenna", "row_id", "row numbers are not 0, 1, 2 ...", 3), ("antenna", "mount", "missing column", 1), ("main", "time", "wrong type", 1), ("main", "exposure", "wrong unit", 1),
        ("main", "uvw", "missing unit", 1), ("main", "time", "missing unit", 1), ("pointing", None, "missing table", 1), *sizes,
    ], key=str)


# ---- flag versions


def test_versions_are_saved_listed_restored_renamed_and_deleted(spark, tmp_path):
    t = spark.createDataFrame([(i, "x", i % 2 == 0) for i in range(6)], "row int, more string, flag boolean")
    store = FlagVersions(spark, f"{tmp_path}/v", ["row"])
    flags = lambda d: [r.flag for r in d.orderBy("row").collect()]
    assert store.list() == []
    store.save(t, "a", "first")
    store.save(t.withColumn("flag", F.col("row") > 3), "b")
    assert store.list() == [("a", "first"), ("b", "")]
    other = t.withColumn("flag", F.col("row") == 1)
    assert flags(store.restore(other, "a")) == [True, False, True, False, True, False] and store.restore(other, "a").columns == t.columns
    assert flags(store.restore(other, "a", "or")) == [True, True, True, False, True, False] and flags(store.restore(other, "b", "and")) == [False] * 6
    store.save(other, "a", merge="or")
    assert store.list()[0] == ("a", "first") and flags(store.restore(t, "a")) == [True, True, True, False, True, False]
    store.rename("a", "c", "new")
    assert store.list() == [("c", "new"), ("b", "")]
    store.delete("b")
    assert FlagVersions(spark, f"{tmp_path}/v", ["row"]).list() == [("c", "new")]
    for bad in (lambda: store.save(t, ""), lambda: store.save(t, "main"), lambda: store.save(t, "a/b"), lambda: store.restore(t, "b"), lambda: store.delete("b"), lambda: store.rename("b", "d"), lambda: store.restore(t.limit(2), "c"), lambda: store.save(t, "z", merge="xor"), lambda: store.save(t.limit(2), "c", merge="or"), lambda: store.rename("c", "c")):
        with pytest.raises(ValueError):
            bad()
    assert store.list() == [("c", "new")]


def test_a_write_that_breaks_off_is_never_seen(spark, tmp_path):
    t = spark.createDataFrame([(i, False) for i in range(4)], "row int, flag boolean")
    store = FlagVersions(spark, f"{tmp_path}/v", ["row"])
    store.save(t, "a")
    broken = t.withColumn("flag", F.raise_error(F.lit("lost")).cast("boolean"))
    with pytest.raises(Exception, match="lost"):
        store.save(broken, "a")
    with pytest.raises(Exception, match="lost"):
        store.save(broken, "b")
    assert store.list() == [("a", "")] and store.flags("a").count() == 4
