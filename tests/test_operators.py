import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanglass.operators import joins, lattice, rows, selection, visibilities
from spanglass.plans import further
from spanglass.sources import tables
from spanglass.sources.fits import FitsSource, write_image
from spanglass.streaming import samples


def test_row_ids_and_changes(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    numbered = rows.with_row_id(d, ["k"])
    assert sorted((r.k, r.row_id) for r in numbered.collect()) == [(i, i) for i in range(1000)]
    star = F.col("k") % 5 == 0
    assert rows.deleted(numbered, star, limit=3).count() == 997
    up = rows.updated(numbered, {"k": F.col("k") + F.col("row_id")}, F.col("row_id") > 997)
    assert [r.k for r in up.filter("row_id > 996").orderBy("row_id").collect()] == [997, 1996, 1998]
    assert rows.with_new_rows(rows.with_new_column(numbered.limit(2), "s", "string"), 3).filter("s = ''").count() == 5
    with pytest.raises(ValueError, match="identical"):
        rows.concatenated(d, numbered)


def test_runs_and_group_fractile(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("ab"), rng.choice([None, 1.0, 2.0, 5.0, 9.0])) for i in range(200)]
    d = spark.createDataFrame(data, "r long, k string, x double")
    got = [r.run for r in rows.runs(d, ["k"], "r").orderBy("r").collect()]
    want, n = [], 0
    for i, (_, k, _) in enumerate(data):
        n += i > 0 and k != data[i - 1][1]
        want.append(n)
    assert got == want
    for f in (0.0, 0.25, 0.5, 1.0):
        for r in rows.group_fractile(d, ["k"], "x", f, "q").collect():
            v = sorted(x for _, k, x in data if k == r.k and x is not None)
            assert r.q == v[math.floor((len(v) - 1) * f)]


def test_time_joins(spark):
    left = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 1.0, 1.6, 5.0)] + [(2, 3.0)], "a int, time double")
    right = spark.createDataFrame([(1, 0.0, 10.0), (1, 2.0, 20.0)], "a int, time double, g double")
    near = {(r.a, r.time): r.g for r in joins.as_of(left, right, ["a"], "time", ["g"]).collect()}
    assert near == {(1, -1.0): 10.0, (1, 0.0): 10.0, (1, 1.0): 10.0, (1, 1.6): 20.0, (1, 5.0): 20.0, (2, 3.0): None}
    line = {(r.a, r.time): r.g for r in joins.interpolated(left, right, ["a"], "time", "g").collect()}
    assert line == {(1, -1.0): 10.0, (1, 0.0): 10.0, (1, 1.0): 15.0, (1, 1.6): pytest.approx(18.0), (1, 5.0): 20.0, (2, 3.0): None}
    f = spark.createDataFrame([(0, 0.1, 0.1)], "field_id int, lon double, lat double")
    c = spark.createDataFrame([(7, 0.0, 0.0), (8, 0.1, 0.12)], "cal_id int, cal_lon double, cal_lat double")
    assert joins.nearest_field(f, c).first().cal_id == 8


@pytest.fixture
def observation(spark):
    """Three rows, two spectral windows, polarisations, antennas and states."""
    t0 = 4_981_000_000.0
    main = spark.createDataFrame([(0, t0, 0, 1, 0, 0, 1, 0, [30.0, 40.0, 0.0], 10.0), (1, t0 + 10, 0, 1, 0, 1, 2, 1, [300.0, 400.0, 0.0], 10.0), (2, t0 + 20, 0, 1, 0, 0, 3, 1, [5.0, 12.0, 0.0], 10.0)], "row_id long, time double, antenna1 int, antenna2 int, field_id int, data_desc_id int, scan_number int, state_id int, uvw array<double>, exposure double")
    dims = {
        "data_description": spark.createDataFrame([(0, 0, 0), (1, 1, 1)], "row_id int, spectral_window_id int, polarization_id int"),
        "spectral_window": spark.createDataFrame([(0, 1.4e9), (1, 2.8e9)], "row_id int, ref_frequency double"),
        "polarization": spark.createDataFrame([(0, [9, 12]), (1, [5, 8])], "row_id int, corr_type array<int>"),
        "antenna": spark.createDataFrame([(0, "VA01"), (1, "VA02")], "row_id int, name string"),
        "field": spark.createDataFrame([(0, "TARGET")], "row_id int, name string"),
        "state": spark.createDataFrame([(0, "CALIBRATE_PHASE.ON_SOURCE"), (1, "TARGET.ON_SOURCE")], "row_id int, obs_mode string"),
    }
    return main, dims, t0


@pytest.mark.parametrize(
    ("selectors", "wanted"),
    [
        ({}, [0, 1, 2]), ({"spw": [0]}, [0, 2]), ({"correlation": [5]}, [1]), ({"intent": ["*TARGET*"]}, [1, 2]), ({"scan": [(2, 3)]}, [1, 2]), ({"antenna": ["VA02"]}, [0, 1, 2]),
        ({"baselines": [(1, 0)]}, []), ({"uvrange": (20.0, 0.1e3, "m")}, [0]), ({"uvrange": (0.2, None, "km")}, [1]), ({"uvrange": (0.2, 1.0, "klambda")}, [0]), ({"field": ["TAR*"], "scan": [1]}, [0]),
    ],
)
def test_selection(observation, selectors, wanted):
    main, dims, _ = observation
    assert sorted(r.row_id for r in selection.select(main, dims, **selectors).collect()) == wanted


def test_selection_of_times_and_unknown_names(observation):
    main, dims, t0 = observation
    assert [r.row_id for r in selection.select(main, dims, time=(t0 + 12,)).collect()] == [1]
    assert selection.select(main, dims, time=(t0 + 5, t0 + 30)).count() == 2
    with pytest.raises(ValueError, match="nothing matches"):
        selection.select(main, dims, field=["NO*"])


def plane(spark, spikes):
    rng = np.random.default_rng(3)
    data = [(t, c, 0, 10 + 0.01 * c + rng.normal(0, 0.05) + spikes.get((t, c), 0), 0.0, False, 1.0, 1) for t in range(20) for c in range(24)]
    return spark.createDataFrame(data, "time int, chan int, corr int, re double, im double, flag boolean, weight double, baseline int")


def test_flagging_finds_outliers(spark):
    d = plane(spark, {(5, 7): 100.0, (12, 3): 60.0})
    crop = {(r.time, r.chan) for r in visibilities.tfcrop(d, ["baseline", "corr"], 4.0, 5.0).filter("flag").collect()}
    assert {(5, 7), (12, 3)} <= crop and len(crop) < 25
    rf = {(r.time, r.chan) for r in visibilities.rflag_time(d, ["corr"], ["baseline", "corr"], 30.0).filter("flag").collect()}
    assert {(5, 7), (12, 3)} <= rf
    zero = visibilities.clip_zeros(d.withColumn("re", F.when(F.col("chan") == 2, 0.0).otherwise(F.col("re"))))
    assert visibilities.flag_summary(zero, ["corr"]).first().flagged == 20
    more = visibilities.extended(visibilities.flag_where(d, F.col("chan") < 14), ["baseline", "time"], grow_freq=0.5)
    assert more.filter("flag").count() == 480


def test_gain_solve_and_apply(spark):
    rng = np.random.default_rng(5)
    n = 6
    g = rng.uniform(0.7, 1.4, n) * np.exp(1j * rng.uniform(-1, 1, n))
    g *= np.exp(-1j * np.angle(g[0]))
    data = [(t, a, b, float((g[a] * g[b].conj()).real), float((g[a] * g[b].conj()).imag), False, 1.0) for t in range(3) for a in range(n) for b in range(a + 1, n)]
    d = spark.createDataFrame(data, "t int, antenna1 int, antenna2 int, re double, im double, flag boolean, weight double")
    gains = visibilities.solve_gains(d, ["t"], n)
    got = {r.antenna: complex(r.g_re, r.g_im) for r in gains.filter("t = 1").collect()}
    assert all(abs(got[i] - g[i]) < 1e-4 for i in range(n))
    fixed = visibilities.gain_corrected(d, gains, ["t"]).collect()
    assert len(fixed) == len(data) and all(abs(complex(r.re, r.im) - 1) < 1e-3 and not r.flag for r in fixed)


def test_fluxscale_and_continuum(spark):
    gains = spark.createDataFrame([("cal", 0, a, 2.0 * (1 + a), 0.0) for a in range(3)] + [("src", 0, a, 3.0 * (1 + a), 0.0) for a in range(3)], "field string, spw int, antenna int, g_re double, g_im double")
    assert visibilities.flux_scale(gains, "cal").first().flux == pytest.approx(2.25)
    d = spark.createDataFrame([(0, c, 5.0 + 0.5 * c + (9.0 if c == 10 else 0), 1.0, False, 1.0) for c in range(20)], "r int, chan int, re double, im double, flag boolean, weight double")
    out = {r.chan: (r.re, r.im) for r in visibilities.continuum_subtracted(d, ["r"], F.col("chan") != 10).collect()}
    assert out[10] == (pytest.approx(9.0), pytest.approx(0.0)) and out[3] == (pytest.approx(0.0), pytest.approx(0.0))


def test_lattice_statistics(spark):
    d = spark.range(64).select(F.lit(0).alias("g"), F.col("id").cast("int").alias("x"), F.col("id").cast("double").alias("value"), F.lit(True).alias("mask"))
    s = lattice.statistics(d, ["g"], ["x"]).first()
    q = lattice.quartiles(d, ["g"]).first()
    assert (s["median"], q.q1, q.q3, lattice.madfm(d, ["g"]).first().madfm, s.min_pos.x, s.max_pos.x) == (31.5, 15.0, 47.0, 16.0, 0, 63)
    assert math.isnan(lattice.statistics(d.filter("x = 3"), ["g"], ["x"]).first().sigma)


def test_images(spark):
    d = spark.createDataFrame([(x, y, float(10 * x + y), True) for x in range(4) for y in range(4)], "x int, y int, value double, mask boolean")
    half = lattice.regridded(d, d, ("x", "y"), F.col("x") + 0.5, F.col("y") + 0.25)
    assert {(r.x, r.y): r.value for r in half.collect()} == {(x, y): 10 * (x + 0.5) + y + 0.25 for x in range(3) for y in range(3)}
    inside = {(r.x, r.y) for r in d.filter(lattice.in_polygon("x", "y", [(0.5, 0.5), (2.5, 0.5), (2.5, 2.5), (0.5, 2.5)])).collect()}
    assert inside == {(1, 1), (1, 2), (2, 1), (2, 2)}
    pb = lattice.pb_corrected(d, d.withColumn("value", F.col("x") / 4.0), ["x", "y"], 0.3)
    assert pb.filter("mask").count() == 8


def test_fits_round_trip(spark, tmp_path):
    d = spark.range(24).select((F.col("id") % 4).cast("int").alias("i0"), (F.col("id") / 4).cast("int").alias("i1"), F.lit(0).alias("i2"), (F.col("id") * 1.5).alias("value"))
    path = str(tmp_path / "image.fits")
    write_image(d, path, [4, 6], {"BUNIT": "Jy/beam"})
    spark.dataSource.register(FitsSource)
    assert sorted(map(tuple, spark.read.format("fits").load(path).collect())) == sorted(map(tuple, d.collect()))


def test_tables(spark, tmp_path):
    d = tables.with_keyword(spark.range(3).toDF("t"), "t", unit="s")
    path = str(tmp_path / "table")
    tables.save_table(d, path)
    tables.append_rows(d, path)
    back = tables.open_table(spark, path)
    assert back.count() == 6 and tables.keywords(back, "t") == {"unit": "s"}


def test_streaming_means_equal_batch(spark, tmp_path):
    d = spark.range(500).select(F.timestamp_seconds(F.col("id") * 7).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    d.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = samples.windowed_means(stream, "ts", "v", ["k"], "5 minutes", "1 minute").writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = samples.windowed_means(d, "ts", "v", ["k"], "5 minutes", "1 minute")
    assert sorted(map(tuple, spark.table("means").collect())) == sorted(map(tuple, want.collect()))


def test_zero_weights_and_sigmas_do_not_raise(spark):
    vis = spark.createDataFrame([(0, 0, 1.0, 0.0, False, 0.0, 0.0, 0, 1), (0, 1, 3.0, 0.0, False, 0.0, 2.0, 0, 1)], "row int, chan int, re double, im double, flag boolean, weight double, sigma double, antenna1 int, antenna2 int")
    (r,) = visibilities.channel_average(vis, 2, ["row"]).collect()
    assert (r.re, r.weight, r.sigma) == (2.0, 0.0, 2.0)
    assert visibilities.solve_gains(vis, ["row"], 2).count() == 0
    uv = spark.createDataFrame([(0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (90.0, 0.0, 2.0)], "u double, v double, weight double")
    for mode in ("uniform", "briggs"):
        assert sorted(x.imaging_weight > 0 for x in visibilities.weighted(uv, 10.0, mode).collect()) == [False, False, True]
    gains = spark.createDataFrame([("a", 0, 0, 0.0, 0.0), ("b", 0, 0, 1.0, 0.0)], "field string, spw int, antenna int, g_re double, g_im double")
    assert [x.flux for x in visibilities.flux_scale(gains, "a").collect()] == [None]


def test_beam_correction_of_a_wide_image(spark, tmp_path):
    rows = [(s, 1, 3.0, 100.0, "N") for s in (50, 60, 60_000, 2_000_000_000)]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = further.beam_corrected(spark, str(tmp_path)).collect()
    assert sorted((r.x, r.value) for r in got) == [(50, 100.0), (60, round(100 / math.exp(-0.1), 3))]


def test_pairs_above_a_value_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(joins, "PIECE", 7)
    rng, far = random.Random(4), [None, float("inf"), -float("inf"), float("nan"), 0.0, 5.0]
    left = [(i, rng.choice([1, 2, None]) if i % 9 == 0 else 1, rng.choice(far) if i % 5 == 0 else float(rng.randint(-9, 9))) for i in range(150)]
    right = [(i, rng.choice([1, 2, 3, None]), rng.choice(far) if i % 3 == 0 else rng.uniform(-12, 12)) for i in range(60)]
    a, b = spark.createDataFrame(left, "i int, k int, low double"), spark.createDataFrame(right, "j int, k int, high double")
    got = joins.exceeding(a, b, ["k"], "low", "high")
    want = sorted((r.i, r.j) for r in a.join(b, "k").filter("high > low").collect())
    assert sorted((r.i, r.j) for r in got.collect()) == want and len(want) > 1000
    assert got.columns == ["k", "i", "low", "j", "high"]
    assert joins.exceeding(a.limit(0), b, ["k"], "low", "high").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__piece" in plan and "__range" in plan  # a task of a key would hold all its pairs


@pytest.mark.parametrize("points", [1, 8])
def test_cones_counted_by_whole_cells_and_edges(spark, monkeypatch, points):
    monkeypatch.setattr(joins, "CELL_POINTS", points)
    rng = random.Random(points)
    p = [(i, rng.uniform(-1, 14), rng.choice([rng.uniform(-1.57, 1.57), rng.uniform(1.3, 1.5707), 0.0])) for i in range(3000)]
    c = [(j, rng.uniform(-7, 7), rng.uniform(-1.5, 1.5), rng.choice([0.0, 0.01, 0.3, 0.5, 1.0, 2.0])) for j in range(60)] + [(60, 0.0, math.pi / 2, 0.2), (61, 0.0, 0.0, math.pi), (62, 6.28, 0.4, 0.8), (63, None, 0.0, 1.0)] + [(64 + j, q[1], q[2], 1e-12) for j, q in enumerate(p[:5])]
    a, b = spark.createDataFrame(p, "i int, lon double, lat double"), spark.createDataFrame(c, "cone_id int, lon0 double, lat0 double, radius double")
    d = joins.sky.distance(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    want = a.crossJoin(b).filter(d <= F.col("radius")).groupBy("cone_id").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    got = joins.cone_summaries(a, b, "lon", "lat", "i")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert joins.cone_summaries(a.limit(0), b, "lon", "lat", "i").count() == joins.cone_summaries(a, b.limit(0), "lon", "lat", "i").count() == 0


def test_time_average_deals_rows_to_tasks_of_one_size(spark, monkeypatch):
    monkeypatch.setattr(visibilities, "TASK_ROWS", 50)
    d = spark.range(1000).select((F.col("id") % 3).alias("b"), (F.col("id") % 2).alias("corr"), F.col("id").cast("double").alias("time"), F.lit(2.0).alias("re"), F.lit(1.0).alias("im"), F.lit(False).alias("flag"), F.lit(1.0).alias("weight"))
    got = visibilities.time_average(d, 10.0, ["b"], ["corr"])
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 10
    rows = got.collect()
    assert sum(r.weight for r in rows) == 1000 and len(rows) == len({(r.b, r.corr, r.bucket) for r in rows}) == 600 and {(r.re, r.im) for r in rows} == {(2.0, 1.0)}
