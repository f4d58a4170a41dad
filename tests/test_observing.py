import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanglass.operators import joins, lattice, rows, summaries, transform, visibilities
from spanglass.sources.dataset import Dataset

# ---- time and sky joins against plain loops


@pytest.fixture(scope="module")
def history():
    rng = random.Random(4)
    left = [(rng.choice([1, 2, 3, None]), rng.choice([round(rng.uniform(-5, 105), 1), float(rng.randrange(0, 100, 5))])) for _ in range(300)]
    right = [(k, float(t), rng.uniform(-2, 2), rng.uniform(-2, 2), rng.random() < 0.3) for k in (1, 2, None) for t in rng.sample(range(0, 100, 5), 12 if k == 1 else 3)]
    return left, right


@pytest.mark.parametrize("parts", [1, 7, 256])
def test_neighbours_in_time(spark, monkeypatch, history, parts):
    monkeypatch.setattr(joins, "PARTS", parts)
    left, right = history
    a = spark.createDataFrame([(i, *r) for i, r in enumerate(left)] + [(1000, 1, None)], "i int, k int, time double").repartition(3)
    b = spark.createDataFrame(right, "k int, time double, g_re double, g_im double, flag boolean").repartition(3)
    near = {r.i: (r.time_of, r.g_re) for r in joins.as_of(a, b, ["k"], "time", ["g_re"]).collect()}
    line = {r.i: r.g_re for r in joins.interpolated(a, b, ["k"], "time", "g_re").collect()}
    gain = {r.i: r for r in joins.interpolated_gain(a, b, ["k"], "time").collect()}
    assert set(near) == set(line) == set(gain) == {*range(300), 1000} and near[1000] == (None, None) and line[1000] is None and gain[1000].flag
    for i, (k, t) in enumerate(left):
        mine = sorted(r for r in right if r[0] == k)
        before, after = [r for r in mine if r[1] <= t], [r for r in mine if r[1] >= t]
        if not mine:
            assert near[i] == (None, None) and line[i] is None and (gain[i].g_re, gain[i].flag) == (None, True)
            continue
        best = min(mine, key=lambda r: (abs(r[1] - t), r[1]))
        assert near[i] == (best[1], best[2])
        p, q = (before[-1] if before else after[0]), (after[0] if after else before[-1])
        s = (t - p[1]) / (q[1] - p[1]) if q[1] > p[1] else 0.0
        assert line[i] == pytest.approx(p[2] + s * (q[2] - p[2]))
        x, y = complex(p[2], p[3]), complex(q[2], q[3])
        want = (abs(x) + s * (abs(y) - abs(x))) * np.exp(1j * (np.angle(x) + s * np.angle(y / x)))
        assert complex(gain[i].g_re, gain[i].g_im) == pytest.approx(want, abs=1e-9) and gain[i].flag == (p[4] or (q[4] and q[1] > p[1]))


def test_no_solutions_at_all(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, time double")
    b = spark.createDataFrame([], "k int, time double, g_re double, g_im double, flag boolean")
    assert joins.interpolated_gain(a, b, ["k"], "time").collect()[0].flag and joins.as_of(a, b, ["k"], "time", ["g_re"]).collect()[0].g_re is None


def test_cones_of_all_sizes_anywhere(spark):
    rng = random.Random(8)
    points = [(i, rng.uniform(-1, 7), math.asin(rng.uniform(-1, 1))) for i in range(1500)] + [(1500, 0.0, math.pi / 2), (1501, 3.0, -math.pi / 2), (1502, 2 * math.pi, 0.0), (1503, 0.0, 0.0)]
    cones = [(0, 0.0, 0.0, 0.2), (1, 6.28, 0.1, 0.05), (2, 1.0, 1.5, 0.2), (3, 4.0, -1.57, 0.1), (4, 2.0, 0.3, 3.0), (5, 3.0, -0.7, 0.02), (6, -0.5, 0.0, 1e-6)]
    p = spark.createDataFrame(points, "i int, lon double, lat double").repartition(3)
    c = spark.createDataFrame(cones, "cone_id int, lon0 double, lat0 double, radius double")
    unit = lambda a, d: np.array([math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)])
    want = sorted((i, k) for i, a, d in points for k, a0, d0, r in cones if math.atan2(np.linalg.norm(np.cross(unit(a, d), unit(a0, d0))), unit(a, d) @ unit(a0, d0)) <= r)
    assert sorted((r.i, r.cone_id) for r in joins.in_cones(p, c, "lon", "lat").collect()) == want and len(want) > 1500


def test_row_numbers_do_not_depend_on_a_second_sample(spark):
    d = spark.range(400_000).select((F.hash("id") % 1000).alias("k"), "id", F.lit("x" * 20).alias("more"))
    n = rows.with_row_id(d, ["k", "id"])
    r = n.agg(F.count_distinct("row_id").alias("d"), F.min("row_id").alias("a"), F.max("row_id").alias("b")).first()
    assert tuple(r) == (400_000, 0, 399_999)
    assert n.filter("row_id % 100000 = 7").orderBy("row_id").select("k", "id").collect() == [x for j, x in enumerate(d.orderBy("k", "id").select("k", "id").collect()) if j % 100_000 == 7]


# ---- split and summaries of a small dataset


@pytest.fixture(scope="module")
def dataset(spark):
    main = [(i, i % 2, 1 + i % 2, i % 3, i % 4 // 2, 0, i // 3, float(100 - i), 10.0, i == 5, 0, 0, [3.0 * i, 4.0, 0.0]) for i in range(8)]
    vis = [(i, corr, c, float(i * 100 + c), float(c), (c == 2) or i == 4, 1.0 + c) for i in range(8) for corr in (0, 1) for c in range(5)]
    return Dataset({
        "main": spark.createDataFrame(main, "row_id long, antenna1 int, antenna2 int, data_desc_id int, field_id int, state_id int, scan_number int, time double, interval double, flag_row boolean, observation_id int, array_id int, uvw array<double>").repartition(2),
        "vis": spark.createDataFrame(vis, "row_id long, corr int, chan int, re double, im double, flag boolean, weight double").repartition(2),
        "data_description": spark.createDataFrame([(0, 2, 0), (1, 1, 1), (2, 0, 0)], "row_id long, spectral_window_id int, polarization_id int"),
        "spectral_window": spark.createDataFrame([(w, f"w{w}", 5, [1e9 * (w + 1) + k for k in range(5)], [-1.0] * 5, 0.0, 0.0) for w in range(3)], "row_id long, name string, num_chan int, chan_freq array<double>, chan_width array<double>, ref_frequency double, total_bandwidth double"),
        "polarization": spark.createDataFrame([(0, 2, [9, 12]), (1, 2, [5, 99])], "row_id long, num_corr int, corr_type array<int>"),
        "field": spark.createDataFrame([(0, "F0"), (1, "F1"), (2, "F2")], "row_id long, name string"),
        "state": spark.createDataFrame([(0, "B,A")], "row_id long, obs_mode string"),
        "observation": spark.createDataFrame([(0, "me"), (1, "you")], "row_id long, observer string"),
        "antenna": spark.createDataFrame([(k, f"A{k}", [1.0, 1.0, 0.0]) for k in range(4)], "row_id long, name string, position array<double>"),
    })


def test_split_keeps_what_was_selected_and_its_metadata(spark, dataset):
    s = transform.split(dataset, F.col("field_id") == 1, {1: (1, 4), 2: (0, 2)}, width=2, keep_flags=False)
    # Field 1 has rows 2, 3, 6, 7; row 2 is of window 0.  By time: 7, 6, 3 of windows 1, 2, 2.
    assert [(r.row_id, r.time, r.data_desc_id, r.field_id) for r in s.main.orderBy("row_id").collect()] == [(0, 93.0, 1, 0), (1, 94.0, 0, 0), (2, 97.0, 0, 0)]
    assert s.main.columns == dataset.main.columns
    assert [(r.row_id, r.spectral_window_id, r.polarization_id) for r in s["data_description"].orderBy("row_id").collect()] == [(0, 1, 0), (1, 0, 1)]
    assert [(r.row_id, r.num_chan, r.chan_freq, r.chan_width, r.ref_frequency, r.total_bandwidth) for r in s["spectral_window"].orderBy("row_id").collect()] == [(0, 2, [2e9 + 1.5, 2e9 + 3.5], [-2.0, -2.0], 2e9 + 1.5, 4.0), (1, 2, [3e9 + 0.5, 3e9 + 2], [-2.0, -1.0], 3e9 + 0.5, 3.0)]
    assert [r.name for r in s["field"].collect()] == ["F1"] and s["polarization"].count() == 2 and s["antenna"].count() == 4
    got = {(r.row_id, r.chan): (r.re, r.flag, r.weight) for r in s["vis"].filter("corr = 1").collect()}
    # Row 7: channels 1, 2 (2 flagged) and 3, 4; rows 6 and 3: channels 0, 1 and 2 alone (flagged).
    assert got == {(0, 0): (701.0, False, 2.0), (0, 1): (703.5, False, 9.0), (1, 0): (600.5, False, 3.0), (1, 1): (602.0, True, 3.0), (2, 0): (300.5, False, 3.0), (2, 1): (302.0, True, 3.0)}
    whole = transform.split(dataset)
    assert whole.main.count() == 8 and whole["vis"].count() == 80 and whole["field"].count() == 2 and whole["spectral_window"].count() == 3
    assert transform.split(dataset, keep_flags=False).main.count() == 6
    with pytest.raises(ValueError):
        transform.split(dataset, width=0)


def test_summaries(spark, dataset):
    found = summaries.listing(dataset)
    assert set(found) == {"info", "observations", "scans", "fields", "windows", "antennas", "polarizations", "data_descriptions"}
    s = {r.scan_number: r for r in found["scans"].collect()}
    one = s[1]  # rows 3, 4 (all flagged), 5 (flagged row)
    assert (one.n_rows, one.field_ids, one.field_names, one.data_desc_ids, one.window_ids, one.state_ids, one.intents, one.intervals, one.n_baselines) == (3, [0, 1], ["F0", "F1"], [0, 1, 2], [0, 1, 2], [0], ["A", "B"], [10.0] * 3, 2)
    assert (one.begin, one.end, one.unflagged) == (90.0, 102.0, pytest.approx(0.8))
    w = {r.name: r for r in found["windows"].collect()}
    assert (w["w0"].centre_frequency, w["w0"].min_frequency, w["w0"].max_frequency, w["w0"].bandwidth, w["w0"].data_desc_ids, w["w0"].correlations) == (1e9 + 2, 1e9, 1e9 + 4, 5.0, [2], ["XX", "YY"])
    assert w["w1"].correlations == ["RR", "type 99"]
    f = {r.name: (r.n_rows, r.unflagged) for r in found["fields"].collect()}
    assert f["F2"] == (0, 0.0) and f["F1"] == (4, pytest.approx(3.2)) and f["F0"][0] == 4
    assert {r.observer: (r.n_rows, r.begin) for r in found["observations"].collect()} == {"me": (8, 88.0), "you": (0, None)}
    a = {r.name: (r.n_rows, r.longitude) for r in found["antennas"].collect()}
    assert {k: v[0] for k, v in a.items()} == {"A0": 4, "A1": 8, "A2": 4, "A3": 0} and a["A0"][1] == pytest.approx(math.pi / 4)
    i = found["info"].first()
    assert (i.n_rows, i.elapsed, i.n_field, i.n_antenna) == (8, 17.0, 3, 4)
    u = summaries.uv_coverage(dataset, mirrored=True)
    assert u.count() == 14  # row 5 is flagged
    r = u.filter("row_id = 2 AND u > 0").first()
    assert (r.u, r.v) == pytest.approx((6 * (1e9 + 2) / 299_792_458, 4 * (1e9 + 2) / 299_792_458)) and r.spectral_window_id == 0


# ---- flags and reductions


def test_spectral_flags_against_plain_loops(spark):
    rng = random.Random(2)
    data = [(b, t, c, rng.gauss(0, 1) + (50 if (b, t, c) == (0, 3, 4) else 0), rng.gauss(0, 1), rng.random() < 0.1) for b in (0, 1) for t in range(8) for c in range(12)]
    data = [(*r[:3], r[3] * (1000 if r[1] == 7 else 1), *r[4:]) for r in data]
    d = spark.createDataFrame(data, "b int, t int, chan int, re double, im double, flag boolean").repartition(3)
    got = {(r.b, r.t, r.chan): r.flag for r in visibilities.rflag_spectral(d, ["b"], ["b", "t"], 5.0, low=0.0, high=100.0).collect()}
    median = lambda v: float(np.median(v))
    for b in (0, 1):
        far, means, whole = {}, {}, set()
        for t in range(8):
            good = [r for r in data if r[:2] == (b, t) and not r[5]]
            mr, mi = median([r[3] for r in good]), median([r[4] for r in good])
            spread = [1.4826 * median([abs(r[k] - m) for r in good]) for k, m in ((3, mr), (4, mi))]
            if max(spread) > 100:
                whole.add(t)
            for r in good:
                far[t, r[2]] = (abs(r[3] - mr), abs(r[4] - mi))
                means.setdefault(r[2], []).extend(far[t, r[2]])
        m = [sum(v) / len(v) for v in means.values()]
        top = 5 * (median(m) + 1.4826 * median([abs(x - median(m)) for x in m]))
        for r in data:
            if r[0] == b:
                want = r[5] or r[1] in whole or max(far[r[1], r[2]]) > top
                assert got[b, r[1], r[2]] == want, r
    assert got[0, 7, 0] and got[1, 7, 5]


def test_reductions_ignore_masks(spark):
    d = spark.createDataFrame([(0, i, float(v), i % 2 == 0) for i, v in enumerate([4.0, 1.0, 7.0, 2.0])] + [(1, 0, 3.0, False)], "z int, x int, value double, mask boolean")
    got = {r.z: r for r in lattice.reductions(d, ["z"], 0.25).collect()}
    assert {k: got[0][k] for k in ("nelem", "sum", "mean", "min", "max", "median", "fractile", "avdev")} == {"nelem": 4, "sum": 14.0, "mean": 3.5, "min": 1.0, "max": 7.0, "median": 2.0, "fractile": 1.0, "avdev": 2.0}
    assert got[0].variance == pytest.approx(7.0) and (got[1].variance, got[1].median) == (0.0, 3.0)
    whole = lattice.reductions(d).first()
    assert (whole.nelem, whole.median) == (5, 3.0)
    none = lattice.reductions(d.filter("false")).first()
    assert (none.nelem, none["sum"], none.median, none.stddev) == (0, 0.0, 0.0, 0.0)
    m = {r.z: (r.ntrue, r.nfalse, r.any, r.all) for r in lattice.mask_counts(d, ["z"]).collect()}
    assert m == {0: (2, 2, True, False), 1: (0, 1, False, False)}
    assert [r.value for r in lattice.replaced(d.filter("z = 0"), -1.0, ["z", "x"]).orderBy("x").collect()] == [4.0, -1.0, 7.0, -1.0]
    other = d.withColumn("value", F.col("value") * 10)
    assert [r.value for r in lattice.replaced(d.filter("z = 0"), other, ["z", "x"]).orderBy("x").collect()] == [4.0, 10.0, 7.0, 20.0]


def test_unequal_shapes_are_an_error(spark):
    a = spark.createDataFrame([(0, 1.0, True), (1, 2.0, True)], "x int, value double, mask boolean")
    assert lattice.joined(a, a.withColumn("mask", F.col("x") == 0), ["x"]).filter("mask").count() == 1
    for p, q in ((a, a.filter("x = 0")), (a.filter("x = 0"), a)):
        with pytest.raises(Exception, match="unequal shapes"):
            lattice.joined(p, q, ["x"]).collect()


def test_lines_and_profiles(spark):
    assert lattice.line_pixels((0, 0), (4, 1)) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)] and lattice.line_pixels((2, 2), (2, 2)) == [(2, 2)]
    assert lattice.line_pixels((3, 0), (2, -2)) == [(3, 0), (2, -1), (2, -2)]
    assert lattice.across((0, 0), (9, 0), 3) == [(0, -1), (0, 0), (0, 1)] and lattice.across((1, 1), (1, 1), 1) == [(0, 0)]
    d = spark.createDataFrame([(x, y, z, float(x + 10 * y + 100 * z)) for x in range(6) for y in range(4) for z in range(2)], "x int, y int, z int, value double")
    got = {(r.offset, r.z): r.value for r in lattice.line_profile(d, (0, 0), (5, 3), ["z"]).collect()}
    assert got == {(i, z): float(x + 10 * y + 100 * z) for i, (x, y) in enumerate(lattice.line_pixels((0, 0), (5, 3))) for z in range(2)}
    wide = {(r.offset, r.z): r.value for r in lattice.line_profile(d, (0, 0), (5, 0), ["z"], width=3).collect()}
    assert wide[2, 1] == (2 + 12) / 2 + 100 and len(wide) == 12
    t = spark.createDataFrame([(0, 0), (1, 1), (2, 3)], "x int, y int")
    plane = d.filter("z = 0").select("x", "y", "value", (F.col("x") != 2).alias("mask"))
    near = {(r.x, r.y): (r.value, r.mask) for r in lattice.regridded(plane, t, ("x", "y"), F.col("x") * 1.5, F.col("y") + 0.5, how="nearest").collect()}
    assert near == {(0, 0): (10.0, True), (1, 1): (22.0, False)}
    with pytest.raises(ValueError):
        lattice.regridded(plane, t, ("x", "y"), F.col("x"), F.col("y"), how="cubic")
