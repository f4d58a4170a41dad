import math
import random

import pytest
from pyspark.sql import functions as F

from spanglass.operators import ranks, statistics


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, x double").repartition(3)


def groups(rows):
    out = {}
    for k, x in rows:
        if x is not None:
            out.setdefault(k, []).append(x)
    return {k: sorted(v, key=lambda x: (math.isnan(x), x)) for k, v in out.items()}


def middle(v):
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    found = [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(900)]
    found += [("narrow", 1e9 + rng.random() * 1e-5) for _ in range(901)]
    found += [("near", 1.0 + rng.randrange(4000) * 2**-52) for _ in range(3000)]
    found += [("few", rng.choice([1.0, 2.0, 2.0, 7.0, -0.0, 0.0])) for _ in range(500)]
    found += [(None, rng.gauss(0, 1)) for _ in range(50)] + [("one", 3.5), ("none", None), ("two", 1.0), ("two", 2.0)]
    found += [("odd", x) for x in (float("inf"), float("-inf"), float("nan"), 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, None)]
    return found


@pytest.mark.parametrize("few", [100_000, 3])
def test_every_place_of_every_kind_of_group(spark, monkeypatch, rows, few):
    monkeypatch.setattr(ranks, "FEW", few)
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.77, "e": 1.0}
    got = ranks.at_places(table(spark, rows), ["k"], "x", {n: (lambda c, f=f: F.floor((c - 1) * F.lit(f))) for n, f in shares.items()})
    assert got.columns == ["k", "n", *shares]
    want = groups(rows)
    found = {r.k: r for r in got.collect()}
    assert set(found) == set(want)
    for k, v in want.items():
        assert found[k].n == len(v)
        for n, f in shares.items():
            a, b = found[k][n], v[math.floor((len(v) - 1) * f)]
            assert a == b or (math.isnan(a) and math.isnan(b)), (k, n)


def test_places_outside_a_group_and_no_rows(spark, rows):
    places = {"low": lambda n: F.lit(-1), "high": lambda n: n, "none": lambda n: F.lit(None), "last": lambda n: n - 1}
    for r in ranks.at_places(table(spark, rows), ["k"], "x", places).collect():
        assert (r.low, r.high, r.none) == (None, None, None) and r["last"] is not None
    assert ranks.medians(table(spark, []), ["k"], "x").collect() == []


def test_medians_halves_and_deviations(spark, rows):
    rows = [r for r in rows if r[0] not in ("odd", "wide")]
    want = groups(rows)
    d = table(spark, rows)
    assert {r.k: (r.n, r.median) for r in ranks.medians(d, ["k"], "x").collect()} == {k: (len(v), middle(v)) for k, v in want.items()}
    halves = {r.k: (r.q1, r.q3) for r in ranks.median_and_halves(d, ["k"], "x").collect()}
    assert halves == {k: (middle(v[: len(v) // 2]), middle(v[-(-len(v) // 2) :])) if len(v) > 1 else (0.0, 0.0) for k, v in want.items()}
    spread = {r.k: r.madfm for r in ranks.median_deviations(d, ["k"], "x").collect()}
    assert spread == {k: middle(sorted(abs(x - middle(v)) for x in v)) for k, v in want.items()}


def test_all_rows_together(spark):
    d = spark.range(64).select(F.col("id").cast("double").alias("x"))
    assert tuple(ranks.medians(d, [], "x").first()) == (64, 31.5)
    assert tuple(ranks.fractiles(d, [], "x", {"a": 0.25, "b": 0.75}).first()) == (64, 15.0, 47.0)
    assert tuple(ranks.median_deviations(d, [], "x").first()) == (31.5, 16.0)


def test_ranges_never_fall(spark):
    rng = random.Random(2)
    values = sorted([rng.choice([-1, 1]) * 2 ** rng.uniform(-1074, 1023.9) for _ in range(4000)] + [0.0, 1.0, math.nextafter(1, 0), math.nextafter(1, 2), 5e-324, -5e-324, float("inf"), float("-inf")])
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(ranks.coarse_range(F.col("x"))).collect()]
    assert got == sorted(got) and len(set(got)) > 3000


def test_no_plan_gathers_a_group(spark, rows):
    d = table(spark, rows)
    text = ranks.medians(d, ["k"], "x")._jdf.queryExecution().toString()
    assert "percentile" not in text and "collect_list" not in text and "median(" not in text


@pytest.mark.parametrize("use_flags", [True, False])
def test_calibration_report(spark, use_flags):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1), rng.random() < 0.2, rng.randrange(3), rng.randrange(2), rng.randrange(5), 0) for _ in range(300)]
    rows += [(1.0, 0.0, True, 9, 1, 1, 0), (None, 1.0, False, 1, 1, 1, 0), (2.0, 0.0, False, 8, 1, 1, 0)]
    d = spark.createDataFrame(rows, "g_re double, g_im double, flag boolean, field_id int, spectral_window_id int, antenna1 int, observation_id int")
    got = {(r.grouping, r.key): r for r in statistics.calibration_report(d, "amp", use_flags=use_flags).collect()}
    for i, name in ((None, "all"), (3, "field"), (4, "spw"), (5, "antenna"), (6, "observation")):
        for key in {None if i is None else r[i] for r in rows}:
            mine = [r for r in rows if r[0] is not None and (i is None or r[i] == key)]
            v = sorted(math.hypot(r[0], r[1]) for r in mine if not (use_flags and r[2]))
            if not v:
                assert (name, key) not in got
                continue
            r = got.pop((name, key))
            n, mean = len(v), sum(v) / len(v)
            q1, q3 = (middle(v[: n // 2]), middle(v[-(-n // 2) :])) if n > 1 else (0.0, 0.0)
            var = sum((x - mean) ** 2 for x in v) / n
            want = {"npts": n, "flagged_npts": sum(r[2] for r in mine), "total_npts": len(mine), "sum": sum(v), "sumsq": sum(x * x for x in v), "min": v[0], "max": v[-1], "mean": mean, "median": middle(v), "medabsdevmed": middle(sorted(abs(x - middle(v)) for x in v)), "q1": q1, "q3": q3, "quartile": q3 - q1, "var": var, "stddev": math.sqrt(var), "rms": math.sqrt(sum(x * x for x in v) / n)}
            assert {k: r[k] for k in want} == pytest.approx(want, abs=1e-12)
            assert len(want) == 16 and set(r.asDict()) == {*want, "grouping", "key"}
    assert not got


def test_report_sorts_groups_of_few_rows(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([1.5, -0.0, math.inf, math.nan]) if i % 9 == 0 else rng.gauss(0, 3), 0.0, rng.random() < 0.2, i % 3, 0, None if i % 7 == 0 else i % 80, 1) for i in range(400)]
    d = spark.createDataFrame(rows, "g_re double, g_im double, flag boolean, field_id int, spectral_window_id int, antenna1 int, observation_id int")
    report = lambda: sorted(map(str, statistics.calibration_report(d, "real").select("grouping", "key", "median", "q1", "q3", "medabsdevmed").collect()))
    counted, found = ranks.median_and_halves, []

    def noted(rows, *a):
        found.extend((r[0], r[1]) for r in rows.select("grouping", "key").distinct().collect())
        return counted(rows, *a)

    with monkeypatch.context() as m:
        m.setattr(ranks, "FEW", 60)
        m.setattr(ranks, "median_and_halves", noted)
        mixed = report()
    assert set(found) == {("all", None), ("field", 0), ("field", 1), ("field", 2), ("spw", 0), ("observation", 1)}
    monkeypatch.setattr(ranks, "median_and_halves", None)  # no group is counted in ranges
    assert report() == mixed and len(mixed) > 80
