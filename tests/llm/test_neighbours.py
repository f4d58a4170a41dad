import itertools

import numpy as np
from pyspark.sql import functions as F

from spanglass.llm import neighbours, queries

SF = "/root/testdata/sf0.01"


def brute(ids, x, asked, k):
    out = {}
    for q in asked:
        own = x[ids == q][0]
        s = (x * own).sum(axis=1)
        keep = np.flatnonzero(ids != q)
        order = keep[np.lexsort((ids[keep], -s[keep]))][:k]
        out[q] = [(int(ids[o]), float(s[o])) for o in order]
    return out


def recall(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(got.get(q, set()) & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_recall_and_scores_on_the_table(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in t]), np.array([r.embedding for r in t], np.float64)
    want = brute(ids, x, ids[ids % 20 == 0], 20)
    rows = queries.QUERIES["op2_neighbours"](spark, SF).collect()
    assert len(rows) == 20 * len(want) and recall(rows, want) >= 0.9
    at = {i: n for n, i in enumerate(ids)}
    for q in want:
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and all(r.vec_id != q for r in mine)
        assert [r.score for r in mine] == [float((x[at[q]] * x[at[r.vec_id]]).sum()) for r in mine]
        assert mine == sorted(mine, key=lambda r: (-r.score, r.vec_id))


def test_walk_is_in_order_and_whole():
    rng = np.random.default_rng(1)
    d1, d2 = rng.random(7), rng.random(5)
    cells = list(neighbours.cells_by_distance(d1, d2))
    assert sorted(cells) == sorted(itertools.product(range(7), range(5)))
    sums = [d1[i] + d2[j] for i, j in cells]
    assert sums == sorted(sums)


def test_a_full_walk_is_exact_with_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "QUERIES", 10)
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (400, 5)).astype(float)
    x[100:250] = x[100]
    x[~x.any(axis=1)] = 1
    data = [(i, v.tolist(), 1.5) for i, v in enumerate(x)]
    odd = [(900, None, 0.0), (920, [0.0] * 5, 0.0), (940, [1.0, None, 1.0], 0.0), (960, [float("nan")] * 5, 0.0), (980, [float("inf")] * 5, 0.0), (1000, [1.0], 0.0), (None, [1.0] * 5, 0.0)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, score double")
    got = neighbours.neighbours(df, F.col("vec_id") % 20 == 0, k=7, centroids=4, share=1.0).collect()
    want = brute(np.arange(400), x, np.arange(0, 400, 20), 7)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == {(q, i + 1, v, s) for q, w in want.items() for i, (v, s) in enumerate(w)}


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.neighbours(df, F.col("vec_id") == 0).collect()] == [(0, 1, 3, 4.0)]
    assert neighbours.neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_clustered_vectors_need_a_small_share_and_sizes_keep_recall(spark):
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(60, 16)) * 4
    shares = []
    for n in (1500, 6000):
        x = middles[rng.integers(0, 60, n)] + rng.normal(size=(n, 16)) * 0.3
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        rows = neighbours.neighbours(df, F.col("vec_id") % 50 == 0).collect()
        assert recall(rows, brute(np.arange(n), x, np.arange(0, n, 50), 20)) >= 0.9
        c = neighbours.centres(x[:, :8], 32, rng), neighbours.centres(x[:, 8:], 32, rng)
        shares.append(neighbours.measured_share(x, *c, 20, neighbours.RECALL))
    assert max(shares) < 0.3


def test_recall_on_a_second_table_size(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in t]), np.array([r.embedding for r in t], np.float64)
    assert recall(queries.QUERIES["op2_neighbours"](spark, "/root/testdata/sf0.1").collect(), brute(ids, x, ids[ids % 20 == 0], 20)) >= 0.9
