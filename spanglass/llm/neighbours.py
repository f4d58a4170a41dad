"""Approximate nearest neighbours by inner product, with an inverted multi-index.

The vectors' two halves are quantised separately, so ``centroids`` centres for each half make a
grid of centroids x centroids cells.  A query walks the cells in order of their summed distance
(the negative inner products of its halves with the cell's two centres) with a heap, until the cells
hold a given share of all rows, and the rows in those cells are ranked by their exact inner
product.

The share is measured, not set: on the sample, it is what brings a share ``recall`` of the sampled queries' nearest rows
into the cells walked.  On clustered vectors that is a small part of the table; on directions drawn at random, where nearest rows
by a summed distance are spread over many cells, it is more than half.

The centres come from a bounded sample of ``SAMPLE`` rows (a hash order's first); every row
is indexed.  The number of rows in each cell (centroids ** 2 numbers), and of queries that walk into each first-half
centre's cells, are the only other things that reach the driver.  Rows of one first-half centre are cut into blocks of about
``BLOCK`` and the queries that walk there into blocks of about ``QUERIES``, so that a group of equal or near
vectors is spread and what a task holds is bounded.  A row is sent once for each such block of queries, a query once for each block of rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanglass.llm.shared import table_of

CENTROIDS = 32
RECALL = 0.94
SAMPLE = 20_000
PROBES = 200  # sampled queries that the share is measured with
BLOCK = 16_384
QUERIES = 8192
ROUNDS = 12
_SLICE = 256  # queries whose products with a block are held at once


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's iterations from distinct sampled points; at most k centres."""
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, c)
        for j in range(len(c)):
            if (own := x[near == j]).size:
                c[j] = own.mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)


def cells_by_distance(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centres by d1 + d2, from small: the multi-sequence walk over the two sorted lists."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b, o1, o2 = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
    heap, reached = [(a[0] + b[0], 0, 0)], [0] * len(a)  # how many of each row of the grid were pushed
    reached[0] = 1
    while heap:
        _, i, j = heapq.heappop(heap)
        yield o1[i], o2[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


def probed(q: np.ndarray, c1: np.ndarray, c2: np.ndarray, sizes: np.ndarray, enough: int) -> dict[int, list[int]]:
    """First-half centre -> second-half centres of the cells that a query looks at."""
    out: dict[int, list[int]] = {}
    half, seen = c1.shape[1], 0
    for i, j in cells_by_distance(-(c1 @ q[:half]), -(c2 @ q[half:])):
        if n := int(sizes[i, j]):
            out.setdefault(i, []).append(j)
            seen += n
            if seen >= enough:
                break
    return out


def measured_share(x: np.ndarray, c1: np.ndarray, c2: np.ndarray, k: int, recall: float) -> float:
    """The share of rows that a walk has to cover so that it meets a share ``recall`` of the nearest k of sampled queries."""
    half = c1.shape[1]
    cell = nearest(x[:, :half], c1) * len(c2) + nearest(x[:, half:], c2)
    sizes = np.bincount(cell, minlength=len(c1) * len(c2))
    met = []
    for i in range(min(PROBES, len(x))):
        product = x @ x[i]
        product[i] = -np.inf
        near = np.argsort(-product, kind="stable")[: min(k, len(x) - 1)]
        order = np.argsort(-((c1 @ x[i][:half])[:, None] + (c2 @ x[i][half:])[None, :]).ravel(), kind="stable")
        covered = np.empty(len(sizes))
        covered[order] = np.cumsum(sizes[order]) / len(x)
        met.append(covered[cell[near]])
    return float(np.quantile(np.concatenate(met), recall)) if len(x) > 1 else 1.0


def matrix(column, width: int, kind=np.float64) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def best(q: np.ndarray, own: int, v: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int) -> list[tuple[float, int]]:
    """The k nearest with exact scores; all rows within rounding of the k-th take part, so ties go by id."""
    rough = np.where(ids == own, -np.inf, rough)
    if len(rough) > k:
        kth = np.partition(rough, len(rough) - k)[len(rough) - k]
        at = np.flatnonzero((rough >= kth - 1e-9 * max(1.0, abs(kth))) & (rough > -np.inf)) if kth > -np.inf else np.flatnonzero(rough > -np.inf)
    else:
        at = np.flatnonzero(rough > -np.inf)
    score = (v[at] * q).sum(axis=1)
    order = np.lexsort((ids[at], -score))[:k]
    return [(float(score[o]), int(ids[at][o])) for o in order]


def neighbours(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, centroids: int = CENTROIDS, recall: float = RECALL, share: float | None = None, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``is_query`` holds.

    ``share`` is the part of all rows that each query looks at; left out, it is measured for a recall of ``recall``.

    Candidates are all rows but those with the query's own id.  Vectors that are null, zero or hold null or
    non-finite components take no part, nor do rows without an id, nor vectors of another length than the
    sample's most common.  Equal scores go to the smaller id.  Rows repeated with the same id are candidates each
    and, as queries, count once.  An empty table gives no rows.  Further columns are ignored.
    """
    spark = vectors.sparkSession
    d = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    d = d.filter(usable(F.col("v")) & F.col("id").isNotNull())
    sample = [r.v for r in d.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width = Counter(map(len, sample)).most_common(1)[0][0]
    x = np.array([v for v in sample if len(v) == width])
    half = max(1, width // 2)
    rng = np.random.default_rng(seed)
    grid = spark.sparkContext.broadcast((centres(x[:, :half], centroids, rng), centres(x[:, half:], centroids, rng)))
    if share is None:
        share = measured_share(x, *grid.value, k, recall)
    d = d.filter(F.size("v") == width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c1, c2 = grid.value
        for b in batches:
            m = matrix(b.column("v"), width)
            parts = [nearest(m[:, :half], c1), nearest(m[:, half:], c2)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("asks"), *(pa.array(p.astype(np.int32)) for p in parts)], ["id", "v", "asks", "c1", "c2"])

    entries = d.mapInArrow(assign, "id bigint, v array<double>, asks boolean, c1 int, c2 int")
    sizes = np.zeros((len(grid.value[0]), len(grid.value[1])), np.int64)
    for r in entries.groupBy("c1", "c2").count().collect():  # one number for each cell
        sizes[r.c1, r.c2] = r["count"]
    n_queries = d.filter("asks").count()
    blocks = [max(1, -(-int(n) // BLOCK)) for n in sizes.sum(axis=1)]
    cells = spark.sparkContext.broadcast(sizes)
    enough = max(2 * k, int(np.ceil(share * sizes.sum())))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c1, c2 = grid.value
        for b in batches:
            m, ids = matrix(b.column("v"), width), b.column("id").to_pylist()
            for start in range(0, len(ids), 256):
                rows = []
                for i in range(start, min(len(ids), start + 256)):
                    for first, seconds in probed(m[i], c1, c2, cells.value, enough).items():
                        rows += [(ids[i], m[i], first, seconds, block) for block in range(blocks[first])]
                if rows:
                    q, v, first, seconds, block = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.list_(pa.float64())), pa.array(first, pa.int32()), pa.array(seconds, pa.list_(pa.int32())), pa.array(block, pa.int32())], ["query_id", "q", "c1", "c2s", "block"])

    def of(n, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n) if isinstance(n, int) else n).cast("int")

    asked = d.filter("asks").dropDuplicates(["id"]).repartition(max(1, min(20_000, n_queries // _SLICE)), "id")
    planned = table_of(asked.mapInArrow(plan, "query_id bigint, q array<double>, c1 int, c2s array<int>, block int"), "planned")
    query_blocks = [0] * len(blocks)
    for r in planned.filter("block = 0").groupBy("c1").count().collect():  # one number for each first-half centre
        query_blocks[r.c1] = -(-r["count"] // QUERIES)
    at_c1 = lambda n: F.element_at(F.array(*map(F.lit, n)), F.col("c1") + 1)
    queries = planned.withColumn("qblock", of(at_c1(query_blocks), "query_id"))
    entries = entries.withColumn("qblocks", at_c1(query_blocks)).filter("qblocks > 0")
    held = entries.select("id", "v", "c1", "c2", of(at_c1(blocks), "id").alias("block"), F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)).alias("qblock"))

    def rerank(asks: pa.Table, rows: pa.Table) -> pa.Table:
        out: list = []
        if len(asks) and len(rows):
            q, v = matrix(asks.column("q"), width), matrix(rows.column("v"), width)
            ids, c2 = rows.column("id").to_numpy(), rows.column("c2").to_numpy()
            asked, seconds = asks.column("query_id").to_pylist(), asks.column("c2s").to_pylist()
            for start in range(0, len(q), _SLICE):
                rough = q[start : start + _SLICE] @ v.T
                for i in range(start, start + len(rough)):
                    look = np.zeros(len(grid.value[1]), bool)
                    look[seconds[i]] = True
                    out += [(asked[i], vec, score) for score, vec in best(q[i], asked[i], v, ids, np.where(look[c2], rough[i - start], -np.inf), k)]
        own, vec, score = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(own, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    group = ["c1", "block", "qblock"]
    found = queries.groupBy(*group).cogroup(held.groupBy(*group)).applyInArrow(rerank, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
