import random

import numpy as np
import pytest

from spanglass.llm import components, ngram_join, queries

SF = "/root/testdata/sf0.01"


def brute(rows):
    """Every pair of sets, in the words of the contract."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([b" ".join(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op1_ngram_join"](spark, SF).select("doc_id", "n_shingles", "component_id").collect())
    want = brute(rows)
    assert got == want and len({c for _, _, c in want}) < len(want)


@pytest.mark.parametrize("block", [1024, 8])
def test_copies_at_all_sizes_and_distances(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    passage = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(60))  # many documents share it
    for size in (1, 3, 5, 7, 12, 30, 50, 55, 64, 120, 200, 230, 300, 900, 1000):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, max(1, size // 30), max(1, size // 20)])):
                at = rng.randrange(len(copy) + 1)
                copy[at : at + rng.randint(0, 1)] = [f"x{rng.randint(0, 10**6)}"] * rng.randint(0, 2)
            if rng.random() < 0.1:
                copy += passage.split()
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_edges(spark):
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "A b"), (2, "a\x0bB"), (8, "a b c d e f"), (8, "a b c d e f"), (7, "x y z " * 20_000), (6, "x  Y z " * 20_000), (1, "É b"), (10, "é b")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, sid int, n int")
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(docs).collect())
    assert got == brute(rows)
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    some = ngram_join.near_duplicates(spark.createDataFrame([(None, "a b"), (3, "a b"), (None, "c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in some) == [(0, 0), (0, 3), (3, 3)]


def test_links_through_rows_without_an_id(spark):
    words = [f"w{i}" for i in range(104)]
    a, n, b = " ".join(words), " ".join(words[:96] + ["x1"]), " ".join(words[:88] + ["x1"])
    rows = [(2, a), (None, n), (9, b), (None, "c d")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 2), (2, 2), (9, 2)]


@pytest.mark.parametrize("block", [4, 512])
def test_large_tiles_of_near_copies_and_of_a_shared_passage(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(3)
    base, passage = [f"w{i}" for i in range(100)], [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):  # a chain-like group: each copy differs from the base in one or two places, some in too many
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            copy[rng.randrange(100)] = f"x{rng.randint(0, 10**6)}"
        rows.append((len(rows), " ".join(copy)))
    for i in range(40):  # texts that share most, but not enough, and pairs of them that do link
        own = [f"y{i // 2}-{k}" for k in range(40)]
        rows.append((len(rows), " ".join(passage + own[: 40 - i % 2])))
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)


def test_one_of_each_tells_rows_of_one_id_apart(spark):
    t, u, v, w = ("q w e r t " + x for x in ("y u i o p", "a s d f g", "h j k l z", "x c v b n"))
    rows = [(1, t, 1), (5, t, 2), (5, u, 3), (6, v, 4), (6, w, 5), (6, w, 6), (None, u, 7), (None, "m n", 8), (7, None, 9), (7, None, 10), (8, "", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r.id if r.id != 6 else 5 for r in got.collect()) == [1, 3, 4, 5, 8, 9, 10, 11]
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for n in (10, 60, 200, 1000):
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        sets = [np.unique(np.r_[rng.permutation(base)[: n - c], rng.integers(0, 2**63, c).astype(np.uint64)]) for c in (0, n // 20, n // 12, n // 9, n // 5, n // 2)]
        k = ngram_join.band(n)
        bits = np.frombuffer(b"".join(ngram_join.bitmap(s, k) for s in sets), np.uint64).reshape(len(sets), -1)
        bound = ngram_join.overlap_bounds(bits, np.array([len(s) for s in sets]), slice(0, len(sets)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                assert bound[i, j] > 0 or not ngram_join.linked(a, b)
                both = len(np.intersect1d(a, b))
                assert bound[i, j] == 0 or bound[i, j] >= both / (len(a) + len(b) - both)


def test_components(spark):
    rng = random.Random(1)
    path = rng.sample(range(10**6), 300)
    edges = list(zip(path, path[1:])) + [(-1, -2), (-2, -1), (-3, -3)] + [(-10, -20 - i) for i in range(200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert len({got[p] for p in path}) == 1 and got[-1] == got[-2] and -3 not in got
    assert len({got[-20 - i] for i in range(200)} | {got[-10]}) == 1 and len(set(got.values())) == 3
