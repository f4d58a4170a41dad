import random
from collections import defaultdict

import pytest

from spanglass.llm import queries, repeats

SF = "/root/testdata/sf0.001"


def brute(rows, size=50):
    """Every passage of 50 words of every text."""
    holders, texts = defaultdict(set), []
    for d, text in rows:
        w = (text or "").encode().lower().split()
        texts.append((d, w))
        for i in range(len(w) - size + 1):
            holders[tuple(w[i : i + size])].add(d)
    spans = defaultdict(set)
    for d, w in texts:
        for i in range(len(w) - size + 1):
            if len(of := holders[tuple(w[i : i + size])]) > 1:
                spans[d].add((i, i + size, min(of)))
    out = []
    for d, of in spans.items():
        merged = []
        for a, b, first in sorted(of):
            if merged and a <= merged[-1][1]:
                merged[-1] = [merged[-1][0], max(b, merged[-1][1]), min(first, merged[-1][2])]
            else:
                merged.append([a, b, first])
        out += [(d, a, b, b - a, first) for a, b, first in merged]
    return sorted(out)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op8_repeats"](spark, SF).collect())
    assert got == brute(rows) and len(got) > 5


@pytest.mark.parametrize("hot", [4096, 3])
def test_planted_passages(spark, hot):
    rng = random.Random(hot)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 64, 120, 300)] + [["a"] * 70, ["a", "b"] * 40]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [word() for _ in range(rng.randint(0, 80))]
            p = rng.choice(passages)
            text += p[rng.randint(0, 3) : len(p) - rng.randint(0, 3)]
        rows.append((i, " ".join(text)))
    rows += [(70, rows[3][1]), (71, None), (72, ""), (73, " ".join(passages[5] * 2))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, key int")
    assert sorted(tuple(r) for r in repeats.repeated_passages(docs, hot=hot).collect()) == brute(rows)


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (1, long), (None, long), (2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats.repeated_passages(docs).count() == 0  # one id, and no id
    assert repeats.repeated_passages(docs.limit(0)).count() == 0
    more = docs.unionByName(spark.createDataFrame([(3, "y\t" + long.upper())], "doc_id long, text string"))
    assert sorted(tuple(r) for r in repeats.repeated_passages(more).collect()) == [(1, 0, 60, 60, 1), (3, 1, 61, 60, 1)]


def test_texts_are_cut_once_more_where_starts_are_hot(spark, monkeypatch):
    cuts, suffixes = [], repeats.suffixes
    monkeypatch.setattr(repeats, "suffixes", lambda *a: cuts.append(1) or suffixes(*a))
    long = " ".join(f"v{i}" for i in range(90))
    docs = spark.createDataFrame([(i, long) for i in range(6)], "doc_id long, text string")
    assert sorted(tuple(r) for r in repeats.repeated_passages(docs, hot=3).collect()) == [(i, 0, 90, 90, 0) for i in range(6)]
    assert len(cuts) == 1
