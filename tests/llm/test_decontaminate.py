import hashlib
import re

import pytest
from pyspark.sql import functions as F

from spanglass.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def brute(text, items, size=13):
    """Per word and window, without an automaton."""
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    cut = lambda s: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(s))
    words, hit, found = cut(text), set(), []
    for item, t in items:
        w = cut(t)
        wins = [w[i : i + size] for i in range(max(1, len(w) - size + 1))] if w else []
        n = len(hit), False
        got = False
        for win in wins:
            for i in range(len(words) - len(win) + 1):
                if words[i] == win[0] and words[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    got = True
        if got:
            found.append(str(item))
    return len(words), len(hit), sorted(found)


def test_query_equals_brute_force(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.QUERIES["op10_decontaminate"](spark, SF).collect()
    assert len(rows) == len(texts)
    hits = 0
    for r in rows:
        n, h, found = brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items) == (n, h, len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == (h > 0 and 20 * h >= n)
        hits += h > 0
    assert hits >= 3


DOCS = [(1, "One, TWO three. x"), (1, "One, TWO three. x"), (2, None), (3, ""), (4, "É one two  three é" + " w" * 30000), (5, "one two threes")]


@pytest.mark.parametrize("block_bytes", [10**6, 1])
def test_edges_and_blocks(spark, block_bytes):
    docs = spark.createDataFrame([(i, t, 7) for i, t in DOCS], "doc_id long, text string, n_words int")
    items = spark.createDataFrame([(7, "one two, three"), (7, "one two, three"), (8, None), (9, "..."), (10, "two three x"), (11, "É ONE")], "item_id int, text string")
    out = decontaminate.contamination(docs, items, into="s", block_bytes=block_bytes).select("doc_id", "text", F.col("n_words").alias("own"), "s.*").collect()
    assert len(out) == len(DOCS) and all(r.own == 7 for r in out)
    pairs = [(7, "one two, three"), (10, "two three x"), (11, "É ONE")]
    for r in out:
        n, h, found = brute(r.text, pairs)
        assert (r.n_words, r.n_hit, sorted(set(r["items"]))) == (n, h, found)
        for s in r.spans:
            assert decontaminate.folded_words(r.text[s.start : s.end]) and not r.text[s.start - 1 : s.start].isalnum()


def test_blocks_give_what_one_automaton_gives(spark):
    docs = spark.createDataFrame([(i, t) for i, t in DOCS] + [(9, "a one two three x y one two, a three x")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "x y"), (7, "one two"), (8, "two three x"), (9, "three x")], "item_id int, text string")
    one, many = (sorted((r.doc_id, r.text or "", r.s) for r in decontaminate.contamination(docs, items, into="s", block_bytes=b).collect()) for b in (10**6, 1))
    assert one == many and any(len(s.spans) == 2 for _, _, s in one) and all("None" not in s["items"] for _, _, s in one)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.contamination(docs, items).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.contamination(one, items).select("contamination.n_hit").first()[0] == 0
