import re
from collections import Counter, defaultdict

import pytest

from spanglass.llm import divergence
from spanglass.llm.divergence import source_divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, value int, x string"


def brute(rows, min_docs=3, top=200):
    """Walks over all kept terms for every pair of groups."""
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        counts[lang, source].update(words(text))
        docs[lang].update(set(words(text)))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = {s: c for (la, s), c in counts.items() if la == lang}

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        shares, whole = {s: p(c) for s, c in groups.items()}, p(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in groups.items():
            pairs = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(shares[s][t], whole[t])) for t in kept if c[t] and shares[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(found[:most], 1)]
    return sorted(out)


ROWS = [
    ("The cat sat. THE CAT!", "en", "a"),
    ("the dog sat; the cat", "en", "a"),
    ("the dog ran", "en", "b"),
    ("the cat ran-ran 12 été", "en", "b"),
    ("dog dog dog été Été", "en", "c"),
    ("été sat", "en", "c"),
    ("", "en", "empty"),
    (None, "en", None),
    ("a b a b a b a b a b", "fr", "a"),
    ("b c", "fr", "b"),
    ("seul", None, "a"),
    ("x x", None, None),
    ("x", None, "é"),
    ("x y", None, "é"),
    ("x y 😀", None, "z"),
    ("😀 y 😀", None, "z"),
    ("😀", None, "z"),
] + [("tie tie one two three", "tt", s) for s in "aab"]


def table(spark, rows):
    return spark.createDataFrame([(1, *r, 5, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("cells", [2_000_000, 3])
def test_equals_a_walk_over_all_terms(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "_CELLS", cells)
    got = source_divergence(table(spark, ROWS).repartition(3))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(ROWS)


def test_parameters_and_passing_on_early(spark):
    got = source_divergence(table(spark, ROWS * 2), min_docs=2, top=1)
    assert sorted(map(tuple, got.collect())) == brute(ROWS * 2, 2, 1)


def test_no_documents(spark):
    assert source_divergence(table(spark, [])).collect() == []


def test_joint_histogram_holds_all_terms_once(spark):
    terms = divergence.term_counts(table(spark, ROWS)).cache()
    groups, histograms = divergence._groups(table(spark, ROWS), terms, "lang", "source")
    cells = divergence.joint_histograms(terms, groups, histograms).collect()
    sums, kept = Counter(), Counter(r.lang for r in terms.collect())
    for r in cells:
        assert r.n > 0
        sums[r.lang, r.a, r.b] += r.n
    assert {n == kept[k[0]] for k, n in sums.items()} == {True}
    assert (0, 0) in {(r.x, r.y) for r in cells}


def test_very_long_texts_are_cut_between_terms(monkeypatch):
    text = ("Ab c-dé " * 500).encode()
    whole = [w for words in divergence._terms(text) for w in words]
    monkeypatch.setattr(divergence, "_PIECE", 7)
    assert [w for words in divergence._terms(text) for w in words] == whole == ["ab".encode(), b"c", "dé".encode()] * 500


def test_counts_passed_on_early_are_summed(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["s"] * 4), pa.array(["a b", "b c b", "", "a"])], ["lang", "source", "text"])
    monkeypatch.setattr(divergence, "_ENTRIES", 1)
    n, docs = Counter(), Counter()
    for out in divergence._count(iter([batch])):
        for r in out.to_pylist():
            n[r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    assert n == {"a": 2, "b": 3, "c": 1} and docs == {"a": 2, "b": 2, "c": 1}
