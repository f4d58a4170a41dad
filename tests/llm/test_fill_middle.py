import hashlib
import re

import pytest

from spanglass.llm import fill_middle
from spanglass.llm.fill_middle import fill_in_middle, restored

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["", None, "  \n", "one", " a b\tc\n", "x <P> y z", "<S>", "nul\x00 byte \x1c é", "a b 😀 <P <S", "word " * 400, "p<>q >M> S> P>", "q" * 5000 + " "]


def plain_form(doc_id, text, seed=42, plain_from=50, spm_below=80):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    w = TOKENS.findall(text)
    n = len(w)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_from:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(w[:i]), "".join(w[i:j]), "".join(w[j:])
    if h4 % 100 < spm_below:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


@pytest.mark.parametrize("most", [8_000_000, 1])
def test_equals_plain_python(spark, monkeypatch, most):
    monkeypatch.setattr(fill_middle, "_BATCH_BYTES", most)
    rows = [(None if i % 37 == 0 else i * 7 % 150, ODD[i % len(ODD)], "k", i) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string, i int").repartition(3)
    for args in ({}, {"seed": 7, "plain_from": 95, "spm_below": 30}):
        out = restored(fill_in_middle(docs, **args)).collect()
        assert len(out) == len(rows) and {r.form for r in out} == {"plain", "psm", "spm"}
        for r in out:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_form(r.doc_id, r.text, **args)
            assert r.restored == (r.text or "") and r.row == "k"


def test_shares_of_the_forms(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'some words to cut' AS text")
    n = {r.form: r["count"] for r in fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(n["plain"] - 2000) < 150 and abs(n["spm"] - 1600) < 150 and abs(n["psm"] - 400) < 80


def test_kept_columns_clashes_and_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, n int")
    with pytest.raises(ValueError, match="there already"):
        fill_in_middle(docs)
    out = fill_in_middle(docs, keep=["doc_id"])
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and out.collect() == []


def test_other_forms_and_null_outputs(spark):
    rows = spark.createDataFrame([(None, "psm"), ("x", "other"), ("x", None), ("<S>c<P>a<M>b", "spm")], "output string, form string")
    assert [r.restored for r in restored(rows).orderBy("restored").collect()] == [None, None, None, "abc"]
