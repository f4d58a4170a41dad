import re
import textwrap

import duckdb
import pytest

from spanglass.llm import licenses, queries

SF = "/root/testdata/sf0.001"


def brute(rows, templates, t=licenses.THRESHOLD):
    def grams(s):
        w = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), s))
        return frozenset(zip(w, w[1:]))

    out = {}
    for i in {r[0] for r in rows}:
        segments = set()
        for text in [r[1] or "" for r in rows if r[0] == i]:
            parts = re.split("[\r\n]+", text)
            segments |= {grams(s) for s in (*parts, text)}
        for name, body in templates.items():
            of = grams(body)
            dice = [2 * len(of & s) / (len(of) + len(s)) for s in segments if of and s]
            if dice and max(dice) >= t:
                out[i, name] = (max(dice), sum(d >= t for d in dice))
    return out


def test_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = {(a, b): (c, d) for a, b, c, d in con.sql(f"SELECT doc_id, license, dice, n_segments FROM ({queries.ORACLE['op4_licenses']})").fetchall()}
    got = {(r.doc_id, r.license): (r.dice, r.n_segments) for r in queries.QUERIES["op4_licenses"](spark, SF).collect()}
    rows = con.sql("SELECT doc_id, text FROM documents").fetchall()
    assert got == sql == brute(rows, licenses.TEMPLATES) and got


MIT = licenses.TEMPLATES["MIT"]


def test_edges_equal_brute_force(spark):
    rows = [(1, None), (1, ""), (2, MIT), (2, MIT), (3, MIT.replace(". ", ".\n").upper()), (4, MIT + " word" * 90), (5, "x" * 100_000 + "\nAll rights reserved"), (6, "ALL, rights... RESERVED\n\nall rights reserved!"), (7, "one"), (8, MIT[: len(MIT) * 2 // 3]), (9, "İ all Kings rights reserved")]
    docs = spark.createDataFrame([(i, t, "n", "g") for i, t in rows], "doc_id long, text string, n string, gram string")
    got = {(r.doc_id, r.license): (r.dice, r.n_segments) for r in licenses.license_matches(docs).collect()}
    assert got == {k: (pytest.approx(v[0]), v[1]) for k, v in brute(rows, licenses.TEMPLATES).items()} and len(got) >= 5


def test_empty_inputs_and_size_check(spark):
    docs = spark.createDataFrame([(1, MIT)], "doc_id long, text string")
    assert licenses.license_matches(docs.limit(0)).count() == 0
    assert licenses.license_matches(docs, templates={"none": "?"}).count() == 0
    with pytest.raises(ValueError, match="template bigrams"):
        licenses.license_matches(docs, templates={"big": " ".join(map(str, range(licenses.MAX_TEMPLATE_BIGRAMS + 9)))})


def wrapped(text, width=72):
    return "\n".join(textwrap.wrap(text, width))


def best_run(text, body):
    def grams(w):
        return set(zip(w, w[1:]))

    lines = [re.findall("[a-z0-9]+", x.lower()) for x in text.split("\n")]
    of = grams(re.findall("[a-z0-9]+", body.lower()))
    runs = [grams(sum(lines[i:j], [])) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)]
    return max(2 * len(of & g) / (len(of) + len(g)) for g in runs if g)


def test_licences_over_several_lines_of_longer_documents_are_found(spark):
    prose = "\n".join(f"Line {i} of the story says what a person of the town did under the bridge, and who is free to go." for i in range(40))
    mit = "Permission is".join(wrapped(p) for p in MIT.split("Permission is", 1)).replace("conditions:", "conditions:\n\n").replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    apache = "\n".join(f" * {x}" for x in wrapped(licenses.TEMPLATES["Apache-2.0"], 60).split("\n"))
    full = [licenses.TEMPLATES[k] for k in ("BSD-2-Clause", "Unlicense")]
    inside = [mit, apache, *map(wrapped, full), wrapped("Nobody may copy a permission of the software. " * 9)]
    texts = [f"{prose}\n\n{x}\r\n{prose}" for x in inside] + [f"{prose}\n{mit}\n{prose}\n{mit}"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])], "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.dice, r.n_segments) for r in licenses.license_matches(docs).collect()}
    names = {0: "MIT", 1: "Apache-2.0", 2: "BSD-2-Clause", 3: "Unlicense", 5: "MIT", None: "Apache-2.0"}
    parts = {(2, "BSD-2-Clause-conditions"), (3, "Unlicense-notice"), (1, "Apache-2.0-notice"), (None, "Apache-2.0-notice"), (2, "BSD-3-Clause")}  # their words are in the longer ones, or most of theirs in them
    assert set(got) == set(names.items()) | parts
    for (i, name), (dice, n) in got.items():
        assert dice == pytest.approx(best_run(texts[1 if i is None else i], licenses.TEMPLATES[name])) and n == (2 if i == 5 else 1)
