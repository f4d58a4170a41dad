import random
import re
import string

import corpus_pipeline as cp
from spanglass.llm import secrets
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_ngram_join import brute as classes

SF = "/root/testdata/sf0.001"


def test_each_stage_against_plain_definitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", None, None, 5)], docs.schema)
    a = cp.keep_known_language(spark, docs.unionByName(odd), SF)
    assert a.columns == docs.columns
    rows = a.collect()
    assert len(rows) >= 0.98 * docs.count() and not {10**6, 10**6 + 1} & {r.doc_id for r in rows}

    b = cp.keep_one_of_near_duplicates(spark, a.unionByName(a.limit(3)), SF).collect()
    assert sorted(r.doc_id for r in b) == [d for d, _, c in classes([(r.doc_id, r.text) for r in rows]) if d == c]

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    c = cp.drop_contaminated(spark, spark.createDataFrame(b, docs.schema), SF).collect()
    clean = [r.doc_id for r in b if (lambda n, h, _: h == 0 or 20 * h < n)(*hits(r.text, items))]
    assert sorted(r.doc_id for r in c) == sorted(clean)

    d = cp.redact_secrets(spark, spark.createDataFrame(c, docs.schema), SF).collect()
    assert len(d) == len(c) and all(r.n_chars == len(r.text) for r in d)
    assert not any(re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r.text) for r in d)

    e = cp.encode_pieces(spark, spark.createDataFrame(d, docs.schema), SF).collect()
    assert len(e) == len(d) and all(r.exact and r.n_tokens == len(r.token_ids) for r in e)


def test_run_is_all_stages(spark):
    out = cp.run(spark, SF)
    assert out.count() > 100 and {"doc_id", "token_ids"} <= set(out.columns)


def test_rare_secrets_are_redacted(spark):
    """A random string in one document of the whole table, among ordinary long names in others."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(5)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(64))
    names = [(10**6 + i, f"call get{i}UserAccountManagerServiceResponseHandlerCreateRequestBuilder{i} now", "en", "s", 0) for i in range(300)]
    mixed = docs.unionByName(spark.createDataFrame([*names, (10**7, f"note {key} end", "en", "s", 0)], docs.schema))
    got = {r.doc_id: r.text for r in cp.redact_secrets(spark, mixed, SF).filter("doc_id >= 1000000").collect()}
    assert got[10**7] == "note [secret] end" and all(got[d] == t for d, t, *_ in names)


def sized(path):
    """For mapInArrow: hands on batches and notes their bytes."""

    def note(batches):
        for b in batches:
            with open(path, "a") as f:
                f.write(f"{b.nbytes}\n")
            yield b

    return note


def test_texts_go_to_workers_in_small_batches(spark, tmp_path):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    docs = spark.createDataFrame([(i, "x" * 200_000, "en", "s", 200_000) for i in range(64)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        cp.redact_secrets(spark, docs.repartition(1), SF).mapInArrow(sized(str(tmp_path / "sizes")), docs.schema).count()
    finally:
        spark.conf.set(limit, before)
    sizes = list(map(int, (tmp_path / "sizes").read_text().split()))
    assert max(sizes) < 6_000_000 and sum(sizes) >= 64 * 200_000


def test_secrets_are_counted_in_small_batches(spark, tmp_path, monkeypatch):
    counts = secrets._counts
    monkeypatch.setattr(secrets, "_counts", lambda texts: counts(texts.mapInArrow(sized(str(tmp_path / "sizes")), "text string")))
    secrets.corpus_cutoffs(spark.createDataFrame([("x" * 200_000,)] * 64, "text string").repartition(1), "text", 0.05)
    sizes = list(map(int, (tmp_path / "sizes").read_text().split()))
    assert max(sizes) < 6_000_000 and sum(sizes) >= 64 * 200_000
