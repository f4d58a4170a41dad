import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spanglass.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    counts = np.array([3, 1, 0, 4])
    e, moves = rng.random((8, 3)) + 0.05, rng.random((3, 3)) + 0.05
    got = np.zeros((8, 3))
    joint = np.zeros((3, 3))
    for at, m, _, alpha, following in language.forward_backward(e, counts, moves):
        got[at] = m
        j = alpha[:, :, None] * moves * following[:, None, :]
        joint += (j / j.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    want, pairs, start = np.zeros((8, 3)), np.zeros((3, 3)), 0
    for n in counts:
        total, part, pp = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.prod([e[start + i, k] for i, k in enumerate(path)]) * np.prod([moves[a, b] for a, b in zip(path, path[1:])])
            total += p
            for i, k in enumerate(path):
                part[i, k] += p
            for a, b in zip(path, path[1:]):
                pp[a, b] += p
        want[start : start + n] = part / total
        pairs += pp / total
        start += n
    assert np.allclose(got, want) and np.allclose(joint, pairs)
    assert np.allclose(language.marginal_sums(e, counts, moves)[3], want[4:].sum(axis=0))


def test_held_out_accuracy(spark):
    truth = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect())
    rows = queries.QUERIES["op5_language"](spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    kept = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in kept]) > 0.97


def test_words_of_code_switched_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit_language_model(docs)
    en, fr = ("the of and with from", "le la des est qui pour dans une")
    (lang, mixed), (score, part) = model.predict(pa.array([" ".join([en] * 8), " ".join([en] * 2 + [fr] * 5)]))
    lang, mixed = model.labels[lang], model.labels[mixed]
    assert (lang, mixed) == ("en", "fr") and score > 0.95 and 0.6 < part < 0.95


def test_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit_language_model(docs)
    odd = spark.createDataFrame([(1, None, 5), (1, "", 5), (2, "123 !!", 5), (2, "\u00b2 \u00bd \u2460", 5), (None, "the of", 5), (3, "the of and " * 40_000, 5)], "doc_id long, text string, language int")
    out = language.with_language(odd, model).select("doc_id", "language.*", language.held_out().alias("h")).collect()
    assert [r.lang for r in out] == ["und", "und", "und", "und", "en", "en"] and out[4].h is False
    assert language.words_of("5 m\u00b2 \u00e9t\u00e9_x") == ["m", "\u00e9t\u00e9", "x"]
    none = language.fit_language_model(docs.limit(0))
    assert none is None and {r.language.lang for r in language.with_language(odd, none).collect()} == {"und"}
    assert language.with_language(odd.limit(0), model).count() == 0


def test_no_label_is_left_out_of_training(spark):
    docs = spark.createDataFrame([(i, f"word{i % 70} text", f"l{i % 70}") for i in range(700)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 64 languages"):
        language.training_sample(docs)
    assert len({lang for _, lang in language.training_sample(docs, languages=70)}) == 70


def test_rows_of_one_id_are_a_sample_too(spark):
    one = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 5)
    docs = spark.createDataFrame([(one, f"alpha{i % 40} text", "a" if i % 2 else "b") for i in range(2000)], "doc_id long, text string, lang string")
    sample = language.training_sample(docs, per_language=100)
    assert [sum(lang == k for _, lang in sample) for k in "ab"] == [100, 100] and sample == language.training_sample(docs.repartition(7), per_language=100)
