import io
import math
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanglass.llm import queries, token_files
from spanglass.llm.memory import give_back
from spanglass.llm.token_files import EliasFano, documents_in, encode_file, read_token_files, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
CODER, WHOLE = token_files.Encoder(PATH, 2, True), Tokenizer.from_file(PATH)
ODD = [(5, "Hello woŕld\tx"), (5, "again 5"), (5, "again 5"), (None, "no id"), (None, None), (2**62, "far 😀 ΑΣ ΑΣ"), (-7, ""), (0, " \n "), (1, "a" * 3000 + " b\x0bc\x1cd\x85e"), (2, "<|endoftext|> it's <|END|>"), (3, "e ́ x\ny\r\nz")]


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 2]


@given(st.lists(st.integers(0, 2**40) | st.integers(0, 50), max_size=900), st.data())
@settings(max_examples=60, deadline=None)
def test_lists_come_back_from_any_place(values, data):
    values.sort()
    coded = EliasFano.encode(np.array(values, np.uint64))
    held = EliasFano.decode(coded)
    assert held.values(0, len(values)).tolist() == values
    if values:
        a = data.draw(st.integers(0, len(values) - 1))
        b = data.draw(st.integers(a, len(values)))
        assert held.values(a, b).tolist() == values[a:b] and held.select(a) == values[a]


def test_lists_take_little_space():
    values = np.cumsum(np.random.default_rng(1).integers(1, 3000, 200_000)).astype(np.uint64)
    bits = 8 * len(EliasFano.encode(values)) / len(values)
    assert bits <= 2 + math.log2(int(values[-1]) / len(values)) + 32 / token_files.EVERY + 0.1 < 14


def test_documents_of_a_file(spark):
    parts = [np.arange(k * 10, k * 10 + k, dtype="<u2") for k in range(1, 40)]
    names = [None, None, *range(-5, 32)]
    data = encode_file(names, np.array([len(p) for p in parts]), b"".join(p.tobytes() for p in parts), 2)
    for a, b, most in ((0, 39, 10**6), (0, 39, 1), (1, 5, 30), (38, 39, 9)):
        got = []
        for ids, bounds, flat in documents_in(io.BytesIO(data), a, b, most):
            got += [(i, flat[x - bounds[0] : y - bounds[0]].tolist()) for i, x, y in zip(ids, bounds, bounds[1:], strict=False)]
        assert got == [(names[k], parts[k].tolist()) for k in range(a, b)]


@pytest.mark.parametrize(("file_bytes", "read_bytes"), [(64_000_000, 16_000_000), (60, 20)])
@pytest.mark.parametrize("words", [True, False])
def test_files_hold_all_documents_in_order(spark, tmp_path, file_bytes, read_bytes, words):
    docs = spark.createDataFrame([(*r, 1, "y") for r in ODD], "doc_id bigint, text string, start int, n_tokens string").repartition(3)
    manifest = write_token_files(docs, f"file://{tmp_path}/x", PATH, end_id=2, words=words, file_bytes=file_bytes)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(ODD) and (manifest.count() > 3) == (file_bytes == 60)
    rows = sorted(read_token_files(spark, manifest, read_bytes=read_bytes).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in ODD), key=lambda d: (d is not None, d))
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in rows) == sorted(ids_of(t) for _, t in ODD)


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert read_token_files(spark, write_token_files(docs, f"file://{tmp_path}/x", PATH, end_id=2)).collect() == []


def test_query_equals_the_library_on_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    at, want = 0, []
    for r in rows:
        ids = ids_of(r.text)
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op12_token_files(spark, sf).collect())) == want


@pytest.mark.parametrize("known", [400_000, 3])
def test_words_in_any_script_equal_whole_texts(monkeypatch, known):
    monkeypatch.setattr(token_files, "_KNOWN", known)
    coder = token_files.Encoder(PATH, 2, True)
    texts = [t for _, t in ODD] + [
        "It's IT'S don't 'song rock'n'roll we'll", "ÀÉÎ ÿÿ ßS STRASSE ǅ ſt ﬁn", "e\u0301t x\u0301y a\u0308", "12.5% 3rd H2O x² ½a ªb ºc Ⅷ", "<|endoftext|>a b<|startoftext|> <|x", "a-b_c@d.com http://x.y/z?q=1&r=2", "жa aж a\u200bb 日本語abc", "the the THE The", "x" * 1500, "---...!!! (a) [b]",
        "K \u212a İ I\u0307", "\xa0a\xa0b\x85c\u3000d", "",
    ]
    for part in (texts, texts[::-1], [t for t in texts for _ in (0, 1)]):
        assert [np.frombuffer(b, "<u2").tolist() for b in coder.encode(part)] == [ids_of(t) for t in part]
    assert all(len(w) <= 200 for w in coder.known)


@given(st.lists(st.text(st.sampled_from("aA eéÉ'sSt1²½.,<|>-_\u0301\u200bßж\n日") | st.characters(max_codepoint=0x2FF), max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_random_texts_equal_whole_texts(texts):
    assert [np.frombuffer(b, "<u2").tolist() for b in CODER.encode(texts)] == [[*WHOLE.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_blanks_are_no_parts():
    texts = ["One, two. one, (two) 3.5% x-y", "\tOne,  two.\n", ""]
    coder = token_files.Encoder(PATH, 2, True)
    assert [np.frombuffer(b, "<u2").tolist() for b in coder.encode(texts)] == [ids_of(t) for t in texts]
    assert coder._parts(texts[1]) == ["one", ",", "two", "."] and coder._parts("a 3 'b  c") == ["a", "3", "\0'b", "c"]


@given(st.lists(st.none() | st.text(st.sampled_from("aA eéÉ'×÷ßK.,<|>-_\x01\0\u0301\u200bÿŸİж\r\n\t\x0b\x85\xa0日😀") | st.characters(max_codepoint=0x2FF), max_size=30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_parts_found_by_arrow_equal_the_plain_definition(texts):
    CODER.forget()
    at, counts = CODER._numbered(texts)
    name = {n: w.decode() for w, n in CODER.known.items()}
    ends = counts.cumsum().tolist()
    assert [[name[k] for k in at[e - n : e].tolist()] for e, n in zip(ends, counts.tolist(), strict=True)] == [CODER._parts(t or "") for t in texts]
    CODER.forget()


def test_known_words_take_less_time_than_a_search_by_pattern():
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, w)) for w in rng.integers(97, 123, (60_000, 7)).tolist()]
    texts = [", ".join(words[k] for k in rng.integers(0, len(words), 300)) + "." for _ in range(1200)]
    coder, took, numbers = token_files.Encoder(PATH, 2, True), {}, {}

    def by_pattern():
        for t in texts:
            for part in token_files._PARTS.findall(t.lower()):
                numbers.setdefault(part, len(numbers))

    for f in (by_pattern, lambda: list(coder.encode(texts))):
        f()
        times = []
        for _ in range(3):
            began = time.process_time()
            f()
            times.append(time.process_time() - began)
        took[f.__name__] = min(times)
    assert took["<lambda>"] < took["by_pattern"], took


def test_many_tasks_of_a_worker_leave_little_memory():
    def anonymous_mb():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(line.split()[1]) / 1024 for line in f if line.startswith("Pss_Anon"))

    rng = np.random.default_rng(3)
    text = " ".join("".join(map(chr, w)) for w in rng.integers(97, 123, (20_000, 9)).tolist())
    held = []
    for _ in range(12):
        coder = token_files.encoder_of(PATH, 2, True)
        assert not coder.known and len(list(coder.encode([text]))) == 1
        del coder
        give_back()
        held.append(anonymous_mb())
    assert held[-1] - held[1] < 25
