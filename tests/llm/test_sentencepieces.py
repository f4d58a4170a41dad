import hashlib
import random
import time
import zlib

import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from spanglass.llm import queries, sentencepieces

SF = "/root/testdata/sf0.001"
BLOB = open(queries.MODEL, "rb").read()
ODD = ["", " ", "  a  b ", "\n\n x", "日本語 テスト 😀😀 zß", "\t", "   ", "a" * 300, " x", "ab\ncd  ef \n", "é" * 50, "​x", "naïve café!!! 12345"]


def altered(**trainer):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(BLOB)
    for k, v in trainer.items():
        setattr(proto.trainer_spec, k, v)
    return proto


def random_texts():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdeéß \n.,▁tion "[: 15]) for _ in range(rng.randint(0, 60))).replace("▁", " ") for _ in range(400)]


def test_bpe_equals_library():
    own, ref = sentencepieces.Model.load(BLOB), sentencepiece.SentencePieceProcessor(model_proto=BLOB)
    texts = ODD + random_texts()
    got = own.encode(texts).to_pylist()
    assert got == ref.encode(texts)
    assert [own.decode(g) for g in got] == texts == [ref.decode(g) for g in got]


def test_unigram_equals_library():
    proto = altered(model_type=1)
    for p in proto.pieces:  # scores without ties, as log probabilities are
        p.score = -5 - (zlib.crc32(p.piece.encode()) % 9973) / 997 - 0.1 / len(p.piece) if p.type == 1 else p.score
    blob = proto.SerializeToString()
    own, ref = sentencepieces.Model.load(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    for text in [t for t in ODD + random_texts() if len(t) < 200]:
        got, want = own.encode([text]).to_pylist()[0], ref.encode(text)
        score = lambda ids: sum(own.scores[k] for k in ids)
        assert got == want or abs(score(got) - score(want)) < 1e-4, text
        assert own.decode(got) == text


def test_levels_equal_the_walk_word_by_word(monkeypatch):
    rng, own = random.Random(2), sentencepieces.Model.load(BLOB)
    syllables = ["th", "er", "ing", "▁", "é", "tion", "ß", ".", "$$$", "日本", "\u200b", "😀", "a", "12", "ent", "\ud7ff", "qq"]
    words = sorted({"".join(rng.choices(syllables, k=rng.randint(1, 9))) for _ in range(60_000)})
    plain, counts = own.walk_words(words)
    for chars, pairs in ((sentencepieces._LEVEL_CHARS, 1_000_000), (5000, 2000)):
        monkeypatch.setattr(sentencepieces, "_LEVEL_CHARS", chars)
        monkeypatch.setattr(sentencepieces, "_SORTED_PAIRS", pairs)
        again = sentencepieces.Model.load(BLOB)
        at = list(range(len(words)))
        rng.shuffle(at)
        ids, sizes = again.encode_words([words[k] for k in at])
        assert sizes.tolist() == counts[at].tolist()
        parts, ends = [None] * len(words), sizes.cumsum()
        for k, end, n in zip(at, ends.tolist(), sizes.tolist(), strict=True):
            parts[k] = ids[end - n : end].tolist()
        assert [i for part in parts for i in part] == plain.tolist()
        assert len(again.pair_keys) <= max(pairs, 20_000)


def test_new_words_take_half_the_time_of_a_walk_word_by_word():
    rng = random.Random(3)
    syllables = ["th", "er", "ing", "ent", "é", "tion", "ß", "an", "re", "la", "o", "ción", "ble", "sh", "un", "ou"]
    words = sorted({"▁" + "".join(rng.choices(syllables, k=rng.randint(2, 6))) for _ in range(150_000)})
    own, took = sentencepieces.Model.load(BLOB), {}
    for f in (own.walk_words, own.encode_words):
        f(words)  # learns the pairs
        times = []
        for _ in range(3):
            began = time.process_time()
            f(words)
            times.append(time.process_time() - began)
        took[f.__name__] = min(times)
    assert took["encode_words"] < 0.6 * took["walk_words"], took


def test_texts_that_do_not_come_back():
    own = sentencepieces.Model.load(BLOB)
    texts = ["same text", None, "", "�", " two  blanks", "é日", "other"]
    ids = own.encode(texts * 40)
    assert own.gives_back(ids, texts * 40).to_pylist() == [True] * 280
    assert own.gives_back(ids[:7], ["same texT", None, "x", "?", "two  blanks", "e日", "other"]).to_pylist() == [False, True, False, False, False, False, True]
    half = pa.array([own.encode(["é日"]).to_pylist()[0], [own.byte_ids[0xE6]]], pa.list_(pa.int32()))
    assert own.gives_back(half, ["é日", "\ufffd"]).to_pylist() == [True, own.decode(half[1].as_py()) == "\ufffd"]


def test_model_kinds_that_are_not_read():
    with pytest.raises(ValueError, match="unigram and BPE"):
        sentencepieces.Model.load(altered(model_type=3).SerializeToString())


def test_query_equals_library(spark):
    ref = sentencepiece.SentencePieceProcessor(model_proto=BLOB)
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.QUERIES["op6_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ref.encode(texts[r.doc_id])
        assert r.round_trip and r.n_ids == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_edges(spark):
    model = sentencepieces.share_model(spark, queries.MODEL)
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "word " * 40_000)], "ids int, text string")
    out = df.select("text", sentencepieces.encoded("text", model).alias("e")).withColumn("d", sentencepieces.decoded("e", model)).collect()
    assert [r.e for r in out][:3] == [None, None, []] and all(r.d == r.text for r in out)
    both = df.select(sentencepieces.encoded_and_checked("text", model).alias("c")).collect()
    assert [r.c.ids for r in both] == [r.e for r in out] and all(r.c.exact for r in both)
    assert df.limit(0).select(sentencepieces.encoded("text", model)).count() == 0
