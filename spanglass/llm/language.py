"""Language identification of mixed texts by a linear-chain conditional random field.

Each word of a text gets a language.  Features of a word are its character 2-, 3- and 4-grams
between boundary marks (those at a boundary are its affixes), hashed into buckets, and whether it
is in the lexicon, the frequent words of the training sample.  Transitions between neighbouring words'
languages are learned too, from training sequences half of which change language
in the middle, as code-switched text does.  Forward-backward gives each word's
marginal probabilities; a document's language is the one with the largest sum of
them, and its score the mean marginal of that language.

Training uses a bounded sample: at most ``per_language`` documents of a language, the first in an
order of hashed ids, and of each at most ``SAMPLE_WORDS`` words taken from places spread over
the whole text.  The fitted model is a few MB and is broadcast.  Prediction reads every word.
"""

from __future__ import annotations

import array
import itertools
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanglass.llm.memory import give_back

PER_LANGUAGE = 300
LANGUAGES = 64
GROUPS = 256  # of input partitions, while the sample is chosen
SAMPLE_WORDS = 240
SPAN = 24  # words of a training sequence
BUCKETS = 1 << 16
LEXICON = 20_000
STEPS = 40
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")
_START, _END = "\x02", "\x03"
_GRAMS = (2, 3, 4)
_GROUP = 3_000_000  # bytes of text that run through forward-backward together
_WORDS = 10_000  # distinct words whose n-grams are held at once


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    if not text:
        return []
    words = WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    # Superscripts, fractions and the like are word characters, but no letters.
    return [part for w in words for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of the marked words."""
    codes = np.frombuffer("".join(f"{_START}{w}{_END}" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.cumsum(codes == ord(_START)) - 1
    rows, buckets = [], []
    for n in _GRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
        whole = of[: len(h)] == of[n - 1 :]  # within one word
        rows.append(of[: len(h)][whole])
        buckets.append((h[whole] >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Crf:
    labels: list[str]
    grams: np.ndarray  # bucket x label
    lexicon: dict[str, int]
    entries: np.ndarray  # lexicon entry x label; row 0 is for words outside
    moves: np.ndarray  # label x label, scores of transitions

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each label for each of some distinct words."""
        out = self.entries[[self.lexicon.get(w, 0) for w in words]].astype(np.float32)
        for start in range(0, len(words), _WORDS):
            part = out[start : start + _WORDS]
            rows, buckets = gram_buckets(words[start : start + _WORDS])
            for k in range(len(self.labels)):
                part[:, k] += np.bincount(rows, self.grams[buckets, k], len(part)).astype(np.float32)
        return out

    def potentials(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """exp of each word's scores (the largest is 1), and each text's number of words."""
        index: dict[str, int] = defaultdict(itertools.count().__next__)
        at, counts = array.array("i"), []
        for text in texts:
            words = words_of(text)
            at.extend(map(index.__getitem__, words))
            counts.append(len(words))
        e = self.emissions(list(index)) if index else np.zeros((0, len(self.labels)), np.float32)
        e = np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -30)) if len(e) else e
        return e[np.frombuffer(at, np.int32)] if at else e, np.array(counts, np.int64)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(label number or -1, score) of each text.

        Texts of like length go together, at most _GROUP bytes (or one text) at a time, so that steps over many words are made for few texts.
        """
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        order = np.argsort(sizes, kind="stable")
        label, score = np.full(len(texts), -1), np.zeros(len(texts))
        moves, start, ends = np.exp(self.moves).astype(np.float32), 0, np.cumsum(sizes[order], dtype=np.int64)
        while start < len(order):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _GROUP, side="right")))
            of = order[start:end]
            e, counts = self.potentials(texts.take(pa.array(of)).to_pylist())
            sums = marginal_sums(e, counts, moves)
            has = counts > 0
            best = sums.argmax(axis=1)
            label[of[has]] = best[has]
            score[of[has]] = np.minimum(1.0, sums[has, best[has]] / counts[has])
            start = end
        return label, score


def forward_backward(e: np.ndarray, counts: np.ndarray, moves: np.ndarray):
    """Yield (rows of the words at a step, their marginals, their texts, alpha, following), last step first.

    ``alpha`` and ``following`` (potential times beta of the next word) are those of the texts that have a
    next word; with ``moves`` between them they give the pair's joint probabilities.  ``e`` holds the words' potentials, text after text.  Texts run side by side, the longest first.
    """
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")  # texts with more than t words
    alpha = np.empty_like(e)
    a = None
    for t in range(longest):
        at = starts[: active[t]] + t
        a = e[at] if t == 0 else (a[: active[t]] @ moves) * e[at]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[at] = a
    beta = np.zeros((0, e.shape[1]), e.dtype)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        new = np.ones((n, e.shape[1]), e.dtype)
        following = e[at[: len(beta)] + 1] * beta
        b = following @ moves.T
        new[: len(beta)] = b / b.sum(axis=1, keepdims=True)
        beta = new
        m = alpha[at] * beta
        yield at, m / m.sum(axis=1, keepdims=True), order[:n], alpha[at[: len(following)]], following


def marginal_sums(e: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(counts), e.shape[1]))
    for _, m, texts, _, _ in forward_backward(e, counts, moves):
        sums[texts] += m
    return sums


def training_sequences(docs: list[tuple[list[str], int]], rng: np.random.Generator) -> tuple[list[list[str]], list[list[int]]]:
    """Sequences of SPAN words; every second one changes to a piece of another document in its middle."""
    spans = [(words[i : i + SPAN], k) for words, k in docs for i in range(0, len(words), SPAN)]
    spans = [spans[i] for i in rng.permutation(len(spans))]
    seqs, tags = [], []
    for i, (words, k) in enumerate(spans):
        if i % 2:
            cut = int(rng.integers(1, len(words) + 1))
            other, j = spans[i - 1]
            seqs.append(words[:cut] + other[: SPAN - cut])
            tags.append([k] * cut + [j] * len(other[: SPAN - cut]))
        else:
            seqs.append(words)
            tags.append([k] * len(words))
    return seqs, tags


def fit(sample: list[tuple[str, str]], seed: int = 0) -> Crf | None:
    """Maximum likelihood with a quadratic penalty, by Adam; none if no labelled text has a word."""
    labels = sorted({lang for _, lang in sample})
    rank = {lang: i for i, lang in enumerate(labels)}
    docs = [(w, rank[lang]) for text, lang in sample if (w := words_of(text))]
    if not docs:
        return None
    counted = Counter(w for words, _ in docs for w in words)
    lexicon = {w: i + 1 for i, (w, n) in enumerate(sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) if n >= 3}
    seqs, tags = training_sequences(docs, np.random.default_rng(seed))
    vocabulary = {w: i for i, w in enumerate(counted)}
    at = np.array([vocabulary[w] for s in seqs for w in s])
    truth = np.array([k for t in tags for k in t])
    counts = np.array([len(s) for s in seqs], np.int64)
    rows, buckets = gram_buckets(list(vocabulary))
    entry = np.array([lexicon.get(w, 0) for w in vocabulary])
    n, size = len(at), len(labels)
    onehot = np.zeros((n, size))
    onehot[np.arange(n), truth] = 1
    inner = np.ones(n, bool)  # words that have one after them
    inner[np.cumsum(counts) - 1] = False
    pairs = np.zeros((size, size))
    np.add.at(pairs, (truth[:-1][inner[:-1]], truth[1:][inner[:-1]]), 1)
    w = [np.zeros((BUCKETS, size)), np.zeros((len(lexicon) + 1, size)), np.zeros((size, size))]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, STEPS + 1):
        scores = w[1][entry].copy()
        for k in range(size):
            scores[:, k] += np.bincount(rows, w[0][buckets, k], len(vocabulary))
        e = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -30))[at]
        moves = np.exp(w[2])
        marginal, expected = np.zeros((n, size)), np.zeros((size, size))
        for here, probability, _, alpha, following in forward_backward(e, counts, moves):
            marginal[here] = probability
            joint = alpha[:, :, None] * moves * following[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        diff = np.zeros((len(vocabulary), size))
        for k in range(size):
            diff[:, k] = np.bincount(at, (marginal - onehot)[:, k], len(vocabulary))
        grads = [np.stack([np.bincount(buckets, diff[rows, k], BUCKETS) for k in range(size)], axis=1), np.zeros_like(w[1]), expected - pairs]
        for k in range(size):
            grads[1][:, k] = np.bincount(entry, diff[:, k], len(w[1]))
        for i in range(3):
            g = grads[i] / n + 1e-6 * w[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            w[i] -= 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)
    return Crf(labels, w[0].astype(np.float32), lexicon, w[1].astype(np.float32), w[2])


@F.arrow_udf(T.StringType())
def _spread(texts: pa.Array) -> pa.Array:
    """SAMPLE_WORDS words at most, in runs of SPAN that are spread over the text."""
    out = []
    for t in texts:
        words = words_of(t.as_py())
        if len(words) > SAMPLE_WORDS:
            runs = SAMPLE_WORDS // SPAN
            words = [w for i in range(runs) for w in words[(len(words) - SPAN) * i // (runs - 1) :][:SPAN]]
        out.append(" ".join(words))
    return pa.array(out, pa.string())


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that training never sees: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> list[tuple[str, str]]:
    """(text, language) of at most ``per_language`` documents of each label; more than ``languages`` labels raise an error."""
    d = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    d = d.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("order"), F.xxhash64(text_col).alias("tie"))
    def first(rows: DataFrame, within: list[str], *by: str) -> DataFrame:
        return rows.withColumn("n", F.row_number().over(Window.partitionBy(*within).orderBy(*by))).filter(F.col("n") <= per_language)

    # The hash of the last document wanted of each language is found without the texts; then few texts are ordered.  Each input
    # partition keeps its first ones, each of GROUPS groups of partitions those of its own, so no task reads from all partitions.
    groups = d.select("lang", "order").withColumn("group", F.spark_partition_id() % GROUPS)
    ends = first(first(groups, ["lang", "group"], "order"), ["lang"], "order").groupBy("lang").agg(F.max("order").alias("last")).orderBy("lang").limit(languages + 1).collect()
    if len(ends) > languages:
        raise ValueError(f"more than {languages} languages; pass languages= to train on more")
    if not ends:
        return []
    last = F.create_map(*(F.lit(x) for r in ends for x in (r.lang, r.last)))
    d = first(d.filter(F.col("order") <= last[F.col("lang")]), ["lang"], "order", "tie")
    rows = d.select("lang", _spread("text").alias("text")).collect()
    return sorted((r.text, r.lang) for r in rows)


def fit_language_model(docs: DataFrame, **options) -> Crf | None:
    return fit(training_sample(docs, **options))


def with_language(docs: DataFrame, model: Crf | None, *, text_col: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a column ``into``: struct(lang, score).

    A text that is null, empty or without a letter, and any text if the model is none (it saw no labelled
    words), gives ``und`` and 0.  Ties between languages go to the first in sorted order.  Very long texts are read to their last word; repeated rows each get theirs;
    other columns pass through, one named ``into`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf(T.StructType().add("lang", T.StringType()).add("score", T.DoubleType()))
    def predict(texts: pa.Array) -> pa.Array:
        model = shared.value
        label, score = model.predict(texts) if model is not None else (np.full(len(texts), -1), np.zeros(len(texts)))
        give_back()
        names = pa.array([*(model.labels if model is not None else []), UNKNOWN])
        return pa.StructArray.from_arrays([names.take(pa.array(np.where(label < 0, len(names) - 1, label))), pa.array(score)], fields=list(kind))

    return docs.withColumn(into, predict.asNondeterministic()(F.col(text_col).cast("string")))
