"""Passages that repeat across documents, by sparse suffix arrays.

A passage counts from 50 words on (``K`` + ``GAP``).  Of each text only the suffixes at content-selected positions
are kept: those where the 20-gram hash is the least of 31 neighbours.  Any 50
words hold such a position with its whole 20-gram, and equal words select the same one, so every
repeat has a retained suffix at the same place in each of its copies.

Suffixes whose first 20 words occur in one document only are dropped.  The others are
brought together by those words, with the 30 words before and after, and sorted twice: by the words that follow, and by the
words before, read backwards.  Neighbours in each order are compared, which gives the number of words that they share to the right
and to the left.  For each l, suffixes between which the right order has no neighbours that share under 30 - l words, and the left
order none that share under l, have l + 20 + 30 - l = 50 words in common; so each match is extended to both sides.
The stretches of each document are merged at the end.

A start that more than ``HOT`` suffixes share is not brought to one task: its extensions become rows
of their own, and Spark counts equal ones, which combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanglass.llm.bitsets import KeySet
from spanglass.llm.hashing import mixed, word_hashes
from spanglass.llm.shared import table_of

K = 20  # words that start a suffix
GAP = 30  # words beside them, to the left and right together, that a match needs
HOT = 65_536  # suffixes with one start that a task holds at once, some 60 MB
_CHUNK = 20_000
_OUT = 100_000
_FIELDS = [("key", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64()), ("before", pa.binary()), ("after", pa.binary())]


def gram_hashes(words: np.ndarray, k: int = K) -> np.ndarray:
    h = np.full(max(0, len(words) - k + 1), 11, np.uint64)
    for i in range(k):
        h = mixed(h ^ words[i : i + len(h)])
    return h


def selected(grams: np.ndarray, gap: int = GAP) -> np.ndarray:
    """Positions of the least of each gap + 1 neighbours, the leftmost of equal ones."""
    if len(grams) <= gap:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, gap + 1)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def suffix_rows(ids: list, texts: list, only: KeySet | None) -> Iterator[tuple]:
    """(keys, doc, positions, word hashes) of each text; with ``only``, keys that it may hold."""
    for doc, words in zip(ids, word_hashes(texts), strict=True):
        if doc is None or len(words) < K + GAP:
            continue
        grams = gram_hashes(words)
        at = selected(grams)
        keys = grams[at].view(np.int64)
        if only is not None:
            keep = only.may_hold(keys)
            keys, at = keys[keep], at[keep]
        if len(keys):
            yield keys, doc, at, words


def suffix_starts(docs: DataFrame) -> DataFrame:
    """(key, doc) of the retained suffixes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, np.full(len(k), doc)) for k, doc, _, _ in suffix_rows(b.column(0).to_pylist(), b.column(1).to_pylist(), None)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["key", "doc"])

    return docs.mapInArrow(emit, "key bigint, doc bigint")


def suffixes(docs: DataFrame, only: KeySet) -> DataFrame:
    """(key, doc, pos, before, after) of suffixes that may repeat; the contexts hold 32 bits of each word's hash."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_FIELDS)
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for keys, doc, at, words in suffix_rows(b.column(0).to_pylist(), b.column(1).to_pylist(), only):
                short = words.astype(np.uint32)
                for key, p in zip(keys.tolist(), at.tolist(), strict=True):
                    row = key, doc, p, short[max(0, p - GAP) : p][::-1].tobytes(), short[p + K : p + K + GAP].tobytes()
                    for c, v in zip(rows, row, strict=True):
                        c.append(v)
                if len(rows[0]) >= _OUT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, _FIELDS, strict=True)], schema=schema)
                    rows = [[], [], [], [], []]
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, _FIELDS, strict=True)], schema=schema)

    return docs.mapInArrow(emit, "key bigint, doc bigint, pos bigint, before binary, after binary")


def _prefix_hashes(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first l words of each context, for l from 0 to GAP, and how many words each has."""
    lengths = np.array([len(c) // 4 for c in contexts])
    m = np.frombuffer(b"".join(c.ljust(4 * GAP, b"\0") for c in contexts), np.uint32).reshape(-1, GAP).astype(np.uint64)
    out = np.empty((len(contexts), GAP + 1), np.uint64)
    out[:, 0] = 5
    for i in range(GAP):
        out[:, i + 1] = mixed(out[:, i] ^ m[:, i])
    return out, lengths


def extensions(keys: np.ndarray, before: list[bytes], after: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(l, rows, hash): the 50 words that begin l words before each suffix that has so many on both sides."""
    left, n_left = _prefix_hashes(before)
    right, n_right = _prefix_hashes(after)
    base = mixed(keys.view(np.uint64))
    for n in range(GAP + 1):
        rows = np.flatnonzero((n_left >= n) & (n_right >= GAP - n))
        yield n, rows, mixed(base[rows] ^ mixed(left[rows, n] + np.uint64(n)) ^ (right[rows, GAP - n] * np.uint64(3)))


def sorted_contexts(keys: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, shared, lengths): the order by key and words, and how many words each shares with the one before it there (-1: not even the key)."""
    lengths = np.array([len(c) // 4 for c in contexts])
    padded = np.frombuffer(b"".join(c.ljust(4 * GAP, b"\0") for c in contexts), np.uint32).reshape(-1, GAP)
    rows = np.concatenate([keys.view(np.uint32).reshape(-1, 2), padded], axis=1)
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{4 * (GAP + 2)}").ravel(), kind="stable")  # by bytes: equal words are neighbours
    same = np.cumprod(rows[order[1:]] == rows[order[:-1]], axis=1)
    shared = np.minimum(same[:, 2:].sum(axis=1), np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    return order, np.r_[-1, np.where(same[:, 1] == 1, shared, -1)], lengths


def stretches(keys: np.ndarray, docs: np.ndarray, at: np.ndarray, before: list[bytes], after: list[bytes]) -> tuple[np.ndarray, ...]:
    """(doc, start, end, first doc) of the suffixes that lie in a repeated passage; whole keys only."""
    most, least, first = np.full(len(keys), -1), np.full(len(keys), GAP + 1), docs.copy()
    right, shared_right, n_right = sorted_contexts(keys, after)
    left, shared_left, n_left = sorted_contexts(keys, before)

    def interval(order: np.ndarray, shared: np.ndarray, words: int) -> np.ndarray:
        """Numbers of the stretches of the order in which neighbours share so many words."""
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(shared < words)
        return out

    for n in range(GAP + 1):
        rows = np.flatnonzero((n_left >= n) & (n_right >= GAP - n))
        if len(rows) < 2:
            continue
        both = (interval(right, shared_right, GAP - n) * (len(keys) + 1) + interval(left, shared_left, n))[rows]
        order = np.argsort(both, kind="stable")
        starts = np.flatnonzero(np.r_[True, both[order][1:] != both[order][:-1]])
        own = docs[rows[order]]
        low, high = np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)
        sizes = np.diff(np.r_[starts, len(order)])
        shared = np.repeat(low < high, sizes)
        hit = rows[order][shared]
        most[hit], least[hit] = np.maximum(most[hit], n), np.minimum(least[hit], n)
        first[hit] = np.minimum(first[hit], np.repeat(low, sizes)[shared])
    found = most >= 0
    return docs[found], (at - most)[found], (at - least + K + GAP)[found], first[found]


def _in_tasks(rows: DataFrame) -> DataFrame:
    """Stretches of keys that few suffixes share; a task goes through its keys in order."""
    names = ["doc", "start", "end", "first"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(last: bool) -> tuple[list[pa.RecordBatch], pa.RecordBatch | None]:
            """Work off all whole keys; the last key goes on unless nothing follows."""
            t = pa.Table.from_batches(held).combine_chunks()
            keys = t.column("key").to_numpy()
            end = len(keys) if last else int(np.searchsorted(keys, keys[-1], side="left"))
            out = None
            if end:
                s = t.slice(0, end)
                out = stretches(keys[:end], s.column("doc").to_numpy(), s.column("pos").to_numpy(), s.column("before").to_pylist(), s.column("after").to_pylist())
                out = pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in out], names)
            return t.slice(end).to_batches(), out

        for b in batches:
            for i in range(0, b.num_rows, _CHUNK):
                held.append(b.slice(i, _CHUNK))
                if sum(x.num_rows for x in held) >= _CHUNK:
                    held, out = close(False)
                    if out is not None:
                        yield out
        if held:
            yield close(True)[1]

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(find, "doc bigint, start bigint, end bigint, first bigint")


def _by_counting(rows: DataFrame) -> DataFrame:
    """Stretches of keys that very many suffixes share: one row for each extension, counted by Spark."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, _CHUNK):
                s = b.slice(i, _CHUNK)
                docs, at = s.column("doc").to_numpy(), s.column("pos").to_numpy()
                for n, has, h in extensions(s.column("key").to_numpy(), s.column("before").to_pylist(), s.column("after").to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(docs[has]), pa.array(at[has] - n)], ["hash", "doc", "start"])

    one = rows.mapInArrow(expand, "hash bigint, doc bigint, start bigint")
    shared = table_of(one.groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("high")).filter("first < high").select("hash", "first"), "hot-passages")
    return one.join(shared, "hash").select("doc", "start", (F.col("start") + K + GAP).alias("end"), "first")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, start_word, end_word, n_words, first_id): maximal stretches under passages that another id's text holds too.

    Words are runs of other than ASCII white space, A-Z in lower case, counted from 0; ends are exclusive.  Each stretch is a union of
    passages of 50 words, each of which occurs in a text of another id; ``first_id`` is the smallest id that holds one of them
    (for the first holder, its own).  All holders are reported.  Null, empty and short texts, texts without an id and
    repeats within one id's texts give nothing; rows with the same id are one document whose stretches are merged.
    An empty table gives no rows.  Further columns are ignored.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    # Counts combine before the shuffle; only starts of several documents are kept.
    starts = suffix_starts(d).groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    starts = table_of(starts.select("key", "n"), "repeat-keys")
    many = table_of(starts.filter(F.col("n") > hot).select("key"), "hot-keys")
    rows = suffixes(d, KeySet(starts, "key"))
    if many.isEmpty():
        found = _in_tasks(rows)
    else:
        rows = table_of(rows, "suffixes")  # the texts are cut once for both
        apart = table_of(rows.join(many, "key", "left_semi"), "hot-suffixes")
        found = _in_tasks(rows.join(many, "key", "left_anti")).unionByName(_by_counting(apart))
    before = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int")
    island = F.sum("opens").over(Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    merged = found.withColumn("opens", opens).withColumn("island", island).groupBy("doc", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("first").alias("first_id"))
    return merged.select(F.col("doc").alias(id_col), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_id")
