"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are folded (A-Z to lower case, every other ASCII byte but digits and a-z
to a space), so that a text is a run of words between single spaces.  Each
benchmark item gives its windows of 13 words (a shorter item: one window of all
its words) and the automaton holds all of them, spaces at both ends included, so
that a match always covers whole words.  A document is scanned once; the words
under any match are hit, and their offsets point into the original text.

The benchmark is a stated pattern set: it is taken in blocks of at most
``block_bytes`` of folded windows, each block with one automaton.  Usually there is one
block, and then nothing is shuffled.  With more, one block after another scans the documents and writes the stretches
of words that it hits, so the driver and the executors hold one block at a time; the stretches are then
united per document, and the result is that of one automaton.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanglass.llm.memory import give_back
from spanglass.llm.shared import table_of

WINDOW = 13
BLOCK_BYTES = 8_000_000  # of windows; an automaton takes some 27 times that in each Python worker

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
FOLD = bytes(c if c >= 0x80 or c in _KEEP else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

SCAN = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>,stretches:array<struct<first:bigint,last:bigint>>>"
_PAIR = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
_SCAN = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _PAIR("start", "end")), ("stretches", _PAIR("first", "last"))])


def folded_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """All windows of ``size`` words, or the whole of fewer words; none without words."""
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def automaton_of(patterns: list[tuple[bytes, list[str]]]) -> ahocorasick.Automaton:
    """Latin-1 stands for UTF-8 bytes here, so that one character is one byte."""
    made = ahocorasick.Automaton()
    for window, items in patterns:
        made.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, items))
    made.make_automaton()
    return made


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Code-point offsets of the folded words in the original text."""
    return [m.span() for m in WORD.finditer(text)]


def scan_text(automaton: ahocorasick.Automaton, text: str | None) -> dict:
    words = folded_words(text)
    found = {"n_words": len(words), "n_hit": 0, "items": [], "spans": [], "stretches": []}
    if not words or not len(automaton):
        return found
    matches = list(automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
    if not matches:
        return found
    ends = np.cumsum([len(w) + 1 for w in words])  # where the space after each word stands
    last = np.searchsorted(ends, [at for at, _ in matches])
    hit = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    for end, (_, (size, of)) in zip(last, matches, strict=True):
        hit[end + 1 - size] += 1
        hit[end + 1] -= 1
        items.update(of)
    under = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
    breaks = np.flatnonzero(np.diff(under) > 1)
    runs = list(zip(under[np.r_[0, breaks + 1]].tolist(), under[np.r_[breaks, len(under) - 1]].tolist(), strict=True))
    at = word_offsets(text)
    found |= {"n_hit": len(under), "items": sorted(items), "stretches": [{"first": a, "last": b} for a, b in runs]}
    found["spans"] = [{"start": at[a][0], "end": at[b][1]} for a, b in runs]
    return found


def pattern_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int):
    """Lists of (window, item ids), each list within ``block_bytes``; items stream in, one partition at a time."""
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator()
    block: dict[bytes, list[str]] = defaultdict(list)
    size = 0
    for item, text in rows:
        for w in dict.fromkeys(windows_of(folded_words(text), window)):
            if w not in block:
                size += len(w) + 64
            if item is not None:
                block[w].append(item)
            else:
                block[w] += []
        if size > block_bytes:
            yield list(block.items())
            block, size = defaultdict(list), 0
    yield list(block.items())


_BUILT: dict = {}


def _automaton(key: str, patterns: list) -> ahocorasick.Automaton:
    """Built once in each Python worker, which keeps one automaton at a time."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = automaton_of(patterns)
    return _BUILT[key]


def _scanner(sc: SparkContext, patterns: list):
    shared, key = sc.broadcast(patterns), uuid.uuid4().hex

    @F.arrow_udf(SCAN)
    def scan(texts: pa.Array) -> pa.Array:
        automaton = _automaton(key, shared.value)
        out = pa.array((scan_text(automaton, t.as_py()) for t in texts), _SCAN)
        give_back()
        return out

    return scan.asNondeterministic(), shared  # so that a filter on its result does not run it twice


_SPANS = T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()))


@F.arrow_udf(T.StructType().add("n_hit", T.LongType()).add("spans", _SPANS))
def _united(texts: pa.Array, stretches: pa.Array) -> pa.Array:
    """Hit words, and the code points of the stretches (in order of their first words) where these overlap or touch."""
    out = []
    for text, runs in zip(texts, stretches, strict=True):
        joined: list[list[int]] = []
        for r in runs.as_py() or []:
            if joined and r["first"] <= joined[-1][1] + 1:
                joined[-1][1] = max(joined[-1][1], r["last"])
            else:
                joined.append([r["first"], r["last"]])
        at = word_offsets(text.as_py()) if joined else []
        out.append({"n_hit": sum(b - a + 1 for a, b in joined), "spans": [{"start": at[a][0], "end": at[b][1]} for a, b in joined]})
    return pa.array(out, pa.struct([("n_hit", pa.int64()), ("spans", _PAIR("start", "end"))]))


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, into: str = "contamination") -> DataFrame:
    """``docs`` with one more column ``into``: struct(n_words, n_hit, items, spans).

    ``items`` are the ids (as strings, sorted) of items with a window in the text;
    ``spans`` are [start, end) code points of the original text under matches.
    ``block_bytes`` only decides how much of the benchmark is held at once, not the result.
    A null or empty text has no words and no hits; so has any text if the benchmark is
    empty.  Null or wordless items match nothing, repeated items are reported once; an item without an id hits words, but is
    not among ``items``.
    Every row of ``docs`` gives one row, repeated ids and further columns included; a
    column that already has the name ``into`` is replaced.
    """
    sc = docs.sparkSession.sparkContext
    blocks = pattern_blocks(benchmark, item_id_col, item_text_col, window, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    text = F.col(text_col).cast("string")
    if second is None:
        return docs.withColumn(into, _scanner(sc, first)[0](text)).withColumn(into, F.col(into).dropFields("stretches"))
    docs = table_of(docs.withColumn("__row", F.expr("uuid()")), "decontaminate")  # a row's own id, fixed by writing it
    scans = None
    for block in itertools.chain([first, second], blocks):
        scan, shared = _scanner(sc, block)
        part = table_of(docs.select("__row", scan(text).alias("s")).select("__row", "s.n_words", "s.items", "s.stretches"), "scan")
        shared.destroy()
        scans = part if scans is None else scans.unionByName(part)
    all_of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = scans.groupBy("__row").agg(F.first("n_words").alias("__n_words"), all_of("items").alias("__items"), all_of("stretches").alias("__stretches"))
    found = docs.join(merged, "__row").withColumn("__u", _united(text, F.col("__stretches")))
    return found.withColumn(into, F.struct(F.col("__n_words").alias("n_words"), F.col("__u.n_hit").alias("n_hit"), F.col("__items").alias("items"), F.col("__u.spans").alias("spans"))).drop("__row", "__n_words", "__items", "__stretches", "__u")


def is_contaminated(found: str = "contamination"):
    """At least one hit word, and at least a twentieth of the words hit."""
    return (F.col(f"{found}.n_hit") > 0) & (20 * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))
