"""Source divergence audit: how far each source's terms are from those of the other sources of its language.

A group is a (lang, source).  Its distribution over the V kept terms of the language is in whole billionths,
``p = 1 + floor(SCALE * (count + 1) / (N + V))``, and the divergence of a group from another distribution q is the sum
of ``floor((p - q)^2 / q)`` over all kept terms, in whole numbers throughout.

``p`` depends on a term's count alone, so a pair of sources needs no walk over its terms: it needs the joint
histogram of its counts, that is how many terms have count x in one and y in the other.  Tasks tally it for the terms they hold
(both counts above zero) and the tallies are summed.  The cells with a zero are implied: margins less what is tallied,
and what is left of V.  The function is then evaluated once for each combination and multiplied.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanglass.llm.memory import giving_back
from spanglass.llm.shared import table_of

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
_ENTRIES = 400_000  # terms that a task counts before it passes them on, some 100 bytes each
_PIECE = 4_000_000  # bytes of a text looked at at once
_CELLS = 2_000_000  # count pairs tallied at once
_LETTERS = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_TALLY = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64())])


# ---- counting


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, some megabytes of it at a time."""
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > _PIECE:
            end = text.find(b" ", start + _PIECE)
            end = len(text) if end < 0 else end
        yield text[start:end].split(b" ")
        start = end


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """Runs of ASCII letters, in lower case, and of what is not ASCII."""
    for words in _pieces(text.translate(_LETTERS)):
        yield [w for w in words if w]


@giving_back
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term, by group; summed over what the task has seen since it last passed rows on."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for i in range(0, len(terms), 65_536):
                part = terms[i : i + 65_536]
                size = len(part)
                columns = [pa.array([lang] * size), pa.array([source] * size), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part]), pa.array([docs[t] for t in part])]
                yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)
        held.clear()

    entries = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, seen = len(n), set()
            for words in _terms(text.as_py().encode()):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            entries += len(n) - before
            if entries >= _ENTRIES:
                yield from passed_on()
                entries = 0
    yield from passed_on()


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, cells): the terms in at least ``min_docs`` documents of a language, with array<struct<source, n>>.

    Nulls count as ''.  A row is a document, whatever its id; repeated rows count each.  Terms are case-folded for A-Z alone.
    """
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = plain.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return terms.filter(F.col("docs") >= min_docs).select("lang", "term", "total", "cells")


# ---- joint histograms


def _tallied(tally: pa.Table) -> pa.Table:
    return tally.group_by(["lang", "a", "b", "x", "y"]).aggregate([("n", "sum")]).select(["lang", "a", "b", "x", "y", "n_sum"]).rename_columns(_TALLY.names)


@giving_back
def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many terms have count x in source a and y in source b, both above zero and a before b, for the terms of a task."""
    tally, held = [], 0
    for batch in batches:
        cells = batch.column(1)
        lang = pc.dictionary_encode(batch.column(0))
        source, count = pc.dictionary_encode(cells.flatten().field(0)), cells.flatten().field(1).to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
        rank = np.argsort(np.argsort(np.array(source.dictionary.to_pylist(), object), kind="stable"), kind="stable") if len(source.dictionary) else np.zeros(0, np.int64)
        code = source.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((rank[code], row))  # each term's sources in one order, so a pair has one name
        code, count, row_lang = code[order], count[order], np.repeat(lang.indices.to_numpy(zero_copy_only=False), sizes)
        ends, at = np.repeat(np.cumsum(sizes), sizes), np.arange(len(code))
        for apart in range(1, int(sizes.max(initial=0))):  # the cells of a term that are ``apart`` places from each other
            at = at[at + apart < ends[at]]
            for i in range(0, len(at), _CELLS):
                k = at[i : i + _CELLS]
                names = [pa.DictionaryArray.from_arrays(pa.array(v.astype(np.int32)), d).cast(pa.string()) for v, d in ((row_lang[k], lang.dictionary), (code[k], source.dictionary), (code[k + apart], source.dictionary))]
                tally.append(_tallied(pa.table([*names, count[k], count[k + apart], np.ones(len(k), np.int64)], schema=_TALLY)))
                held += tally[-1].num_rows
                if held >= _CELLS:
                    merged = _tallied(pa.concat_tables(tally))
                    tally, held = [merged], merged.num_rows
                    if held >= _CELLS // 2:
                        yield from merged.to_batches(65_536)
                        tally, held = [], 0
    if tally:
        yield from _tallied(pa.concat_tables(tally)).combine_chunks().to_batches(65_536)


def _share(count: Column, total: Column, kept: Column) -> Column:
    """p of a term with this count, in billionths."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + 1), wide(total) + wide(kept)) + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


# ---- the audit


def _groups(docs: DataFrame, terms: DataFrame, lang_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(lang, source, total, kept) of all groups, and the histograms (lang, source, x, n) of their counts above zero."""
    cells = terms.select("lang", F.explode("cells").alias("c")).select("lang", "c.source", F.col("c.n").alias("x"))
    histograms = table_of(cells.groupBy("lang", "source", "x").agg(F.count(F.lit(1)).alias("n")), "divergence-histograms")
    sums = histograms.groupBy("lang", "source").agg(F.sum(F.col("x") * F.col("n")).alias("total"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source")))).distinct()
    groups = groups.join(sums, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "kept"])
    return table_of(groups, "divergence-groups"), histograms


def joint_histograms(terms: DataFrame, groups: DataFrame, histograms: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, n): of each pair of sources a < b, how many kept terms have count x in a and y in b, zeros included."""
    tally = terms.select("lang", "cells").mapInArrow(_tally, "lang string, a string, b string, x bigint, y bigint, n bigint")
    # With both margins and the sum of each pair, which are to be taken from the cells with a zero.
    pair, x, y = [F.col("lang"), F.col("a"), F.col("b")], F.col("x"), F.col("y")
    found = tally.groupingSets([[*pair, x, y], [*pair, x], [*pair, y], pair], *pair, x, y).agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    found = found.select(*pair, F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"), F.when(F.col("g").isin(0, 3), F.col("n")).otherwise(-F.col("n")).alias("n"))
    one, other = groups.select("lang", F.col("source").alias("a"), "kept"), groups.select("lang", F.col("source").alias("b"))
    pairs = one.join(other, "lang").filter("a < b")  # as many as the result has rows
    of_a, of_b = (histograms.select("lang", F.col("source").alias(c), F.col("x").alias("__x"), F.col("n").alias("__n")) for c in ("a", "b"))
    zero = F.lit(0).cast("bigint")
    rows = lambda d, x, y, n: d.select(*pair, x.alias("x"), y.alias("y"), n.alias("n"))
    in_a, in_b = pairs.join(of_a, ["lang", "a"]), pairs.join(of_b, ["lang", "b"])
    margins = rows(in_a, F.col("__x"), zero, F.col("__n")).unionByName(rows(in_b, zero, F.col("__x"), F.col("__n")))
    rest = rows(pairs, zero, zero, F.col("kept"))
    for side in (histograms.groupBy("lang", F.col("source").alias("a")), histograms.groupBy("lang", F.col("source").alias("b"))):
        sizes = side.agg(F.sum("n").alias("__n"))
        rest = rest.unionByName(rows(pairs.join(sizes, [c for c in sizes.columns if c != "__n"]), zero, zero, -F.col("__n")))
    every = found.unionByName(margins).unionByName(rest)
    return every.groupBy(*pair, "x", "y").agg(F.sum("n").alias("n")).filter("n > 0")


def source_divergence(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for each occurring (lang, source).

    ``pair``: how far the source is from each other source of its language.  ``term``: the terms that it has more of than
    its language, by how far, the first ``top``.  Ranks go by value, then by item.
    Nulls count as ''; groups without terms have pairs, of value 0 where the language keeps no term.  A row
    is a document, ids play no part, so repeated rows count each.  An empty table gives no rows; further columns are ignored.
    """
    terms = table_of(term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col, min_docs=min_docs), "divergence-terms")
    groups, histograms = _groups(docs, terms, lang_col, source_col)

    joint = joint_histograms(terms, groups, histograms)
    for c, name in (("a", "__ta"), ("b", "__tb")):
        joint = joint.join(groups.select("lang", F.col("source").alias(c), F.col("total").alias(name), *(["kept"] if c == "a" else [])), ["lang", c])
    p, q = _share(F.col("x"), F.col("__ta"), F.col("kept")), _share(F.col("y"), F.col("__tb"), F.col("kept"))
    joint = joint.withColumn("p", p).withColumn("q", q)
    total = lambda p, q: F.sum(F.col("n").cast("decimal(19,0)") * _apart(F.col(p), F.col(q))).cast("bigint")
    sums = joint.groupBy("lang", "a", "b").agg(total("p", "q").alias("ab"), total("q", "p").alias("ba"))
    one, other = groups.select("lang", F.col("source").alias("a"), "kept"), groups.select("lang", F.col("source").alias("b"))
    empty = one.filter("kept = 0").join(other, "lang").filter("a < b").select("lang", "a", "b", F.lit(0).cast("bigint").alias("ab"), F.lit(0).cast("bigint").alias("ba"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value"))))
    pairs = sums.unionByName(empty).select("lang", both.alias("r")).select("lang", "r.source", F.lit("pair").alias("part"), "r.item", "r.value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    langs = groups.groupBy("lang").agg(F.sum("total").alias("__of_lang"))
    cells = terms.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "c.source", F.col("term").alias("item"), F.col("c.n").alias("__n"), F.col("total").alias("__all"))
    cells = cells.join(groups, ["lang", "source"]).join(langs, "lang")
    cells = cells.withColumn("p", _share(F.col("__n"), F.col("total"), F.col("kept"))).withColumn("q", _share(F.col("__all"), F.col("__of_lang"), F.col("kept")))
    cells = cells.filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", _apart(F.col("p"), F.col("q")).alias("value"))
    first = cells.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)  # each task keeps its own first ones before the shuffle
    return pairs.unionByName(first)
