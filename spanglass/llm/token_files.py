"""Token id files: all ids of a corpus one after another, document boundaries in Elias-Fano code.

Documents are range-partitioned by id, encoded where they are sorted, and written as files of some tens of megabytes.  A file holds

    magic, counts and the smallest document id
    the ends of its documents, Elias-Fano        2 + log2(ids / documents) bits each, or so
    the ids of its documents, Elias-Fano         those without an id come first and are only counted
    the token ids, two or four bytes each

An Elias-Fano list of n values below u keeps the lowest ``floor(log2(u / n))`` bits of each as they are; what is above is a
bit vector in which value i is the one at place ``high + i``.  Places of every 256th one, 32 bits each, lead to any value
(select) without a table of offsets, so a reader takes a range of documents from a file without reading the others.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanglass.llm.hashing import slices
from spanglass.llm.memory import give_back
from spanglass.llm.sentencepieces import _runs
from spanglass.llm.shared import new_path, table_of

FILE_BYTES = 64_000_000  # of token ids in a file
READ_BYTES = 16_000_000  # of token ids read by a task
EVERY = 256
_SLICE = 2_000_000
_BATCH_BYTES = 8_000_000
_MAGIC = b"TOKENID1"
_HEAD = struct.Struct("<8sQQQqBQQ")  # magic, documents, those without an id, ids, smallest id, bytes an id, bytes of both lists
_LIST = struct.Struct("<QBQ")  # values, low bits, bytes of the upper part


# ---- Elias-Fano


@dataclass
class EliasFano:
    """A list of values that never fall, read from its bytes."""

    n: int
    low_bits: int
    places: np.ndarray  # of every EVERY-th one of the upper part
    low: np.ndarray
    upper: np.ndarray

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        last = int(values[-1]) if n else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(ones[-1]) + 1 if n else 0, bool)
        upper[ones] = True
        packed = np.packbits(upper, bitorder="little").tobytes()
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.concatenate([np.zeros(0, np.uint8), *(np.packbits(((values[i : i + 8192, None] >> shifts) & np.uint64(1)).astype(bool).ravel(), bitorder="little") for i in range(0, n, 8192))])
        return _LIST.pack(n, low_bits, len(packed)) + ones[::EVERY].astype("<u4").tobytes() + low.tobytes() + packed

    @classmethod
    def decode(cls, data: bytes) -> EliasFano:
        n, low_bits, size = _LIST.unpack_from(data)
        at, places = _LIST.size, -(-n // EVERY)
        low_bytes = -(-n * low_bits // 8)
        parts = (np.frombuffer(data, "<u4", places, at), np.frombuffer(data, np.uint8, low_bytes, at + 4 * places), np.frombuffer(data, np.uint8, size, at + 4 * places + low_bytes))
        return cls(n, low_bits, *parts)

    def _ones(self, start: int, end: int) -> np.ndarray:
        """Places of the ones start .. end - 1 of the upper part, from the sampled place before them."""
        first = start // EVERY
        byte = int(self.places[first]) // 8
        after = -(-end // EVERY)
        stop = int(self.places[after]) // 8 + 1 if after < len(self.places) else len(self.upper)
        bits = np.flatnonzero(np.unpackbits(self.upper[byte:stop], bitorder="little")) + 8 * byte
        bits = bits[np.searchsorted(bits, int(self.places[first])) :]
        return bits[start - first * EVERY : end - first * EVERY]

    def values(self, start: int, end: int) -> np.ndarray:
        """Values start .. end - 1."""
        if start >= end:
            return np.zeros(0, np.uint64)
        high = (self._ones(start, end) - np.arange(start, end)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        a, b = start * self.low_bits, end * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(-1, self.low_bits)
        for k in range(self.low_bits):
            high |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return high

    def select(self, i: int) -> int:
        """Value i."""
        return int(self.values(i, i + 1)[0])


# ---- files


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    """One file; documents come in ascending order of id, those without one first."""
    n_null = sum(d is None for d in doc_ids)
    known = doc_ids[n_null:]
    first = known[0] if known else 0
    ends = EliasFano.encode(np.cumsum(lengths, dtype=np.uint64))
    names = EliasFano.encode(np.array([d - first for d in known], np.uint64))
    return _HEAD.pack(_MAGIC, len(doc_ids), n_null, len(ids) // width, first, width, len(ends), len(names)) + ends + names + ids


def documents_in(file, start: int, end: int, most: int = _BATCH_BYTES) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Documents start .. end - 1 of an open file: their ids, where they begin (one more than documents), and token ids from the first to the last.

    Some ``most`` bytes at a time, or one document.
    """
    magic, _, n_null, _, first, width, *sizes = _HEAD.unpack(file.read(_HEAD.size))
    if magic != _MAGIC:
        raise ValueError("not a token id file")
    ends, names = (EliasFano.decode(file.read(n)) for n in sizes)
    data = _HEAD.size + sum(sizes)
    bounds = np.r_[ends.select(start - 1) if start else 0, ends.values(start, end).astype(np.int64)].astype(np.int64)
    at = start
    while at < end:
        begin = bounds[at - start]
        stop = max(at + 1, start + int(np.searchsorted(bounds, begin + most // width, side="right")) - 1)
        file.seek(data + int(begin) * width)
        ids = np.frombuffer(file.read(int(bounds[stop - start] - begin) * width), f"<u{width}")
        named = [first + int(v) for v in names.values(max(at, n_null) - n_null, max(stop, n_null) - n_null)]
        yield [None] * (stop - at - len(named)) + named, bounds[at - start : stop - start + 1], ids
        at = stop


# ---- encoding


#: Words that are encoded whole: with an apostrophe (it takes letters with it), the beginning of a special token, or what is neither ASCII nor a letter that nothing combines with.
_ODD = re.compile(r"'|<\||[^\x20-\x7E\xC0-\xD6\xD8-\xF6\xF8-\xFF]")
_PARTS = re.compile(r"[a-z\xDF-\xF6\xF8-\xFF]+|[^a-z\xDF-\xF6\xF8-\xFF ]+")  # of lower-case text
_WHOLE = "\0"
_STAND_IN = b"\x01"  # for an odd word among the bytes of a text; a control character is odd itself
_KNOWN, _TOGETHER, _CALL, _LONG = 600_000, 256, 32, 200

#: Bytes of lower-case UTF-8 text without odd words: blanks, letters (those beyond ASCII take two bytes, the first of which is C3) and others.
_BLANK, _LETTER, _OTHER = range(3)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*b" \t\n\r"]] = _BLANK
_KIND[[*range(ord("a"), ord("z") + 1), *range(0x80, 0xC0), 0xC3]] = _LETTER
_PLAIN = bytes({*b" \t\n\r", *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3} - {ord("'")})


def _has_odd(text: bytes) -> bool:
    """Whether there is an odd word, as by ``_ODD``, in UTF-8 text."""
    return bool(text.translate(None, _PLAIN)) or b"<|" in text or b"\xc3\x97" in text or b"\xc3\xb7" in text


class _Numbers(dict):
    """Numbers of words in the order in which they are first looked up; ``new`` lists those that came since it was emptied."""

    def __init__(self):
        self.count, self.new = 0, []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.count
        self.count += 1
        self.new.append(word)
        return n


class Encoder:
    """Ids of texts as bytes, by a model file of the tokenizers library.

    With ``words``, for models that ignore case, drop white space and cut runs of letters from what is around them, texts are cut into such runs and what is between, and
    each distinct part is encoded once, runs of letters many in one call.  Arrow finds the distinct parts among the bytes of many texts.  Parts stay for later texts, some hundred thousand at most.
    """

    def __init__(self, path: str, end_id: int, words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks fill the cores already
        from tokenizers import Tokenizer

        self.model, self.words = Tokenizer.from_file(path), words
        self.width = 2 if max(self.model.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.end = end_id.to_bytes(self.width, "little")
        mark, self.ends_word = getattr(self.model.model, "end_of_word_suffix", None), None
        if mark:
            vocabulary = self.model.get_vocab()
            self.ends_word = np.zeros(1 + max(vocabulary.values()), bool)
            self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith(mark)]] = True
        self.forget()

    def forget(self) -> None:
        """Drop the parts: their numbers, and by number where their ids begin and how many there are."""
        self.known, self.flat = _Numbers(), np.zeros(0, f"<u{self.width}")
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}")

    def _of_letters(self, runs: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and their numbers of runs of letters, encoded as texts of many of them; the pieces that end a word tell whose they are."""
        together = _TOGETHER if self.ends_word is not None else 1
        groups, ids, sizes = [runs[i : i + together] for i in range(0, len(runs), together)], [], []
        for i in range(0, len(groups), _CALL):
            some = groups[i : i + _CALL]
            for group, e in zip(some, self.model.encode_batch_fast([b" ".join(g).decode() for g in some], add_special_tokens=False), strict=True):
                of = np.array(e.ids, f"<u{self.width}")
                ends = np.flatnonzero(self.ends_word[of]) + 1 if together > 1 else np.array([len(of)])
                if len(ends) == len(group) and (not len(ends) or ends[-1] == len(of)):
                    ids.append(of)
                    sizes.append(np.diff(ends, prepend=0))
                else:
                    apart = [self._whole(u.decode()) for u in group]
                    ids += apart
                    sizes.append(np.array([len(x) for x in apart], np.int64))
        return ids, sizes

    @staticmethod
    def _stretches(text: str) -> Iterator[tuple[str, str]]:
        """Stretches of a text without odd words, in lower case, each with the odd word after it, or none at the end."""
        text, at = text.replace("\t", " ").replace("\n", " ").replace("\r", " "), 0
        odd = _ODD.search(text)
        while odd:
            a, b = max(text.rfind(" ", at, odd.start()) + 1, at), text.find(" ", odd.end())
            b = len(text) if b < 0 else b
            yield text[at:a].lower(), text[a:b]
            at = b
            odd = _ODD.search(text, at)
        yield text[at:].lower(), ""

    @classmethod
    def _parts(cls, text: str) -> list[str]:
        """Runs of letters and what stands between these and blanks; odd words stand for themselves, marked.  The plain definition."""
        return [part for clean, odd in cls._stretches(text) for part in [*_PARTS.findall(clean), *([_WHOLE + odd] if odd else [])]]

    def _numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the parts of all texts, one text after another, and how many parts each has."""
        coded, odd = [], []
        for t in texts:
            t = t or ""
            if _has_odd(t.encode()):
                cut = list(self._stretches(t))
                odd += [(_WHOLE + word).encode() for _, word in cut if word]
                coded.append(b"".join(clean.encode() + (b" " + _STAND_IN + b" " if word else b"") for clean, word in cut))
            else:
                coded.append(t.lower().encode())
        firsts = np.cumsum([0, *(len(c) + 1 for c in coded)])
        flat = b"\n".join(coded)
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        kinds = _KIND[np.frombuffer(flat, np.uint8)]
        bounds = np.r_[0, np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, len(flat)].astype(np.int64)
        filled = kinds[bounds[:-1]] != _BLANK
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
        parts = runs.filter(pa.array(filled)).dictionary_encode()
        distinct, at = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy()
        stand_in = distinct.index(_STAND_IN) if odd else -1
        if odd:
            distinct[stand_in] = odd[0]
        found = np.fromiter(map(self.known.__getitem__, distinct), np.int32, len(distinct))[at]
        if odd:
            found[at == stand_in] = [self.known[w] for w in odd]
        return found, np.diff(np.searchsorted(bounds[:-1][filled], firsts))

    def _learn(self) -> None:
        """Encode the parts that are new; long ones lose their number, so that they are not kept as words."""
        new = self.known.new
        letters = [k for k, u in enumerate(new) if _KIND[u[0]] == _LETTER and len(u) <= _LONG]
        rest = np.setdiff1d(np.arange(len(new)), letters)
        ids, sizes = self._of_letters([new[k] for k in letters])
        whole = [self._whole(new[k].decode().removeprefix(_WHOLE)) for k in rest]
        sizes = np.concatenate([*sizes, np.array([len(x) for x in whole], np.int64)])
        starts, order = len(self.flat) + np.cumsum(sizes) - sizes, np.argsort(np.r_[np.array(letters, np.int64), rest])
        self.flat = np.concatenate([self.flat, *ids, *whole])
        self.starts, self.sizes = np.r_[self.starts, starts[order]], np.r_[self.sizes, sizes[order]]
        for u in new:
            if len(u) > _LONG:
                del self.known[u]
        new.clear()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        if not self.words:
            for t in texts:  # one after another, as what the library gives takes many times a text's size
                yield self._whole(t or "").tobytes() + self.end
            return
        if len(self.known) > _KNOWN or len(self.flat) > 20 * _KNOWN:
            self.forget()
        at, counts = self._numbered(texts)
        self._learn()
        sizes = self.sizes[at]
        ids = self.flat[_runs(self.starts[at], sizes)]
        ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]].tolist()
        for a, b in itertools.pairwise(ends):
            yield ids[a:b].tobytes() + self.end


_LOADED: dict[tuple, Encoder] = {}


def encoder_of(path: str, end_id: int, words: bool) -> Encoder:
    """Loaded once in each Python worker, which keeps one at a time without its words: the library leaves some 5 MB behind with each model that has encoded."""
    key = path, end_id, words
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(*key)
    _LOADED[key].forget()
    return _LOADED[key]


def write_token_files(docs: DataFrame, folder: str, model_path: str, *, end_id: int, words: bool = False, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode all documents, write them in ascending order of id below ``folder`` and return the manifest.

    The manifest is (path, n_docs, n_ids, id_bytes, start), ``start`` being the ids in all files before.  ``folder`` is a URI that all
    executors reach; file names are a task attempt's own and the manifest goes through Spark's committer, so a lost executor leaves at most files that
    nothing reads.  A null text counts as empty; every document ends with ``end_id``.  Documents without an id
    come first.  Repeated ids stay apart, in the order of their texts' hashes.  A document longer than ``file_bytes`` gets a file of its own.
    An empty table gives an empty manifest; further columns are ignored.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(model_path)
    name = model_path.rsplit("/", 1)[-1]
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = plain.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    # Ids and copies may repeat without bound; the place of a row tells those apart, so that no range has to hold them all.
    keyed = plain.withColumn("__hash", F.xxhash64("text")).withColumn("__place", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), F.asc("__hash"), F.asc("__place")]
    ordered = keyed.repartitionByRange(max(1, -(-int(size) // file_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, done = encoder_of(SparkFiles.get(name), end_id, words), TaskContext.get().partitionId(), []
        doc_ids, parts, held = [], [], 0

        def write_file() -> None:
            store, root = pafs.FileSystem.from_uri(folder)
            path = f"part-{task:05d}-{len(done):05d}-{uuid.uuid4().hex}.ids"
            store.create_dir(root, recursive=True)
            lengths = np.array([len(p) // coder.width for p in parts])
            with store.open_output_stream(f"{root}/{path}", compression=None) as out:
                out.write(encode_file(doc_ids, lengths, b"".join(parts), coder.width))
            done.append(((task << 32) + len(done), f"{folder}/{path}", len(doc_ids), int(lengths.sum()), coder.width))
            doc_ids.clear()
            parts.clear()

        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for texts in slices(batch.column(1), _SLICE):
                for ids in coder.encode(texts):
                    if held and held + len(ids) > file_bytes:
                        write_file()
                        held = 0
                    doc_ids.append(keys[at])
                    parts.append(ids)
                    held, at = held + len(ids), at + 1
        if doc_ids:
            write_file()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["file", "path", "n_docs", "n_ids", "id_bytes"])
        coder.forget()
        give_back()

    manifest = table_of(ordered.mapInArrow(write, "file bigint, path string, n_docs bigint, n_ids bigint, id_bytes bigint"), "token-manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("file")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def read_token_files(spark: SparkSession, manifest: DataFrame, *, read_bytes: int = READ_BYTES) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document: ids before it in all files, ids with the end id, and these as little-endian 32-bit integers.

    A file is read by several tasks, each of which takes a range of its documents.  No files give no rows.
    """
    pieces = F.least(F.col("n_docs"), F.ceil(F.col("n_ids") * F.col("id_bytes") / read_bytes))
    step = F.ceil(F.col("n_docs") / pieces)
    ranges = manifest.filter("n_docs > 0").withColumn("step", step).select("path", "start", "n_docs", "step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_docs") - 1, F.col("step"))).alias("first"))
    ranges = ranges.select("path", "start", "first", F.least(F.col("first") + F.col("step"), F.col("n_docs")).alias("end"))
    tasks = max(1, min(20_000, ranges.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, path = pafs.FileSystem.from_uri(r["path"])
                with store.open_input_file(path) as file:
                    for doc_ids, bounds, ids in documents_in(file, r["first"], r["end"]):
                        wide = ids.astype("<u4").tobytes()
                        cuts = (bounds - bounds[0]) * 4
                        flat = [wide[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(bounds[:-1] + r["start"]), pa.array(np.diff(bounds)), pa.array(flat, pa.binary())], schema=_READ)
        give_back()

    return ranges.repartition(tasks).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def file_folder(spark: SparkSession) -> str:
    return new_path(spark, "token-ids")
