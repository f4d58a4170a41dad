"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is escaped as the model asks (spaces become U+2581, one is put in front) and cut into marked
words, a run of marks with what follows it; no piece crosses such a cut, so words
can be encoded one by one.  Each Arrow batch takes the set of its distinct words, sorts
it, and walks the trie that the sorted words form: the forward column of a
prefix is computed once, so words that share a prefix share it.  For BPE models the trie
is walked by levels, all prefixes of one length in arrays at once; unigram models and very long words go
through it depth-first, with the column of the word before on a stack.

What a forward column holds depends on the model:

* unigram: the best score of a segmentation of the prefix, and its last piece (Viterbi).
* BPE: merging by rank is no sum of scores, so the path that is kept is the one that merging
  would give.  Its last piece is unique for each prefix: a piece may follow another
  only if encoding their joined text gives these two pieces back, and a sequence is
  what merging gives exactly if all its neighbours are such.  Whether two pieces
  go together is decided once and remembered.

Characters that no piece holds become byte pieces, or the unknown piece in a model without those.
"""

from __future__ import annotations

import array
import heapq
import itertools
import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanglass.llm.hashing import slices
from spanglass.llm.memory import give_back

MARK = "▁"
UNIGRAM, BPE = 1, 2
_SLICE = 8_000_000  # bytes of text whose distinct words are held at once
_PAIRS = 300_000  # remembered at once in the walk of long words, some 100 bytes each
_SORTED_PAIRS = 1_000_000  # remembered at once in the walk by levels, 9 bytes each
_DEEP = 200  # characters; longer words are walked one by one, as each level costs some array calls
_LEVEL_CHARS = 300_000  # of words that are walked by levels at once, some 100 bytes each
_TOGETHER = 100  # texts that are decoded by Arrow at once
_UNK_PENALTY = 10.0


class Endings:
    """The trie of the pieces read from their ends, as sorted arrays."""

    def __init__(self, ids: dict[str, int]):
        chars = sorted({ord(c) for p in ids for c in p})
        self.kinds = len(chars) + 1
        self.kind = np.zeros(0x110000, np.int32)  # of each code point; 0 for those that no piece holds
        self.kind[chars] = np.arange(1, self.kinds)
        states, edges = {"": 0}, {}
        for p in ids:
            above = 0
            for i in range(len(p) - 1, -1, -1):
                below = states.setdefault(p[i:], len(states))
                edges[above * self.kinds + int(self.kind[ord(p[i])])] = below
                above = below
        self.edges = np.array(sorted(edges), np.int64)
        self.below = np.array([edges[e] for e in self.edges.tolist()], np.int32)
        self.piece = np.array([ids.get(s, -1) for s in states], np.int32)

    def pieces_at(self, chars: np.ndarray, at: np.ndarray, depth: np.ndarray, unknown: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that end at the places ``at`` and begin in the same word, from large to small, their sizes, and where those of each place begin (one more than places).

        A character that is no piece counts as the number ``unknown`` + code point.
        """
        alive, state, found = np.arange(len(at), dtype=np.int32), np.zeros(len(at), np.int64), []
        kinds, counts = self.kind[chars], np.ones(len(at), np.int32)
        for back in itertools.count():
            key = state * self.kinds + kinds[at[alive] - back]
            edge = np.searchsorted(self.edges, key)
            edge[edge == len(self.edges)] = 0
            known = self.edges[edge] == key
            alive, state = alive[known], self.below[edge[known]].astype(np.int64)
            piece = self.piece[state]
            if back:
                found.append((alive[piece >= 0], piece[piece >= 0]))
                counts[found[-1][0]] += 1
            else:
                single = chars[at] + unknown
                single[alive[piece >= 0]] = piece[piece >= 0]
            longer = depth[at[alive]] > back
            alive, state = alive[longer], state[longer]
            if not len(alive):
                break
        begin = np.r_[0, np.cumsum(counts, dtype=np.int32)].astype(np.int32)
        pieces, sizes, free = np.empty(begin[-1], np.int32), np.empty(begin[-1], np.int16), begin[1:] - 1
        for size, (places, piece) in enumerate([(slice(None), single), *found], 1):
            pieces[free[places]] = piece
            sizes[free[places]] = size
            free[places] -= 1
        return pieces, sizes, begin


@dataclass
class Model:
    """The pieces of a model; only those of normal kind can be matched."""

    kind: int
    pieces: list[str]
    scores: list[float]
    ids: dict[str, int]
    byte_ids: list[int] | None
    unk: int
    prefix: bool
    collapse: bool
    longest: int
    cut: re.Pattern
    pairs: dict = field(default_factory=dict)
    unk_score: float = 0.0
    lengths: list[int] = field(default_factory=list)
    spelled: list[bytes] = field(default_factory=list)  # what each id stands for
    tails: dict[str, tuple] = field(default_factory=dict)  # the last three (or two) characters of pieces: their sizes, from large
    endings: Endings | None = None
    pair_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted, with what ``joins`` says of each
    pair_fits: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    @classmethod
    def load(cls, blob: bytes) -> Model:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type not in (UNIGRAM, BPE) or norm.precompiled_charsmap or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models without character rewriting and with marks in front of words are read")
        kinds = [p.type for p in proto.pieces]
        pieces, scores = [p.piece for p in proto.pieces], [p.score for p in proto.pieces]
        if 4 in kinds or 5 in kinds:
            raise ValueError("models with user-defined or unused pieces are not read")
        ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 1}
        byte_of = {i: int(p[3:5], 16) for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 6}
        byte_ids = [i for i, _ in sorted(byte_of.items(), key=lambda x: x[1])] if len(byte_of) == 256 else None
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece crosses the start of a marked word")
        # A line end that only stands alone is a place to cut at, too.
        ends = "" if any("\n" in p and p != "\n" for p in ids) else "\n"
        cut = re.compile(f"{MARK}*[^{MARK}{ends}]+|{MARK}+" + ("|\n" if ends else ""))
        made = cls(proto.trainer_spec.model_type, pieces, scores, ids, byte_ids, kinds.index(2), norm.add_dummy_prefix, norm.remove_extra_whitespaces, max(map(len, ids)), cut)
        made.unk_score = min((scores[i] for i in ids.values()), default=0.0) - _UNK_PENALTY
        sizes: dict[str, set[int]] = {}
        for p in ids:
            if len(p) > 1:
                sizes.setdefault(p[-2:], {1}).update({len(p)} if len(p) == 2 else ())
            if len(p) > 2:
                sizes.setdefault(p[-3:], {1}).add(len(p))
        if made.kind == BPE:
            made.endings = Endings(ids)
        made.lengths = list(map(len, pieces))
        made.spelled = [b"" if k == 3 else bytes([byte_of[i]]) if k == 6 else " ⁇ ".encode() if k == 2 else p.replace(MARK, " ").encode() for i, (p, k) in enumerate(zip(pieces, kinds, strict=True))]
        made.tails = {t: tuple(sorted(of | ({2} if len(t) == 3 and t[1:] in ids else set()), reverse=True)) for t, of in sizes.items()}
        return made

    def escaped(self, text: str) -> str:
        if self.collapse:
            text = re.sub(" +", " ", text.strip(" "))
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    # -- BPE

    def merged(self, text: str) -> list[str]:
        """Merging by score, leftmost first among equals; the plain definition."""
        parts = list(text)
        nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list = []

        def offer(i: int) -> None:
            if i >= 0 and nxt[i] < len(parts) and (k := self.ids.get(parts[i] + parts[nxt[i]])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, parts[i] + parts[nxt[i]]))

        for i in range(len(parts)):
            offer(i)
        alive = [True] * len(parts)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = nxt[i] if alive[i] else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != to:
                continue
            parts[i], alive[j], nxt[i] = to, False, nxt[j]
            if nxt[i] < len(parts):
                prv[nxt[i]] = i
            offer(prv[i])
            offer(i)
        return [p for p, a in zip(parts, alive, strict=True) if a]

    def spell(self, k: int) -> str:
        """A piece's text; numbers from the vocabulary's size on are characters that are no piece."""
        return self.pieces[k] if k < len(self.pieces) else chr(k - len(self.pieces))

    def joins(self, a: int, b: int) -> bool:
        """Whether merging the text of two pieces gives just these two; a < 0 stands for the start of a word."""
        first, second = self.spell(a) if a >= 0 else "", self.spell(b)
        return self.merged(first + second) == ([first, second] if first else [second])

    def walk_bpe(self, word: str, same: int, column: list[int]) -> None:
        """Add to ``column`` the last piece of the encoding of each longer prefix of ``word``."""
        pairs, ids, tails, size_of_vocabulary = self.pairs, self.ids, self.tails, len(self.pieces)
        for n in range(same + 1, len(word) + 1):
            for size in tails.get(word[n - 3 : n] if n > 2 else "") or tails.get(word[max(0, n - 2) : n]) or (1,):
                if size > n:
                    continue
                k = ids.get(word[n - size : n])
                if k is None:
                    if size > 1:
                        continue
                    k = size_of_vocabulary + ord(word[n - 1])
                before = column[n - size]
                ok = pairs.get(before << 24 | k)
                if ok is None:
                    if len(pairs) >= _PAIRS:
                        pairs.clear()
                    ok = pairs[before << 24 | k] = self.joins(before, k)
                if ok:
                    column.append(k)
                    break
            else:
                raise AssertionError(f"no encoding of {word[:n]!r}")

    def fit(self, keys: np.ndarray, fresh: dict[int, bool]) -> np.ndarray:
        """Which pairs (a << 24 | b) go together; what was not remembered is added to ``fresh``."""
        if not len(self.pair_keys):
            known, fits = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        else:
            i = np.searchsorted(self.pair_keys, keys)
            i[i == len(self.pair_keys)] = 0
            known, fits = self.pair_keys[i] == keys, self.pair_fits[i]
        if not known.all():
            some, of = np.unique(keys[~known], return_inverse=True)
            for k in some.tolist():
                if k not in fresh:
                    fresh[k] = self.joins(k >> 24, k & 0xFFFFFF)
            fits[~known] = np.fromiter(map(fresh.__getitem__, some.tolist()), bool, len(some))[of]
        return fits

    def remember(self, fresh: dict[int, bool]) -> None:
        if len(self.pair_keys) + len(fresh) > _SORTED_PAIRS:
            self.pair_keys, self.pair_fits = self.pair_keys[:0], self.pair_fits[:0]
        if fresh:
            keys = np.r_[self.pair_keys, np.fromiter(fresh, np.int64, len(fresh))]
            fits, order = np.r_[self.pair_fits, np.fromiter(fresh.values(), bool, len(fresh))], np.argsort(keys, kind="stable")
            self.pair_keys, self.pair_fits = keys[order], fits[order]

    def walk_levels(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of sorted distinct words (BPE) one after another, and how many each has; numbers as in ``spell``.

        Places are those of the words' characters, one word after another.  A place stands for the prefix that ends there, and a prefix
        that the word before has, too, is read from there.
        """
        sizes = np.fromiter(map(len, words), np.int32, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
        first = (np.cumsum(sizes) - sizes).astype(np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        depth = np.arange(len(chars), dtype=np.int32) - first[word]
        before = np.r_[np.int32(0), sizes[:-1]]  # the size of the word before
        beside = np.flatnonzero(depth < before[word])
        differs = np.ones(len(chars), bool)
        differs[beside] = chars[beside] != chars[beside - before[word[beside]]]
        differing = np.flatnonzero(differs)
        own = depth >= (differing[np.searchsorted(differing, first)] - first)[word]  # no word before has this prefix
        levels = np.argsort(depth.astype(np.uint8), kind="stable").astype(np.int32)
        same = np.empty(len(chars), np.int32)  # the place that a prefix is read from
        same[levels] = levels[np.maximum.accumulate(np.where(own[levels], np.arange(len(chars), dtype=np.int32), 0))]
        levels = levels[own[levels]]
        pieces, lengths, begin = self.endings.pieces_at(chars, levels, depth, len(self.pieces))
        column, fresh = np.empty(len(chars), np.int32), {}
        bounds = np.r_[0, np.cumsum(np.bincount(depth[levels]))]
        for level, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
            at, next_one, end = levels[a:b], begin[a:b], begin[a + 1 : b + 1]
            while len(at):
                if (next_one >= end).any():
                    raise AssertionError(f"no encoding of {words[word[at[next_one >= end][0]]][: level + 1]!r}")
                piece, back = pieces[next_one], at - lengths[next_one]
                inside = lengths[next_one] <= level
                key = np.full(len(at), -1, np.int64)
                key[inside] = column[same[back[inside]]]
                fits = self.fit(key << 24 | piece, fresh)
                column[at[fits]] = piece[fits]
                at, next_one, end = at[~fits], next_one[~fits] + 1, end[~fits]
        self.remember(fresh)
        column = column[same]
        length_of = np.array(self.lengths, np.int32)
        left, at, counts, found = sizes.copy(), np.arange(len(words)), np.zeros(len(words), np.int32), []
        while len(at):  # backwards from each word's last piece
            piece = column[first[at] + left[at] - 1]
            counts[at] += 1
            found.append((at, piece))
            left[at] -= np.where(piece < len(length_of), length_of[np.minimum(piece, len(length_of) - 1)], 1)
            at = at[left[at] > 0]
        ends, out = np.cumsum(counts), np.empty(int(counts.sum()), np.int32)
        for i, (at, piece) in enumerate(found, 1):
            out[ends[at] - i] = piece
        return out, counts.astype(np.int64)

    def spelled_out(self, pieces: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with byte pieces, or the unknown one, for characters that are no piece."""
        strange = np.flatnonzero(pieces >= len(self.pieces))
        if not len(strange):
            return pieces, counts
        chars, of = np.unique(pieces[strange], return_inverse=True)
        codes = [[self.byte_ids[b] for b in self.spell(k).encode()] if self.byte_ids else [self.unk] for k in chars.tolist()]
        size = np.ones(len(pieces), np.int64)
        size[strange] = np.array([len(c) for c in codes])[of]
        ends = np.cumsum(size)
        out = np.repeat(pieces, size)
        flat, begin = np.array(list(itertools.chain(*codes)), np.int32), np.cumsum([0, *map(len, codes)])[:-1]
        out[_runs((ends - size)[strange], size[strange])] = flat[_runs(begin[of], size[strange])]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return out, np.diff(bounds)

    # -- unigram

    def walk_unigram(self, word: str, same: int, column: list[int], scores: list[float]) -> None:
        """Add to ``scores`` the best score of each longer prefix of ``word``, and to ``column`` the piece that ends it."""
        for n in range(same + 1, len(word) + 1):
            best, last = -math.inf, -1
            for size in range(1, min(self.longest, n) + 1):
                k = self.ids.get(word[n - size : n])
                if k is None and size > 1:
                    continue
                total = scores[n - size] + (self.unk_score if k is None else self.scores[k])
                if total > best:
                    best, last = total, len(self.pieces) + ord(word[n - 1]) if k is None else k
            scores.append(best)
            column.append(last)

    # -- the trie walk

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all distinct words one after another, and how many each has, both in the order given.

        In sorted order, words with a common prefix follow one another.
        """
        order = sorted(range(len(words)), key=words.__getitem__)
        words = list(map(words.__getitem__, order))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        deep = sizes > (_DEEP if self.endings else 0)
        parts = [self.walk_words([words[k] for k in np.flatnonzero(deep)])]
        if deep.any():
            order = np.r_[np.array(order)[deep], np.array(order)[~deep]]
            words, sizes = [words[k] for k in np.flatnonzero(~deep)], sizes[~deep]
        ends, begin = np.cumsum(sizes), 0
        while begin < len(words):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _LEVEL_CHARS, side="right")))
            parts.append(self.spelled_out(*self.walk_levels(words[begin:end])))
            begin = end
        flat_ids, counted = (np.concatenate(x) for x in zip(*parts, strict=True))
        rank = np.empty(len(counted), np.int64)
        rank[order] = np.arange(len(counted))
        starts = (np.cumsum(counted) - counted)[rank]
        counted = counted[rank]
        return flat_ids[_runs(starts, counted)], counted

    def walk_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sorted distinct words and how many each has; depth-first, word by word."""
        column, scores = [-1], [0.0]  # one entry for each character of the word before
        before, byte_ids, lengths, size_of_vocabulary = "", self.byte_ids, self.lengths, len(self.pieces)
        flat, counts = array.array("i"), array.array("i")
        for word in words:
            same = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                same += 1
            del column[same + 1 :]
            if self.kind == BPE:
                self.walk_bpe(word, same, column)
            else:
                del scores[same + 1 :]
                self.walk_unigram(word, same, column, scores)
            ids: list[int] = []
            n = len(word)
            while n:  # backwards from the last piece
                k = column[n]
                if k < size_of_vocabulary:
                    ids.append(k)
                    n -= lengths[k]
                    continue
                if byte_ids:
                    ids += [byte_ids[b] for b in reversed(word[n - 1].encode())]
                else:
                    ids.append(self.unk)
                n -= 1
            ids.reverse()
            flat.extend(ids)
            counts.append(len(ids))
            before = word
        return np.frombuffer(flat, np.int32), np.frombuffer(counts, np.int32).astype(np.int64)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of each text; the distinct words of all are held at once."""
        index: dict[str, int] = defaultdict(itertools.count().__next__)  # by first occurrence
        flat, counts = array.array("i"), []
        for text in texts:
            words = self.cut.findall(self.escaped(text or ""))
            flat.extend(map(index.__getitem__, words))
            counts.append(len(words))
        return self._ids(texts, list(index), np.frombuffer(flat, np.int32), np.array(counts))

    def _ids(self, texts: list[str | None], distinct: list[str], at: np.ndarray, counts: np.ndarray) -> pa.ListArray:
        known, sizes = self.encode_words(distinct)
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[at]
        ids = known[_runs(starts[at], lengths)]
        ends = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)]]
        if not self.byte_ids:  # neighbouring unknown pieces of a text count as one
            keep = np.ones(len(ids), bool)
            keep[1:] = (ids[1:] != self.unk) | (ids[:-1] != self.unk)
            keep[ends[:-1][ends[:-1] < len(ids)]] = True
            ends = np.r_[0, np.cumsum(keep)][ends]
            ids = ids[keep]
        null = np.array([t is None for t in texts], bool)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(null))

    def gives_back(self, ids: pa.ListArray, texts: list[str | None]) -> pa.BooleanArray:
        """Whether decoding gives each text; true for null.  Spelled by Arrow; what differs in its bytes is decoded one by one."""
        pieces, parts = pa.array(self.spelled, pa.binary()), [np.zeros(0, bool)]
        for k in range(0, len(texts), _TOGETHER):
            some, want = ids[k : k + _TOGETHER], pa.array(texts[k : k + _TOGETHER], pa.string()).cast(pa.binary())
            spelled = pc.binary_join(pa.ListArray.from_arrays(pc.subtract(some.offsets, some.offsets[0]), pieces.take(some.flatten())), b"")
            if self.prefix:
                spelled = pc.if_else(pc.starts_with(spelled, " "), pc.binary_replace_slice(spelled, 0, 1, b""), spelled)
            same = pc.fill_null(pc.equal(spelled, want), True).to_numpy(zero_copy_only=False).copy()
            for i in np.flatnonzero(~same).tolist():
                same[i] = self.decode(some[i].as_py()) == texts[k + i]
            parts.append(same)
        return pa.array(np.concatenate(parts), pa.bool_())

    def decode(self, ids: list[int] | None) -> str | None:
        """The text; byte pieces that are no UTF-8 give U+FFFD, unknown ones " ⁇ ", control ones nothing."""
        if ids is None:
            return None
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then those of starts[1], and so on."""
    at = np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes)  # of a slice's ids, far fewer than 2 ** 31
    at += np.arange(len(at), dtype=np.int32)
    return at


_LOADED: dict[str, Model] = {}


def _model(name: str) -> Model:
    """Loaded once in each Python worker."""
    if name not in _LOADED:
        with open(SparkFiles.get(name), "rb") as f:
            _LOADED[name] = Model.load(f.read())
    return _LOADED[name]


def share_model(spark: SparkSession, path: str) -> str:
    """Send the model file (a few hundred KB) to all executors; gives its name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encoded(text: str | Column, model: str) -> Column:
    """array<int> of piece ids; null for null, empty for an empty text.  ``model`` is a shared one's name."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        m = _model(model)
        parts = []
        for part in slices(texts, _SLICE):
            parts.append(m.encode(part))
            give_back()
        return pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *parts])

    return encode.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


_CODED = pa.struct([("ids", pa.list_(pa.int32())), ("exact", pa.bool_())])


def encoded_and_checked(text: str | Column, model: str) -> Column:
    """struct(ids, exact): the ids, and whether decoding them gives the text back; one pass for both."""

    @F.arrow_udf(T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("exact", T.BooleanType()))
    def encode(texts: pa.Array) -> pa.Array:
        m, parts = _model(model), [pa.array([], _CODED)]
        for plain in slices(texts, _SLICE):
            ids = m.encode(plain)
            parts.append(pa.StructArray.from_arrays([ids, m.gives_back(ids, plain)], fields=list(_CODED)))
            del plain, ids
            give_back()
        return pa.concat_arrays(parts)

    return encode.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def decoded(ids: str | Column, model: str) -> Column:
    """The text of piece ids; null for null, empty for no ids.  For models without character rewriting, the inverse of ``encoded``."""

    @F.arrow_udf(T.StringType())
    def decode(rows: pa.Array) -> pa.Array:
        m = _model(model)
        return pa.array((m.decode(r.as_py()) for r in rows), pa.string())

    return decode(F.col(ids) if isinstance(ids, str) else ids)

