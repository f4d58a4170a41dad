"""Hashes of the words of texts, many texts at a time."""

from __future__ import annotations

import array
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SLICE = 2_000_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def slices(texts: pa.Array, most: int = _SLICE) -> Iterator[list[str | None]]:
    """The texts of an Arrow array as Python lists of at most ``most`` bytes each, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield texts.slice(start, end - start).to_pylist()
        start = end


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """64-bit hashes of each text's words: runs of other than ASCII white space, A-Z in lower case."""
    start = 0
    while start < len(texts):
        index: dict[bytes, int] = defaultdict(itertools.count().__next__)  # distinct words of _SLICE characters, or of one text
        at, counts, held = array.array("i"), [], 0
        while start < len(texts) and (not counts or held + len(texts[start] or "") <= _SLICE):
            words = (texts[start] or "").encode().lower().split()
            at.extend(map(index.__getitem__, words))
            counts.append(len(words))
            held += len(texts[start] or "")
            start += 1
        known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in index), np.uint64, len(index))
        hashes = known[np.frombuffer(at, np.int32)] if at else known[:0]
        first = 0
        for n in counts:
            yield hashes[first : first + n]
            first += n
