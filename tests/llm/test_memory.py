import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from spanglass.llm import hashing, language, sentencepieces
from spanglass.llm.memory import give_back, giving_back


def test_work_is_the_same_and_ends_with_giving_back():
    give_back()
    batch = pa.record_batch({"x": [1, 2]})
    twice = giving_back(lambda batches: (b for b in batches for _ in range(2)))
    assert list(twice(iter([batch]))) == [batch, batch] and list(twice(iter([]))) == []

    def fails(batches):
        yield next(batches)
        raise ValueError("x")

    with pytest.raises(ValueError, match="x"):
        list(giving_back(fails)(iter([batch])))


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_emissions_hold_the_ngrams_of_few_words(monkeypatch):
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, x)) for x in rng.integers(97, 123, (50_000, 8)).tolist()]
    model = language.Crf(["a", "b", "c"], rng.random((language.BUCKETS, 3), np.float32), {words[7]: 1}, rng.random((2, 3), np.float32), np.zeros((3, 3)))
    assert peak_mb(lambda: model.emissions(words)) < 20
    found = model.emissions(words)
    monkeypatch.setattr(language, "_WORDS", len(words), raising=False)
    assert np.array_equal(found, model.emissions(words))


def test_runs_of_ids_take_little_more_than_the_ids():
    starts, sizes = np.arange(100) * 7, np.full(100, 20_000)
    assert peak_mb(lambda: sentencepieces._runs(starts, sizes)) < 20
    assert sentencepieces._runs(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_slices_are_small():
    texts = pa.array(["x" * 1000] * 5000)
    assert max(sum(map(len, part)) for part in hashing.slices(texts)) <= 2_000_000
    assert sum(len(part) for part in hashing.slices(texts)) == 5000
