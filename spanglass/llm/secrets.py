"""Secret scans: three fixed patterns, and a battery of randomness tests for the rest.

The fixed patterns (assignments, access keys, hexadecimal strings) give base spans.
Beyond them, runs of the base64 alphabets' characters are cut at base spans and at "=" (which
stays as padding at the end only), and where they mix the two base64 alphabets, at the separators
of one of them.  A candidate is a part of at least 20 characters that holds a letter and a
digit; so is each of its own parts between separators, for a token at the end of a path, which counts
where the whole does not.  A candidate's encoding is inferred as the
smallest alphabet that holds it, and three tests ask whether its symbols could be drawn
uniformly and independently from that alphabet: chi-squared uniformity, the number
of runs of digits, capitals and small letters, and the lag-one serial correlation.
Fisher's method joins the three p values.

False discoveries.  The battery's p value is large for random strings and small for most ordinary ones (paths, slugs, numbered
names), but not for all, the less so the shorter they are.  So a second p value is taken under the hypothesis that a candidate is
ordinary: the share of ordinary strings of its encoding and length whose battery p is as large.  Ordinary
strings are drawn from a stated model: words whose letters follow one another as in the corpus itself (counts of letter pairs over
all documents), joined and numbered as names are in that encoding.  Far out, where no drawn string comes, the share is that of a normal
distribution of the square root of Fisher's statistic, fitted to the drawn ones' lower tenth (measured on 200,000 further strings of eleven kinds,
it was not below the true share there but for the noise of the draws), so secrets are found however rare they are.  Benjamini-Hochberg at ``fdr`` over all candidates of
an encoding and length class then decides which are not ordinary, so that of the strings flagged in a class
an expected share of at most ``fdr`` is ordinary in that sense; where the class is too short to tell, nothing is flagged.

One pass counts the candidates in classes of battery p (each 1 / ``CLASSES`` wide, rounded down) and the letter pairs.  What
reaches the driver has at most STRATA x CLASSES + 27 ** 2 rows whatever the input.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanglass.llm.memory import give_back, giving_back
from spanglass.llm.shared import table_of

MIN_RANDOM = 20
FDR = 0.05
CLASSES = 200  # of the battery's p
DRAWN = 10_000  # ordinary strings of each class
SHARES = (0.005, 0.01, 0.02, 0.05, 0.1)  # of them, where their distribution is fitted
WORDS = 10_000  # that they are made of
KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")  # one of them is in every assignment
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RANDOM)
VALUE = re.compile(r"[^=]+(?:=+\Z)?")
WITHOUT = {"+/": re.compile(r"[^+/]+"), "-_": re.compile(r"[^_-]+")}
BARE = re.compile(r"[A-Za-z0-9]{%d,}=*" % MIN_RANDOM)

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: From small to large; the first that holds every character is the inferred encoding.
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_RANK = {name: {c: i for i, c in enumerate(of)} for name, of in ALPHABETS.items()}
_SETS = {name: frozenset(of) for name, of in ALPHABETS.items()}


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns; per kind leftmost and not overlapping."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def encoding_of(run: str) -> str | None:
    """The smallest alphabet that holds the run without its padding; none if it mixes alphabets."""
    used = set(run.rstrip("="))
    return next((name for name, of in _SETS.items() if used <= of), None)


def chi2_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom (Wilson and Hilferty's cube root)."""
    if x <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tails(x: np.ndarray, k: int) -> np.ndarray:
    return np.array([chi2_tail(v, k) for v in x.tolist()])


def two_sided(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(v) / math.sqrt(2)) for v in z.tolist()])


def batteries(x: np.ndarray, alphabet: str) -> np.ndarray:
    """p values of uniformity, runs and serial correlation (a row each) of equally long strings of symbol numbers of an alphabet.

    Uniformity is that of all symbols.  Runs are of symbols of one class (digits, capitals, small letters, others), whose
    number is compared with that of symbols drawn uniformly.
    """
    (m, n), size = x.shape, len(alphabet)
    seen = np.zeros((m, size))
    np.add.at(seen, (np.arange(m)[:, None], x), 1)
    uniform = chi2_tails((seen * seen).sum(axis=1) * size / n - n, size - 1)
    classes = np.array([0 if a.isdigit() else 1 if a.isupper() else 2 if a.islower() else 3 for a in alphabet])
    share = np.bincount(classes) / size
    same, three = float((share**2).sum()), float((share**3).sum())
    spread = (n - 1) * same * (1 - same) + 2 * (n - 2) * (three - same * same)
    of = classes[x]
    changes = (of[:, 1:] != of[:, :-1]).sum(axis=1)
    runs = two_sided((changes - (n - 1) * (1 - same)) / math.sqrt(spread))
    c = x - x.mean(axis=1, keepdims=True)
    power = (c * c).sum(axis=1)
    serial = np.where(power > 0, two_sided(((c[:, 1:] * c[:, :-1]).sum(axis=1) / np.where(power > 0, power, 1) * n + 1) / math.sqrt(n)), 2.0 ** (1 - n))
    return np.stack([uniform, runs, serial])


def numbered(runs: list[str], encoding: str) -> np.ndarray:
    """Equally long strings as rows of symbol numbers, without padding."""
    rank = _RANK[encoding]
    return np.array([[rank[c] for c in r.rstrip("=")] for r in runs], np.int64)


def fisher(x: np.ndarray, alphabet: str) -> np.ndarray:
    """Fisher's statistic of the three tests, a number for each string; small for random ones."""
    return -2 * np.log(np.maximum(batteries(x, alphabet), 1e-300)).sum(axis=0)


def battery_ps(x: np.ndarray, alphabet: str) -> np.ndarray:
    """The three tests' p values as one, a number for each string."""
    return chi2_tails(fisher(x, alphabet), 6)


def class_edges() -> np.ndarray:
    """The largest statistic of each class of p and those above it."""
    low, high = np.zeros(CLASSES), np.full(CLASSES, 1000.0)
    least = np.arange(CLASSES) / CLASSES
    for _ in range(60):
        middle = (low + high) / 2
        fits = chi2_tails(middle, 6) >= least
        low, high = np.where(fits, middle, low), np.where(fits, high, middle)
    return low


def ordinary_shares(statistics: np.ndarray) -> np.ndarray:
    """For each class of p, the share of ordinary strings in it or above, from the statistics of drawn ones.

    Counted where some twenty of them are there; further out by the fit, unless what the count allows is less.
    """
    edges, drawn = class_edges(), np.sort(statistics)
    beyond = np.searchsorted(drawn, edges, side="right")
    counted = (1 + beyond) / (1 + len(drawn))
    normal = NormalDist()
    at, roots = np.array([normal.inv_cdf(q) for q in SHARES]), np.sqrt(np.quantile(drawn, SHARES))
    if roots[-1] - roots[0] < 1e-6:
        return counted
    slope, offset = np.polyfit(roots, at, 1)
    fitted = np.array([normal.cdf(v) for v in offset + slope * np.sqrt(edges)])
    allowed = (beyond + 2 * np.sqrt(beyond) + 3) / (1 + len(drawn))
    return np.minimum.accumulate(np.where(beyond >= 20, counted, np.minimum(allowed, fitted)))


def battery_p(run: str, encoding: str) -> float:
    return float(battery_ps(numbered([run], encoding), ALPHABETS[encoding])[0])


def is_candidate(part: str) -> bool:
    return len(part.rstrip("=")) >= MIN_RANDOM and any(c.isdigit() for c in part) and any(c.isalpha() for c in part)


def unmixed(value: str) -> list[tuple[int, int]]:
    """The candidates within ``value`` of one alphabet each, before they are cut at their own separators.

    A mixed value is cut at slashes, as a path is; with a plus it is more likely base64 and is cut at dashes.  The
    other cut serves where the first leaves no candidate.
    """
    if encoding_of(value) is not None:
        return [(0, len(value))] if is_candidate(value) else []
    found: list[tuple[int, int]] = []
    for cut in ("-_", "+/") if "+" in value else ("+/", "-_"):
        more = [m.span() for m in WITHOUT[cut].finditer(value) if is_candidate(m[0])]
        found += [(a, b) for a, b in more if not any(x < b and a < y for x, y in found)]
    return found


def stretches(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """(start, end) of all candidates; those cut at a candidate's own separators lie within it."""
    found = []
    for run in RUN.finditer(text):
        at, free = run.start(), []
        for s, _, e in base:
            if s < run.end() and at < e:
                free.append((at, s))
                at = e
        for a, b in [*free, (at, run.end())]:
            for v in VALUE.finditer(text[a:b]) if b - a >= MIN_RANDOM else ():
                for x, y in unmixed(v[0]):
                    at_x, part = a + v.start() + x, v[0][x:y]
                    spans = {(0, len(part)), *(m.span() for m in BARE.finditer(part) if is_candidate(m[0]))}
                    found += [(at_x + i, at_x + j) for i, j in sorted(spans)]
    return found


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, int, str, int]]:
    """(start, end, stratum, class of p) of the stretches that the battery judges."""
    found = []
    for a, b in stretches(text, base):
        part = text[a:b]
        encoding = encoding_of(part)
        found.append((a, b, stratum_of(encoding, len(part.rstrip("="))), min(CLASSES - 1, int(battery_p(part, encoding) * CLASSES))))
    return found


def stratum_of(encoding: str, length: int) -> str:
    """Encoding and length class; classes grow by a factor of the square root of two."""
    return f"{encoding}/{min(10, int(2 * math.log2(length / MIN_RANDOM)))}"


def shortest(at: int) -> int:
    return math.ceil(MIN_RANDOM * 2 ** (at / 2) - 1e-9)


def outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Without the spans that lie within another."""
    kept: list[tuple[int, int]] = []
    for a, b in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if not kept or b > kept[-1][1]:
            kept.append((a, b))
    return kept


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: What stands between the words of a name in an encoding, and whether words begin with a capital.
JOINTS = {"base64": ("/", False), "base64url": ("-_", False), "base62": ("", True)}


def ordinary_words(pairs: np.ndarray, rng: np.random.Generator, n: int = WORDS) -> list[str]:
    """Words of 3 to 9 letters that follow one another as in ``pairs`` (27 x 27; 0 is the word's edge)."""
    steps = np.cumsum(pairs + 0.01, axis=1)
    steps /= steps[:, -1:]
    at, out = np.zeros(n, np.int64), np.zeros((n, 9), np.int64)
    for i in range(9):  # all words take a letter at a time; one that ends too early draws again from its last letter
        new = (steps[at] < rng.random((n, 1))).sum(axis=1)
        for _ in range(20 if i < 3 else 0):
            early = new == 0
            new[early] = (steps[at[early]] < rng.random((int(early.sum()), 1))).sum(axis=1)
        new = np.where((i >= 3) & (at == 0), 0, np.minimum(new, 26))
        at = out[:, i] = new
    return ["".join(_LETTERS[k - 1] for k in row if k) for row in out.tolist()]


def ordinary_strings(encoding: str, length: int, words: list[str], rng: np.random.Generator, n: int = DRAWN) -> list[str]:
    """Names as people write them, from words with a number somewhere.

    Letters that the encoding lacks are left out; an encoding with few letters gives mostly digits, as in codes and dates.
    """
    alphabet, upper = _SETS[encoding], encoding in ("HEX", "base32", "BASE36")
    allowed = {c for c in _LETTERS if (c.upper() if upper else c) in alphabet}
    digits = [c for c in _DIGITS if c in alphabet]
    joint, capitals = JOINTS.get(encoding, ("", False))
    if few := len(allowed) < 20:
        words = [w for w in ("".join(c for c in w if c in allowed) for w in words) if w]
    out = []
    for _ in range(n):
        made, size, number_at = [], 0, int(rng.integers(0, length - 1))
        while size < length:
            if size >= number_at or (few and rng.random() < 0.6):
                part = "".join(digits[k] for k in rng.integers(0, len(digits), int(rng.integers(1, 5))))
                number_at = length
            else:
                part = words[int(rng.integers(0, len(words)))]
                part = (joint[int(rng.integers(0, len(joint)))] if made and joint else "") + (part.capitalize() if capitals else part)
            made.append(part)
            size += len(part)
        name = "".join(made)[:length]
        out.append(name.upper() if upper else name)
    return out


def cutoffs(counts: list[tuple[str, int, int]], pairs: np.ndarray, fdr: float = FDR, seed: int = 0) -> dict[str, int]:
    """Benjamini-Hochberg from (stratum, class, count): candidates of classes at or above a stratum's cutoff are taken for secrets."""
    by: dict[str, dict[int, int]] = {}
    for stratum, at, n in counts:
        by.setdefault(stratum, {})[at] = n
    out, rng = {}, np.random.default_rng(seed)
    words = ordinary_words(pairs, rng)
    for stratum, of in sorted(by.items()):
        encoding, at = stratum.split("/")
        ordinary = ordinary_strings(encoding, shortest(int(at)), words, rng)
        shares = ordinary_shares(fisher(numbered(ordinary, encoding), ALPHABETS[encoding]))
        total, so_far, cut = sum(of.values()), 0, CLASSES
        for k in sorted(of, reverse=True):
            so_far += of[k]
            if shares[k] <= fdr * so_far / total:
                cut = k
        out[stratum] = cut
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def letter_pairs(text: str, into: np.ndarray) -> None:
    """Count the neighbouring letters of the words of ``text``; 0 is a word's edge."""
    codes = np.frombuffer(text.lower().encode("ascii", "replace"), np.uint8).astype(np.int64) - 96
    codes = np.r_[0, np.where((codes >= 1) & (codes <= 26), codes, 0), 0]
    into += np.bincount(codes[:-1] * 27 + codes[1:], minlength=729)


def _counts(texts: DataFrame) -> DataFrame:
    """(stratum, at, n): the candidates of each class, and under the stratum "pairs" the letter pairs; summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        pairs = np.zeros(729, np.int64)
        for batch in batches:
            for x in batch.column(0):
                if text := x.as_py():
                    found.update((s, k) for _, _, s, k in candidates(text, base_spans(text)))
                    letter_pairs(text, pairs)
        rows = [(s, k, n) for (s, k), n in found.items()] + [("pairs", k, int(n)) for k, n in enumerate(pairs.tolist()) if n]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64()), strict=True)], ["stratum", "at", "n"])

    return texts.mapInArrow(giving_back(count), "stratum string, at int, n bigint").groupBy("stratum", "at").agg(F.sum("n").alias("n"))


def found_in(text: str, cut: dict[str, int]) -> list[dict]:
    """All spans of a text, by start and then kind."""
    base = base_spans(text)
    more = [(a, "random", b) for a, b in outermost([(a, b) for a, b, s, k in candidates(text, base) if k >= cut.get(s, CLASSES)])]
    return [{"kind": k, "start": a, "end": b} for a, k, b in sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1])))]


def without(text: str, spans: list[dict], mark: str) -> str:
    """The text with every stretch under a span replaced by ``mark``."""
    parts, at = [], 0
    for s in spans:
        if s["end"] > at:
            if s["start"] >= at:
                parts += [text[at : s["start"]], mark]
            at = s["end"]
    return "".join(parts) + text[at:]


def corpus_cutoffs(docs: DataFrame, text_col: str, fdr: float) -> dict[str, int]:
    counts = table_of(_counts(docs.select(F.col(text_col).cast("string").alias("text"))), "secret-counts")  # which bounds the batches of texts
    rows = [tuple(r) for r in counts.collect()]  # at most some thousands, see above
    pairs = np.zeros(729)
    for _, k, n in (r for r in rows if r[0] == "pairs"):
        pairs[k] = n
    return cutoffs([r for r in rows if r[0] != "pairs"], pairs.reshape(27, 27), fdr)


def secret_spans(docs: DataFrame, *, text_col: str = "text", fdr: float = FDR, into: str = "secrets") -> DataFrame:
    """``docs`` with a column ``into``: array of struct(kind, start, end), by start and then kind.

    Offsets are code points, ends exclusive.  A null or empty text has no spans, and an
    empty table gives an empty one.  Spans of the kinds in the fixed patterns depend on the
    text alone; ``random`` ones also on the corpus, through the false-discovery control.
    Repeated rows are each scanned; other columns pass through, one named ``into`` is replaced.
    """
    cut = corpus_cutoffs(docs, text_col, fdr)

    @F.arrow_udf(T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType())))
    def find(texts: pa.Array) -> pa.Array:
        return pa.array((found_in(x.as_py() or "", cut) for x in texts), pa.list_(_SPAN))

    return docs.withColumn(into, find.asNondeterministic()(F.col(text_col).cast("string")))


def without_secrets(docs: DataFrame, *, text_col: str = "text", fdr: float = FDR, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every stretch under a span of ``secret_spans`` replaced by ``mark``, in one pass; a null text stays null."""
    cut = corpus_cutoffs(docs, text_col, fdr)

    @F.arrow_udf(T.StringType())
    def redact(texts: pa.Array) -> pa.Array:
        out = pa.array((None if (t := x.as_py()) is None else without(t, found_in(t, cut), mark) for x in texts), pa.string())
        give_back()
        return out

    return docs.withColumn(text_col, redact.asNondeterministic()(F.col(text_col).cast("string")))


def redacted(spans: str = "secrets", text_col: str = "text", mark: str = "[secret]") -> Column:
    """The text with every stretch under a span replaced by ``mark``."""

    @F.arrow_udf(T.StringType())
    def redact(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array((t if t is None or not f else without(t, f, mark) for t, f in zip(texts.to_pylist(), found.to_pylist(), strict=True)), pa.string())

    return redact(F.col(text_col), F.col(spans))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
