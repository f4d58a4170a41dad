"""N-gram Jaccard self-join and its classes of near duplicates.

A document is the set of its distinct 5-word shingles, as 64-bit hashes.  Two link when the Jaccard
coefficient of their sets is at least 0.8.

Tiles.  Sets are put in bands by size, and a band divides the hash range into m equal parts, a few
elements in each.  Linked sets of a and b elements differ in at most H = (a + b) / 9 elements
and each of these spoils one part, so the first part (in hash order) that is not empty and not
spoiled is among the first H + 1 non-empty parts of both.  Each set is therefore filed under
the contents of its first H + 1 non-empty parts, in its own band and in the band below if a
partner can be there.  The sets filed under one key make a tile; unlike single
shingles, a part's whole contents are rarely shared by chance, even through a passage
that many documents hold.  Keys with the same members give one tile.  (A set with no more
than H non-empty parts would escape; with hashed elements and at most 3 for each part on average,
from 48 elements on, that is further than six standard deviations away.  Smaller sets have parts of
one element, where it can't happen.)

Bitmaps.  In a tile each set has a bitmap with the parity of the elements hashed to
each bit.  The bits in which two differ number at most the elements in which the sets
differ, so (a + b - bits) / 2 bounds the overlap from above.  Pairs that this bound
or their sizes rule out go.

Exact check.  First only a spanning forest of the pairs left in each tile is checked, on sorted arrays
of the shingles made from the texts, and linked sets are contracted.  Then, in tiles with an edge that did not end in one class, every pair
left between different classes is checked.  So no link between classes is lost.

Large tiles.  A tile of over ``BLOCK`` sets is first cut into blocks, each worked off by itself, without a copy of a row.
Then each class that is left in the tile sends one set, these are cut into blocks in the same way, and
so on while that brings classes together; a group of near copies is one class or a few by then.  Last, the sets outside the
tile's largest class are held against all of the tile, and the largest class is not held against itself.
Rows are copied once for each ``BLOCK`` sets outside the largest class, and only those sets once for each block of the tile.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanglass.llm.bitsets import KeySet
from spanglass.llm.components import components
from spanglass.llm.hashing import mixed, slices, word_hashes
from spanglass.llm.memory import give_back, giving_back
from spanglass.llm.shared import table_of

WORDS = 5
SMALL = 48  # sets below have parts of one element
BLOCK = 1024
SMALL_TILE = 6  # rows
_ROWS = 20_000  # tile rows worked off at once,
_BITMAPS = 16_000_000  # and bytes of their bitmaps
_BATCH = 4_000_000  # bytes of texts that a Python worker is sent at once
_SEEN = 200_000  # sets that a task remembers, to send one text of each


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; one for the whole of fewer words, none without."""
    for hashes in word_hashes(texts):
        n = len(hashes)
        if n >= words:
            rolled = np.full(n - words + 1, 7, np.uint64)
            for k in range(words):
                rolled = mixed(rolled ^ hashes[k : k + len(rolled)])
            rolled.sort()
            yield rolled[np.r_[True, rolled[1:] != rolled[:-1]]]
        elif n:
            one = np.full(1, 1000 + n, np.uint64)
            for h in hashes:
                one = mixed(one ^ h)
            yield one
        else:
            yield hashes


def set_id(s: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def band(n: int) -> int:
    """0 for small sets; else k with 48 * 4 ** (k - 1) <= n."""
    k = 0
    while n >= SMALL * 4**k:
        k += 1
    return k


def bands(n: int) -> list[int]:
    """The bands a set is filed in: its own and that of its smallest partner."""
    return sorted({band(n), band(-(-4 * n // 5))})


def part_keys(s: np.ndarray, k: int) -> np.ndarray:
    """Keys of the first H + 1 non-empty parts of a set in band k; their last four bits are the band."""
    n = len(s)
    most = (n + 5 * n // 4) // 9 + 1
    tagged = lambda keys: (keys & ~np.uint64(15)) | np.uint64(min(k, 15))
    if k == 0:
        return tagged(mixed(s[:most]))
    part = s >> np.uint64(64 - (4 + 2 * k))  # 64 parts in band 1, then 4 times as many for each band
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])[: most + 1]
    sums = np.add.reduceat(mixed(s), starts)[:most]
    return tagged(mixed(sums ^ mixed(part[starts[:most]])))


def bitmap(s: np.ndarray, k: int) -> bytes:
    bits = 256 if k == 0 else 4 << (4 + 2 * k)
    at = (mixed(s) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact: 100 * intersection >= 80 * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def filed_sets(docs: DataFrame) -> DataFrame:
    """(id, n, sid, keys): the size and id of the set of each row (id, text), and the keys that it is filed under."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                sizes, ids, keys = [], [], [np.zeros(0, np.int64)]
                for s in shingle_sets(texts):
                    sizes.append(len(s))
                    ids.append(set_id(s) if len(s) else None)
                    keys.append(np.concatenate([part_keys(s, k) for k in bands(len(s))]).view(np.int64) if len(s) else keys[0])
                ends = np.cumsum([0, *map(len, keys[1:])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), lists], ["id", "n", "sid", "keys"])
                at += len(texts)

    return docs.mapInArrow(giving_back(file), "id bigint, n bigint, sid bigint, keys array<bigint>")


def tiles(filed: DataFrame) -> DataFrame:
    """(key, sid, blocks): the sets of each tile, one tile for keys with the same members."""
    rows, h = filed.select("sid", F.explode("keys").alias("key")), F.xxhash64("sid")
    # Sums and counts combine before the shuffle, so that a key of very many documents is a row for each task.
    found = rows.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.count(F.lit(1)).alias("n"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s"), F.bit_xor(h).alias("x"))
    same = found.filter("low < high").groupBy("low", "high", "n", "s", "x").agg(F.min("key").alias("key"))
    chosen = table_of(same.select("key", "n"), "tile-keys")
    kept = filed.select("sid", F.explode(KeySet(chosen, "key").of_arrays()("keys")).alias("key"))
    tile = table_of(kept.join(chosen, "key").distinct(), "tiles")
    # So far, n counts equal sets too.
    large = table_of(tile.filter(F.col("n") > BLOCK).groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"), "large-tiles")
    if large.isEmpty():
        return tile.withColumn("blocks", F.lit(1)).drop("n")
    return tile.join(large, "key", "left").select("key", "sid", F.coalesce("blocks", F.lit(1)).alias("blocks"))


def texts_of(docs: DataFrame, sets: DataFrame, tile: DataFrame) -> DataFrame:
    """(sid, n, text, maps) of each set in a tile: one text of it, and its bitmap in each of its bands."""
    wanted = table_of(tile.select("sid").distinct(), "tiled-sets")
    holders = table_of(sets.join(wanted, "sid").groupBy("sid").agg(F.min("id").alias("id")), "holders")  # a null id only where there is no other
    ids, unnamed = KeySet(holders, "id"), not holders.filter("id is null").isEmpty()
    fields = [("sid", pa.int64()), ("n", pa.int64()), ("text", pa.string()), ("maps", pa.list_(pa.struct([("band", pa.int32()), ("bits", pa.binary())])))]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            may = np.where(known, ids.may_hold(batch.column("id").fill_null(0).to_numpy(zero_copy_only=False)), unnamed)
            for texts in slices(batch.column("text").filter(pa.array(may))):
                rows = []
                for text, s in zip(texts, shingle_sets(texts), strict=True):
                    if len(s) and (sid := set_id(s)) not in seen:
                        seen.add(sid)
                        rows.append((sid, len(s), text, [{"band": k, "bits": bitmap(s, k)} for k in bands(len(s))]))
                if len(seen) > _SEEN:
                    seen.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [c for c, _ in fields])

    drawn = docs.mapInArrow(giving_back(draw), "sid bigint, n bigint, text string, maps array<struct<band:int,bits:binary>>")
    return table_of(drawn.join(wanted, "sid", "left_semi").dropDuplicates(["sid"]), "texts", _BATCH)


def _bitmap_bytes(rows: pa.RecordBatch) -> int:
    return pc.sum(pc.binary_length(rows.column("bits"))).as_py() or 0


def _bit_matrix(bits: pa.BinaryArray, at: np.ndarray) -> np.ndarray:
    """The bitmaps of some rows of one band, as words."""
    taken = bits.take(pa.array(at))
    ends = np.frombuffer(taken.buffers()[1], np.int32, len(at) + 1)
    return np.frombuffer(taken.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64).reshape(len(at), -1)


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sorted tile rows, cut between tiles."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS // 10):
            held.append(batch.slice(at, _ROWS // 10))
            if sum(x.num_rows for x in held) < _ROWS and sum(map(_bitmap_bytes, held)) < _BITMAPS:
                continue
            t = joined()
            key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            last = int(np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))[-1]) + 1 if (key[0], i[0], j[0]) != (key[-1], i[-1], j[-1]) else 0
            if last:
                yield t.slice(0, last)
            held = [t.slice(last)]
    if held:
        yield joined()


def bound(a: np.ndarray, b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Upper bound of the Jaccard coefficient from two sizes and the bits that differ; 0 if that or the sizes rule a link out."""
    both = np.minimum((a + b - differ) // 2, np.minimum(a, b))
    return np.where(100 * both >= 80 * (a + b - both), both / (a + b - both), 0.0)


def overlap_bounds(bits: np.ndarray, sizes: np.ndarray, rows: slice) -> np.ndarray:
    """Bounds of some rows with all."""
    differ = np.zeros((len(sizes[rows]), len(sizes)), np.int64)
    for w in range(bits.shape[1]):
        differ += np.bitwise_count(bits[rows, w, None] ^ bits[None, :, w])
    return bound(sizes[rows, None], sizes[None, :], differ)


def tile_pairs(classes: np.ndarray, sizes: np.ndarray, bits: np.ndarray, sides: np.ndarray | None, every: bool) -> list[tuple[int, int]]:
    """Pairs of rows of one tile to check: all that may link between classes, or a spanning forest of them."""
    n = len(classes)
    limits = np.concatenate([overlap_bounds(bits, sizes, slice(i, i + 256)) for i in range(0, n, 256)])
    np.fill_diagonal(limits, 0)
    if sides is not None:
        limits[sides[:, None] == sides[None, :]] = 0
    label = np.unique(classes, return_inverse=True)[1]
    if every:
        i, j = np.nonzero(np.triu((limits > 0) & (label[:, None] != label[None, :])))
        return list(zip(i.tolist(), j.tolist(), strict=True))
    pairs: list[tuple[int, int]] = []
    while True:  # each class takes the best pair that leaves it
        open_ = np.where(label[:, None] != label[None, :], limits, 0)
        to = open_.argmax(axis=1)
        value = open_[np.arange(n), to]
        if not value.any():
            return pairs
        order = np.lexsort((np.arange(n), -value))
        first = order[np.unique(label[order], return_index=True)[1]]
        for i in first[value[first] > 0].tolist():
            a, b = label[i], label[to[i]]
            if a != b:
                pairs.append((i, int(to[i])))
                label[label == max(a, b)] = min(a, b)


def small_tile_pairs(starts: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """All pairs (rows x 2) that may link, of many small tiles at once; each begins at one of ``starts``."""
    n = len(sizes)
    tile = np.zeros(n, np.int64)
    tile[starts[1:]] = 1
    tile = np.cumsum(tile)
    found, at, step = [], np.arange(n), 1
    while len(at := at[at + step < n]) and len(at := at[tile[at] == tile[at + step]]):
        differ = np.bitwise_count(bits[at] ^ bits[at + step]).sum(axis=1, dtype=np.int64)
        hit = at[bound(sizes[at], sizes[at + step], differ) > 0]
        found.append(np.stack([hit, hit + step], axis=1))
        step += 1
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


_EDGE = [("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]


def candidates(tile_rows: DataFrame, every: bool) -> DataFrame:
    """(key, i, j, a, b) of each tile's pairs to check, from (key, i, j, side, sid, class, n, bits).

    A group (key, i, j) whose rows all have side 0 gives pairs among them, else only pairs between its two sides.
    Groups of up to SMALL_TILE rows are worked off many at a time, and give all their pairs.
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tiles(batches):
            key, i, j, side, sid, cls, n = (t.column(c).to_numpy() for c in ("key", "i", "j", "side", "sid", "class", "n"))
            raw, ends = t.column("bits"), np.flatnonzero(np.r_[(key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True]) + 1
            starts = np.r_[0, ends[:-1]]
            two = np.maximum.reduceat(side, starts) > 0
            rows: list[np.ndarray] = []
            small = (ends - starts <= SMALL_TILE) & ~two
            for band in np.unique(key[starts[small]] & 15).tolist():
                of = np.flatnonzero(small & (key[starts] & 15 == band) & (ends - starts > 1))
                at = _ranges(starts[of], ends[of])
                if len(at):
                    lengths = ends[of] - starts[of]
                    rows.append(at[small_tile_pairs(np.cumsum(lengths) - lengths, n[at], _bit_matrix(raw, at))])
            for s, e, both in zip(starts[~small].tolist(), ends[~small].tolist(), two[~small].tolist(), strict=True):
                if (cls[s:e] != cls[s]).any():
                    found = tile_pairs(cls[s:e], n[s:e], _bit_matrix(raw, np.arange(s, e)), side[s:e] if both else None, every)
                    rows.append(np.array(found, np.int64).reshape(-1, 2) + s)
            at = np.concatenate(rows) if rows else np.zeros((0, 2), np.int64)
            at = at[cls[at[:, 0]] != cls[at[:, 1]]]
            ab = np.sort(sid[at], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip((key[at[:, 0]], i[at[:, 0]], j[at[:, 0]], ab[:, 0], ab[:, 1]), _EDGE, strict=True)], [c for c, _ in _EDGE])

    dealt = tile_rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(giving_back(pair), "key bigint, i int, j int, a bigint, b bigint")


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts link, from (a, b) and (sid, text)."""

    @F.arrow_udf(T.BooleanType())
    def links(left: pa.Array, right: pa.Array) -> pa.Array:
        out, last, kept = [], None, None
        for a, b in zip(left, right, strict=True):
            a, b = a.as_py(), b.as_py()
            if a != last:
                last, kept = a, next(shingle_sets([a]))
            out.append(linked(kept, next(shingle_sets([b]))))
        give_back()
        return pa.array(out)

    left = texts.select(F.col("sid").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("sid").alias("b"), F.col("text").alias("right"))
    return pairs.join(left, "a").join(right, "b").filter(links("left", "right")).select("a", "b")


def _block(n: Column, of: str, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.col(of), F.lit(salt)), n).cast("int")


def links_of(tile: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of the sets that links lead away from, from (key, sid, blocks) and texts_of()."""
    signed = texts.select("sid", "n", F.explode("maps").alias("m")).select("sid", "n", "m.band", "m.bits")
    columns = ("key", "i", "j", "side", "sid", "class", "n", "bits")

    band = F.col("key").bitwiseAND(15).cast("int").alias("band")

    def with_bitmaps(rows: DataFrame, of: DataFrame = signed) -> DataFrame:
        return rows.withColumn("band", band).join(of, ["sid", "band"]).select(*columns)

    def classed(rows: DataFrame) -> DataFrame:
        return rows.join(roots, F.col("sid") == F.col("node"), "left").withColumn("class", F.coalesce("root", "sid")).drop("node", "root")

    alone = lambda rows, i: rows.withColumn("i", i).withColumn("j", F.col("i")).withColumn("side", F.lit(0))
    edges = table_of(candidates(with_bitmaps(alone(tile, _block(F.col("blocks"), "sid")).withColumn("class", F.col("sid"))), every=False), "edges")
    done = table_of(edges.select("a", "b").distinct(), "pairs")
    links = table_of(checked(done, texts), "links", _BATCH)
    roots = components(links)

    def join_in(found: DataFrame) -> bool:
        """Check those of the pairs that are new; whether any of them links."""
        nonlocal done, links, roots
        new = table_of(found.select("a", "b").distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        # By now few sets are asked for: the bit set keeps the texts of all others from being moved.
        asked = KeySet(new.select(F.explode(F.array("a", "b")).alias("sid")), "sid")
        more = table_of(checked(new, texts.filter(asked.filter()(F.col("sid")))), "links", _BATCH)
        done = done.unionByName(new)
        if more.isEmpty():
            return False
        links = links.unionByName(more)
        roots = components(links)
        return True

    big = table_of(tile.filter("blocks > 1"), "big-tiles")
    some_big, rounds = not big.isEmpty(), 0
    of_big = table_of(signed.join(big.select("sid", band).distinct(), ["sid", "band"], "left_semi"), "large-bitmaps") if some_big else signed
    while some_big:  # one set of each class of a tile, while that brings classes together
        rounds += 1
        sent = table_of(classed(big).groupBy("key", "class").agg(F.min("sid").alias("sid")), "sent")
        many = sent.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("m")).filter("m > 1")
        if not join_in(candidates(with_bitmaps(alone(sent.join(many, "key"), _block(F.col("blocks"), "class", rounds)), of_big), every=False)):
            break
    # A small tile is done if its forest's edges all ended in one class: then so did every pair that its bitmaps allow.
    small = table_of(tile.filter("blocks = 1").join(_open_keys(edges, roots), "key", "left_semi"), "open-tiles")
    rest = with_bitmaps(classed(alone(small, F.lit(0))))
    if some_big:
        rest = rest.unionByName(with_bitmaps(_outsiders(table_of(classed(big), "classed-tiles")), of_big))
    join_in(candidates(rest, every=True))
    return roots


def _open_keys(edges: DataFrame, roots: DataFrame) -> DataFrame:
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    ended = edges.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return ended.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("key").distinct()


def _outsiders(rows: DataFrame) -> DataFrame:
    """Groups (key, i, j) of what is left of large tiles.

    They hold the sets outside a tile's largest class (side 1, block i) against all of it (side 0, block j); where these are the most,
    all pairs of the tile's blocks.
    """
    sizes = rows.groupBy("key", "class").agg(F.count(F.lit(1)).alias("m"))
    tops = sizes.groupBy("key").agg(F.max_by("class", F.struct("m", "class")).alias("top"), (F.sum("m") - F.max("m")).alias("out"), F.max("m").alias("most"))
    tops = table_of(tops.filter("out > 0").withColumn("chunks", F.ceil(F.col("out") / BLOCK).cast("int")), "tops")
    d = rows.join(tops, "key")
    counted = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = d.filter("out <= most")
    one = few.filter(F.col("class") != F.col("top")).withColumn("i", _block(F.col("chunks"), "sid", -1)).withColumn("j", counted("blocks")).withColumn("side", F.lit(1))
    all_ = few.withColumn("j", _block(F.col("blocks"), "sid")).withColumn("i", counted("chunks")).withColumn("side", F.lit(0))
    own = d.filter("out > most").withColumn("own", _block(F.col("blocks"), "sid")).withColumn("other", counted("blocks"))
    own = own.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    return one.unionByName(all_).unionByName(own.drop("own", "other"))


def classes_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_id, component_id, stays) of every row; ``stays`` marks the set that represents its component.

    That is the set of a row with the component's smallest id (a null id only where there is no other; of several sets with that
    id, one).  All rows with that id and that set have the mark; rows without shingles, too.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    filed = table_of(filed_sets(d), "filed", _BATCH)
    sets = filed.select("id", "n", "sid")
    tile = tiles(filed)
    roots = links_of(tile, texts_of(d, sets, tile))
    classed = sets.join(roots, sets.sid == roots.node, "left").select("id", F.col("n").alias("n_shingles"), "sid", F.coalesce("root", "sid").alias("class"))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "sid")).alias("first")
    smallest = table_of(classed.filter("class is not null").groupBy("class").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("class", "first"), "smallest")
    d = classed.join(smallest, "class", "left")
    stays = F.col("first").isNull() | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("sid") == F.col("first.sid")))
    component = F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id"))
    return d.select(F.col("id").alias(id_col), "n_shingles", F.col("sid").alias("set_id"), component.alias("component_id"), stays.alias("stays"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the smallest id that links lead to.

    Null, empty and wordless texts have 0 shingles and are alone.  Equal sets link.  Rows with the same id each
    give a row; they are one component only if their texts link.  A row with a null id takes part in links like any other, and
    a component's id is null only if all its ids are.  An empty table gives no rows.  Further columns are ignored.
    Sets are told apart by 64 bits: of five hundred million different ones some 0.007 pairs are expected to be taken as equal.
    """
    return classes_of(docs, id_col=id_col, text_col=text_col).select(id_col, "n_shingles", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one row, that with the smallest id.

    Rows are told apart by id and text, so rows with one id and texts that don't link all stay.  Of rows with the
    same id and equal shingles one stays, whichever comes first.  Rows without shingles all stay.  Null ids are ids.  Columns
    pass through as they are.
    """
    classes = table_of(classes_of(docs, id_col=id_col, text_col=text_col), "classes")
    of = [F.col(id_col).cast("bigint").alias("__id"), F.col("set_id").alias("__set")]
    repeated = classes.filter("set_id is not null").groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.bool_and("stays").alias("stays"))
    suspects = table_of(repeated.filter("not stays or n > 1").select("__id", "__set", "stays"), "suspects")
    known = KeySet(suspects, "__id")

    def may_be(ids: pa.Array) -> np.ndarray:
        """Whether the bit set can't clear a row; only such rows are moved for the exact join."""
        return known.may_hold(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) | ~ids.is_valid().to_numpy(zero_copy_only=False)

    @F.arrow_udf(T.BooleanType())
    def cleared(ids: pa.Array) -> pa.Array:
        return pa.array(~may_be(ids))

    @F.arrow_udf(T.LongType())
    def doubtful_set(ids: pa.Array, texts: pa.Array) -> pa.Array:
        at = np.flatnonzero(may_be(ids))
        out = np.zeros(len(texts), np.int64)
        has, start = np.zeros(len(texts), bool), 0
        for part in slices(texts.take(pa.array(at))):
            for k, s in enumerate(shingle_sets(part), start):
                if len(s):
                    out[at[k]], has[at[k]] = set_id(s), True
            start += len(part)
        give_back()
        return pa.array(out, pa.int64(), mask=~has)

    row_id, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    wordless = ~F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    sure = docs.filter(wordless | cleared(row_id))
    held = docs.withColumn("__set", doubtful_set.asNondeterministic()(row_id, text)).withColumn("__id", row_id).filter("__set is not null")
    gone = suspects.filter("not stays").select(F.col("__id").alias("__gone_id"), F.col("__set").alias("__gone"))
    held = held.join(gone, (F.col("__set") == F.col("__gone")) & F.col("__id").eqNullSafe(F.col("__gone_id")), "left_anti").dropDuplicates(["__id", "__set"])
    return sure.unionByName(held.drop("__id", "__set"))
