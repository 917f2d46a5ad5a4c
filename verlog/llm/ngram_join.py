"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

A document's set holds its distinct word shingles as 64-bit hashes. Two documents link when their sets' Jaccard
similarity is at least ``PERCENT`` / 100. The join is exact up to collisions of 64-bit hashes:

1. ``shingle_table``: per document the set's size, a key (hash of the whole set) and a bitmap of hash parities, of as
   many bits as four times the set's elements, rounded up to a power of two, 1024 at least. Documents of equal sets share a key and are one
   from here on, however many copies there are.
2. ``_postings``: two linked sets share an element among the first ``n - ceil(0.8 n) + 1`` of any common order. The
   order puts shingles last that are seen often (counted over all documents; a list of fixed size, broadcast), so a
   passage that a third of the documents share does not gather them. Postings travel as blocks of a hash range.
3. ``_candidates``: within a posting group, sorted by set size, small groups give all pairs of fitting sizes. Members
   of a large one meet in tiles: first each in the largest of its groups, where a least spanning forest over the
   bitmaps' distances (``_forest_pairs``) gives about a pair a member.
4. ``_passing``: pairs meet both bitmaps; differing bits are differing elements, which bounds the overlap from above.
   Only pairs that pass go on, so a text moves only where a link is likely.
5. ``_verify``: texts of passing pairs meet in tiles of bounded size, where sorted arrays are intersected.
6. Large groups whose members are not all in one component yet are compared in full, in tiles of a size band, by
   bitmaps; what passes is verified. So no link between different components is lost, and no group's
   pairs are ever listed.

Defined results: null and empty texts, and those of white space, have no set (size 0) and link with nothing; with
fewer than five words the whole sequence is the one element; repeated rows and copies share a component; rows of null
or repeated doc_id link by their texts as any other, by a number of each row; a null doc_id is no component's name
unless all its members are null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, drop_cut, kept, small, small_batches, tidy

SHINGLE, PERCENT = 5, 80
#: Shingles that are ordered last, at most: eight bytes each are broadcast. Elements that are counted together, and how
#: often one must be among them to be reported.
HOT_SHINGLES, HOT_LEAST, HOT_WINDOW = 65_536, 3, 2_000_000
#: Bits of the shortest bitmap.
LEAST_BITS = 1024
#: Posting groups up to this size give all their pairs; postings of a hash range, pairs of a tile and members of a
#: block of a large group (and of its forest), about.
SMALL_GROUP, RANGE_POSTINGS, TILE_PAIRS, BLOCK, FOREST_BLOCK = 16, 1_000_000, 2048, 2048, 8192
#: Words kept by a worker, and documents whose sets it holds at once.
MEMO_WORDS, SLICE = 150_000, 1000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_U = np.uint64


class WordHashes(dict):
    """64-bit hashes of words, as bytes."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        h = xxhash.xxh3_64_digest(word)
        if len(word) <= 48:
            if len(self) > MEMO_WORDS:
                self.clear()
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _known() -> WordHashes:
    """One memo for each Python worker."""
    return kept("ngram_join", None, WordHashes)


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text in UTF-8."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(hashes.__getitem__, words)), np.uint64)
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    s = np.full(n, len(words) if width < SHINGLE else 0, np.uint64)
    for k in range(width):  # words' hashes are random already, so a sum with odd factors tells sequences apart
        s += h[k : k + n] * _MULTIPLIERS[k]
    s = _mix(s)
    s.sort()
    return s[np.append(True, s[1:] != s[:-1])] if n > 1 else s


def _bitmap(s: np.ndarray) -> bytes:
    """Each bit is the parity of the number of elements that fall on it: differing bits of two bitmaps are differing elements."""
    bits = max(LEAST_BITS, 4 << (len(s) - 1).bit_length() if len(s) else 0)
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (or rows of them) of ``size`` bytes: its halves laid on each other keep their parities."""
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def _differing(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    return int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())


def _first(n: int) -> int:
    """How many elements of a set of ``n`` must be looked at to meet a linked one's."""
    return n - -(-PERCENT * n // 100) + 1


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[int]]]:
    """Slices of the input with the sets of their texts and the keys of these."""
    hashes = _known()
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            sets = [shingles(t or b"", hashes) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield batch, sets, [_key(s) for s in sets]


def _key(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = _mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + _U(len(s))
        return int(_mix(np.array([total]))[0].astype(np.int64))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def shingle_table(docs: DataFrame) -> DataFrame:
    """doc_id, key, n, bitmap; and, with a null bitmap, rows of shingles (key) that n documents of a window share."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    names = ["doc_id", "key", "n", "bitmap"]

    def often(parts: list[np.ndarray]) -> pa.RecordBatch:
        s, n = np.unique(np.concatenate(parts), return_counts=True)
        s, n = s[n >= HOT_LEAST], n[n >= HOT_LEAST]
        return pa.RecordBatch.from_arrays([pa.nulls(len(s), pa.int64()), _longs(s), pa.array(n.astype(np.int32)), pa.nulls(len(s), pa.binary())], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts, size = set(), [], 0
        for batch, sets, keys in _sets(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([_bitmap(s) for s in sets], pa.binary())], names)
            for k, s in zip(keys, sets, strict=True):
                if len(s) and k not in seen:  # an element can matter only among the first of a set
                    seen.add(k)
                    parts.append(s[: 2 * _first(len(s))].copy())
                    size += len(parts[-1])
            if size > HOT_WINDOW:
                yield often(parts)
                seen, parts, size = set(), [], 0
        if parts:
            yield often(parts)

    return rows.mapInArrow(tidy(run), "doc_id bigint, key bigint, n int, bitmap binary")


def _postings(docs: DataFrame, hot: np.ndarray, bits: int) -> DataFrame:
    """Blocks of the postings of each hash range: (range, hashes, keys, sizes)."""
    spark = docs.sparkSession
    last = spark.sparkContext.broadcast(hot)  # bounded by HOT_SHINGLES
    rows = docs.select(docs["text"].cast("string").alias("text"))

    def blocks(h: list, k: list, n: list) -> pa.RecordBatch:
        each = [len(x) for x in h]
        h, k, n = np.concatenate(h), np.repeat(np.array(k, np.int64), each), np.repeat(np.array(n, np.int32), each)
        place = (h >> _U(64 - bits)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        h, k, n, place = h[order], k[order], n[order], place[order]
        edge = np.flatnonzero(np.diff(place)) + 1
        parts = list(zip([0, *edge.tolist()], [*edge.tolist(), len(h)], strict=True))
        return pa.RecordBatch.from_arrays([pa.array([int(place[a]) for a, _ in parts], pa.int32()), *(pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in (h, k, n))], ["range", "h", "k", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = last.value
        seen, h, k, n, size = set(), [], [], [], 0
        for _, sets, keys in _sets(batches):
            for key, s in zip(keys, sets, strict=True):
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                want = _first(len(s))
                early = s[: 2 * want]
                is_late = late[np.minimum(np.searchsorted(late, early), len(late) - 1)] == early if len(late) else np.zeros(len(early), bool)
                early = early[~is_late]
                if len(early) < want and 2 * want < len(s):
                    is_late = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                    early = s[~is_late]
                if len(early) < want:
                    early = np.concatenate([early, s[is_late][: want - len(early)]])
                h.append(early[:want].copy())
                k.append(key)
                n.append(len(s))
                size += want
            if size > 400_000:
                yield blocks(h, k, n)
                seen, h, k, n, size = set(), [], [], [], 0
        if k:
            yield blocks(h, k, n)

    return rows.mapInArrow(tidy(run), "range int, h binary, k binary, n binary")


def _group_pairs(h: np.ndarray, k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (two columns of keys) and the members of large groups (hash, key, group size) of one hash range."""
    order = np.lexsort((k, n, h))
    h, k, n = h[order], k[order], n[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
    h, k, n = h[fresh], k[fresh], n[fresh]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(h)))
    of = np.repeat(size, size)
    big = of > SMALL_GROUP
    pairs = []
    for d in range(1, min(SMALL_GROUP, int(size.max(initial=1)))):
        i = np.flatnonzero((h[:-d] == h[d:]) & ~big[:-d])
        i = i[100 * n[i].astype(np.int64) >= PERCENT * n[i + d].astype(np.int64)]
        pairs.append(np.stack([k[i], k[i + d]], 1))
    pairs = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
    if len(pairs):
        pairs = np.unique(np.sort(pairs, 1), axis=0)
    return np.pad(pairs, ((0, 0), (0, 1))), np.stack([h[big].view(np.int64), k[big], of[big]], 1)


def _candidates(postings: DataFrame, bits: int) -> DataFrame:
    """kind 1: candidate pair (a, b); kind 2: member b of the large group of shingle a, which has m members."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for batch in batches:
            for r, h, k, n in zip(*(batch.column(c).to_pylist() for c in ("range", "h", "k", "n")), strict=True):
                by.setdefault(r, []).append((h, k, n))
        for r in list(by):
            h, k, n = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*by.pop(r), strict=True), (np.uint64, np.int64, np.int32), strict=True))
            for kind, x in zip((1, 2), _group_pairs(h, k, n), strict=True):
                for at in range(0, len(x), 100_000):
                    part = x[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), *(pa.array(part[:, i]) for i in range(3))], ["kind", "a", "b", "m"])

    # each range is a task's worth of memory, so ranges are dealt out by number
    return postings.repartition(1 << bits, "range").mapInArrow(tidy(run), "kind byte, a bigint, b bigint, m bigint")


def _fits(n: int, m: int, differing: int) -> bool:
    """Whether sets of these sizes can be linked: 2 * overlap <= n + m - differing; linked: overlap >= p / (100 + p) * (n + m)."""
    return (100 + PERCENT) * (n + m - differing) >= 2 * PERCENT * (n + m)


def _passing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose bitmaps do not rule them out."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("bitmap").alias("bits_a"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("bitmap").alias("bits_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b"))
            keep = [_fits(n, m, _differing(x, y)) for n, m, x, y in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(pairs.sparkSession, rows.mapInArrow(tidy(run), "a bigint, b bigint"), "passing")


def _verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets link, but for those that follow from other links of their tile.

    A pair goes to the tile of the key of most pairs near it; a tile of many pairs is split by hashes of them."""
    spark = docs.sparkSession
    ends = pairs.select(F.col("a").alias("key"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("key"), F.col("a").alias("other")))
    degree = ends.groupBy("key").agg(F.count("*").alias("m"))
    rank = F.struct((-F.col("m")).alias("m"), F.col("other").alias("key"))
    near = ends.join(degree.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.min(rank).alias("best"))
    near = near.join(degree, "key").select("key", F.least("best", F.struct((-F.col("m")).alias("m"), "key")).alias("best"))
    placed = pairs.join(near.select(F.col("key").alias("a"), F.col("best").alias("x")), "a").join(near.select(F.col("key").alias("b"), F.col("best").alias("y")), "b")
    placed = cut(spark, placed.select(F.least("x", "y")["key"].alias("lead"), "a", "b"), "placed")
    many = placed.groupBy("lead").agg(F.count("*").alias("pairs")).where(F.col("pairs") > TILE_PAIRS)
    many = cut(spark, many, "many")  # at most a row for each TILE_PAIRS pairs
    placed_in = placed.join(F.broadcast(many) if small(many, 32) else many, "lead", "left")
    block = F.pmod(F.xxhash64("a", "b"), F.ceil(F.coalesce("pairs", F.lit(1)) / TILE_PAIRS))
    tiles = cut(spark, placed_in.select(F.xxhash64("lead", block).alias("tile"), "a", "b"), "tiles")
    wanted = tiles.select("tile", F.col("a").alias("key")).unionByName(tiles.select("tile", F.col("b").alias("key"))).distinct()
    wanted = cut(spark, wanted.join(reps.select("key", "rep"), "key"), "wanted")
    side = F.broadcast(wanted) if small(wanted, 32) else wanted
    texts = docs.select(docs["doc_id"].cast("long").alias("rep"), docs["text"].cast("string").alias("text")).join(side, "rep")
    rows = texts.select("tile", F.col("key").alias("a"), F.lit(None).cast("long").alias("b"), "text").unionByName(tiles.select("tile", "a", "b", F.lit(None).cast("string").alias("text")))
    rows = rows.repartition("tile").sortWithinPartitions("tile", F.col("text").isNull())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tile, sets, todo = _known(), None, {}, []

        def links() -> pa.RecordBatch:
            root: dict[int, int] = {}
            out = []

            def find(x: int) -> int:
                while (y := root.get(x, x)) != x:
                    root[x] = root.get(y, y)
                    x = y
                return x

            for a, b in todo:
                if (ra := find(a)) == (rb := find(b)) or a not in sets or b not in sets:
                    continue
                x, y = sets[a], sets[b]
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    root[ra] = rb
                    out.append((a, b))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

        for batch in batches:
            for t, a, b, text in zip(batch.column("tile").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if t != tile:
                    if todo:
                        yield links()
                    tile, sets, todo = t, {}, []
                if b is not None:
                    todo.append((a, b))
                elif a not in sets:
                    s = shingles(text or b"", hashes)
                    if _key(s) == a:  # rows that share a doc_id may differ in text
                        sets[a] = s
        if todo:
            yield links()

    found = cut(spark, rows.mapInArrow(tidy(run), "a bigint, b bigint"), "links")
    for x in (placed, many, tiles, wanted):
        drop_cut(spark, x)
    return found


def _stacked(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to the shortest."""
    size = min(map(len, bitmaps))
    return np.stack([_folded(np.frombuffer(x, np.uint8), size) for x in bitmaps]).view(np.uint64)


def _forest(keys: np.ndarray, n: np.ndarray, bits: np.ndarray) -> list[tuple[int, int]]:
    """Edges (pairs of keys) of a least spanning forest over the bitmaps' distances, of edges that can be links (Prim)."""
    far = np.iinfo(np.int64).max
    best, near, left = np.full(len(n), far), np.zeros(len(n), np.int64), np.ones(len(n), bool)
    out, at = [], 0
    for _ in range(len(n)):
        left[at], best[at] = False, far
        total = n + n[at]
        d = np.bitwise_count(bits ^ bits[at]).sum(1, dtype=np.int64)
        fit = left & (d < best) & (100 * np.minimum(n, n[at]) >= PERCENT * np.maximum(n, n[at])) & ((100 + PERCENT) * (total - d) >= 2 * PERCENT * total)
        best[fit], near[fit] = d[fit], at
        nxt = int(best.argmin())
        if best[nxt] == far:
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            at = int(rest[0])
        else:
            a, b = int(keys[nxt]), int(keys[near[nxt]])
            out.append((min(a, b), max(a, b)))
            at = nxt
    return out


def _forest_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that are likely links between members of large groups: each member is in its largest group only, in blocks
    of bounded size, in two windows of sizes with different blocks, which so meet. What is missed here, the full
    comparison finds."""
    own = members.groupBy("key").agg(F.max(F.struct("m", "h")).alias("x")).select("key", "x.m", "x.h")
    band = F.floor(F.log("n") / (2 * math.log(100 / PERCENT)) + F.col("half") / 2)
    rows = own.join(sets, "key").withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.withColumn("tile", F.xxhash64("h", "half", band, F.pmod(F.xxhash64("key", "half"), F.ceil(F.col("m") / FOREST_BLOCK))))
    rows = rows.select("tile", "key", "n", "bitmap").repartition("tile").sortWithinPartitions("tile", "key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def told() -> pa.RecordBatch:
            pairs = _forest(np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64), _stacked([x[2] for x in held]))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in range(2)], ["a", "b"])

        for batch in batches:
            for t, *x in zip(*(batch.column(c).to_pylist() for c in ("tile", "key", "n", "bitmap")), strict=True):
                if t != tile:
                    if len(held) > 1:
                        yield told()
                    tile, held = t, []
                held.append(x)
        if len(held) > 1:
            yield told()

    return rows.mapInArrow(tidy(run), "a bigint, b bigint")


def _large_group_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components within large posting groups whose bitmaps do not rule them out."""
    spark = members.sparkSession
    rows = members.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    open_groups = rows.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h")
    rows = rows.join(open_groups, "h").join(sets, "key").withColumn("band", F.floor(F.log("n") / math.log(100 / PERCENT) + 1e-9))
    rows = cut(spark, rows.select("h", "band", "key", "component", "n", "bitmap"), "open")
    large = rows.groupBy("h", "band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
    large = cut(spark, large, "blocks")  # at most a row for each BLOCK members
    wide = F.broadcast(large) if small(large, 32) else large
    # tile (i, j) of a band has its block i; it is asked by block j of the band below and, for i < j, of the band itself
    blocks, place = F.coalesce("blocks", F.lit(1)), F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    before = F.explode(F.slice(F.sequence(F.lit(0).cast("long"), blocks - 1), 1, place.cast("int")))
    columns = ["h", "band", "i", "j", "asked", "key", "component", "n", "bitmap"]
    own, up = rows.join(wide, ["h", "band"], "left"), rows.withColumn("band", F.col("band") + 1).join(wide, ["h", "band"], "left")
    tiles = own.withColumns({"i": place, "j": every, "asked": F.lit(True)}).select(columns)
    tiles = tiles.unionByName(own.withColumns({"i": before, "j": place, "asked": F.lit(False)}).select(columns))
    tiles = tiles.unionByName(up.withColumns({"i": every, "j": place, "asked": F.lit(False)}).select(columns))
    tiles = tiles.select(F.xxhash64("h", "band", "i", "j").alias("tile"), "asked", (F.col("i") == F.col("j")).alias("own"), "key", "component", "n", "bitmap")
    tiles = tiles.repartition("tile").sortWithinPartitions("tile", F.desc("asked"))

    def matches(cols: list[np.ndarray], comp: int, n: int, bits: bytes) -> np.ndarray:
        other = np.flatnonzero((cols[1] != comp) & (100 * np.minimum(cols[2], n) >= PERCENT * np.maximum(cols[2], n)))
        size = min(len(bits), 8 * cols[3].shape[1])
        total = cols[2][other] + n
        theirs = _folded(cols[3][other].view(np.uint8), size).view(np.uint64)
        differing = np.bitwise_count(theirs ^ _folded(np.frombuffer(bits, np.uint8), size).view(np.uint64)).sum(1, dtype=np.int64)
        return other[(100 + PERCENT) * (total - differing) >= 2 * PERCENT * total]

    def told(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, base, cols, within = None, [], [], False

        def columns_of() -> tuple[list[np.ndarray], list[tuple[int, int]]]:
            """What is asked, and, in a tile of one block, its pairs among themselves."""
            cols = [*(np.array([x[i] for x in base], np.int64) for i in range(3)), _stacked([x[3] for x in base])]
            pairs = []
            if within and len(np.unique(cols[1])) > 1:
                for i, (key, comp, n, bits) in enumerate(base):
                    rest = [c[i + 1 :] for c in cols]
                    pairs += [(int(k), key) for k in rest[0][matches(rest, comp, n, bits)]]
            return cols, pairs

        for batch in batches:
            for t, asked, own, *x in zip(*(batch.column(c).to_pylist() for c in ("tile", "asked", "own", "key", "component", "n", "bitmap")), strict=True):
                if t != tile:
                    if base and not cols:
                        yield told(columns_of()[1])
                    tile, base, cols, within = t, [], [], own
                if asked:
                    base.append(x)
                elif base:
                    if not cols:
                        cols, pairs = columns_of()
                        yield told(pairs)
                    found = matches(cols, *x[1:])
                    if len(found):
                        yield told([(int(k), x[0]) for k in cols[0][found]])
        if base and not cols:
            yield told(columns_of()[1])

    found = cut(spark, tiles.mapInArrow(tidy(run), "a bigint, b bigint").where("a <> b").distinct(), "pairs")
    drop_cut(spark, rows)
    drop_cut(spark, large)
    return found


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    if not _one_id_a_row(docs):  # rows link by numbers of their own; a component is named by its smallest doc_id
        rows = _numbered(spark, docs)
        found = _components(rows.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")
        found = cut(spark, found.join(rows.select("row", F.col("doc_id").cast("long").alias("doc_id")), "row"), "numbered")
        names = found.groupBy("component_id").agg(F.min("doc_id").alias("name"))
        return found.join(names, "component_id").select("doc_id", "n_shingles", F.col("name").alias("component_id"))
    return _components(docs)


def _one_id_a_row(docs: DataFrame) -> bool:
    ids = docs.agg(F.count("*").alias("n"), F.countDistinct(F.col("doc_id").cast("long")).alias("d")).first()
    return ids["n"] == ids["d"]


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, written out once so that it stays the same."""
    return cut(spark, docs.withColumn("row", F.monotonically_increasing_id()), "rows")


def _components(docs: DataFrame) -> DataFrame:
    """``near_duplicate_components`` of rows whose doc_id is theirs alone."""
    spark = docs.sparkSession
    small_batches(spark)
    both = cut(spark, shingle_table(docs), "shingles")
    table = both.where("bitmap is not null")
    top = both.where("bitmap is null").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(HOT_SHINGLES).select("key").collect()  # bounded by HOT_SHINGLES
    hot = np.sort(np.array([r["key"] for r in top], np.int64).view(np.uint64))
    expected = table.groupBy("key").agg(F.first("n").alias("n")).agg(F.sum(F.col("n") * (100 - PERCENT) / 100 + 1)).first()[0] or 0
    bits = max(3, math.ceil(math.log2(max(1, expected / RANGE_POSTINGS))))
    found = cut(spark, _candidates(_postings(docs, hot, bits), bits), "candidates")
    sets = table.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.min("doc_id").alias("rep"))
    sets = cut(spark, sets, "sets")
    reps, bitmaps = sets.where("rep is not null").select("key", "rep"), sets.select("key", "n", "bitmap")
    members = found.where("kind = 2").select(F.col("a").alias("h"), F.col("b").alias("key"), "m")
    pairs = _passing(found.where("kind = 1").select("a", "b").distinct(), bitmaps)
    forest = cut(spark, _forest_pairs(members, bitmaps), "forest")
    links = _verify(docs, reps, pairs.unionByName(forest).distinct())
    drop_cut(spark, pairs)
    drop_cut(spark, forest)
    labels = connected_components(spark, links)
    more = _large_group_pairs(members, labels, bitmaps)
    if more.limit(1).count():
        links = links.unionByName(_verify(docs, reps, more))
        labels = connected_components(spark, links)
    drop_cut(spark, more)
    drop_cut(spark, found)
    drop_cut(spark, sets)
    rows = table.select("doc_id", "key", "n").where("n > 0").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    names = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = rows.join(names, "component").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = table.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.unionByName(alone)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id, a null one last; of rows that share
    it the first as written. Rows without a set are components of their own, so each stays, whatever its doc_id."""
    spark = docs.sparkSession
    if _one_id_a_row(docs):
        kept = cut(spark, _components(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id"), "kept")
        side = F.broadcast(kept) if small(kept, 16) else kept
        return docs.join(side, docs["doc_id"].cast("long") == side["doc_id"], "left_semi")
    number = f"row_{uuid.uuid4().hex}"
    rows = cut(spark, docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    found = _components(rows.select(F.col(number).alias("doc_id"), "text")).withColumnRenamed("doc_id", number)
    found = found.join(rows.select(number, F.col("doc_id").cast("long").alias("doc_id")), number)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", number)).alias("first")
    kept = cut(spark, found.groupBy("component_id").agg(first).select(F.col(f"first.{number}").alias(number)), "kept")
    side = F.broadcast(kept) if small(kept, 16) else kept
    return rows.join(side, number, "left_semi").drop(number)
