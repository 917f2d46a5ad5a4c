"""Removal of byte strings of ``LENGTH`` bytes that also start in a document of a smaller id, by bucket-pointer refinement.

Sorting every suffix would move many times the input. Any two equal strings of ``LENGTH`` bytes pick the same
positions by a local rule (the least hash among the q-grams of a window), so only picked positions are sorted:

1. ``_buckets``: picked positions fall into initial q-gram buckets. Buckets of one document alone are done.
2. ``_contexts``: the positions of the others fetch the bytes around them, as far as a string over them can reach.
3. ``_refine``: a bucket is refined offset by offset, to both sides of the q-gram: its rows are sorted on their bucket
   pointer and the byte at the next offset, the new ranks are written back as pointers, and the next offset reuses
   them; a row alone with its document is done. A string's bucket is the pair of the pointers as far as it reaches to
   either side; in each, those after the smallest document are removed.
4. ``_apply`` unites the removed strings of a document.

Whole copies of a text go first, so that a group of copies costs one row each. The initial buckets are of 64-bit hashes;
refinement is by the bytes themselves.

Defined results: null and empty texts have no bytes; texts under ``LENGTH`` bytes lose nothing; rows that share a
doc_id do not cut each other; a null doc_id is neither smaller nor larger than any: its row stays whole and cuts
none; strings repeated within one document only stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, release, small

LENGTH, Q = 50, 20
#: q-grams in a string, and so in a window of the rule; bytes of a context.
WINDOW = LENGTH - Q + 1
SPAN = 2 * LENGTH - Q
#: Positions of a hash range, and bytes of text of a document bucket, about.
RANGE_POSITIONS, BUCKET_BYTES = 400_000, 16 << 20
_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * _A ^ a >> _U(29)) + b * _B


def _pick(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Picked positions of a text of at least LENGTH bytes and their q-gram hashes."""
    h1 = _BYTE[np.frombuffer(raw, np.uint8)]
    h2 = _join(h1[:-1], h1[1:])
    h4 = _join(h2[:-2], h2[2:])
    h8 = _join(h4[:-4], h4[4:])
    h16 = _join(h8[:-8], h8[8:])
    h = _mix(_join(h16[: len(raw) - Q + 1], h4[16 : 16 + len(raw) - Q + 1]))

    def slide(x: np.ndarray, f) -> np.ndarray:
        n, size = x, 1
        while 2 * size <= WINDOW:
            n, size = f(n[:-size], n[size:]), 2 * size
        return f(n[: len(x) - WINDOW + 1], n[WINDOW - size : len(x) - size + 1]) if size < WINDOW else n

    low = slide(h, np.minimum)
    edge = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero(slide(np.concatenate([edge, low, edge]), np.maximum) == h)
    return at, h[at]


def _blocks(place: np.ndarray, names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row of binary columns for each value of ``place``."""
    order = np.argsort(place, kind="stable")
    place = place[order]
    cuts = np.flatnonzero(np.diff(place)) + 1
    parts = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True)) if len(place) else []
    columns = [c[order] for c in columns]
    return pa.RecordBatch.from_arrays([pa.array([int(place[a]) for a, _ in parts], pa.int32()), *(pa.array([np.ascontiguousarray(c[a:b]).tobytes() for a, b in parts], pa.binary()) for c in columns)], ["place", *names])


def _gather(batches: Iterable[pa.RecordBatch], names: list[str]) -> dict[int, list]:
    by: dict[int, list] = {}
    for batch in batches:
        for p, *x in zip(*(batch.column(c).to_pylist() for c in ("place", *names)), strict=True):
            by.setdefault(p, []).append(x)
    return by


def _range(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> _U(64 - bits)).astype(np.int32)


def _buckets(docs: DataFrame, bits: int, buckets: int) -> DataFrame:
    """(document bucket, documents, q-gram hashes) of the q-grams that several documents picked."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2500):
                part = whole.slice(at, 2500)
                hs, ds = [], []
                for d, raw in zip(part.column("doc_id").to_pylist(), part.column("raw").to_pylist(), strict=True):
                    if len(raw) >= LENGTH:
                        h = np.unique(_pick(raw)[1])
                        hs.append(h)
                        ds.append(np.full(len(h), d, np.int64))
                if hs:
                    h, d = np.concatenate(hs), np.concatenate(ds)
                    yield _blocks(_range(h, bits), ["h", "d"], [h, d])

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _gather(batches, ["h", "d"])
        for r in list(by):
            h, d = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*by.pop(r), strict=True), (np.uint64, np.int64), strict=True))
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            fresh = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
            h, d = h[fresh], d[fresh]
            same = h[1:] == h[:-1]
            live = np.append(same, False) | np.append(False, same)
            if live.any():
                yield _blocks((d[live] % buckets).astype(np.int32), ["d", "h"], [d[live], h[live]])

    rows = docs.mapInArrow(emit, "place int, h binary, d binary").repartition(1 << bits, "place")
    return rows.mapInArrow(shared, "place int, d binary, h binary")


def _with_texts(blocks: DataFrame, docs: DataFrame, buckets: int, names: list[str]) -> DataFrame:
    """Blocks and texts of a document bucket next to each other, the blocks first."""
    empty = [F.lit(None).cast("binary").alias(n) for n in names]
    texts = docs.select(F.pmod("doc_id", F.lit(buckets)).cast("int").alias("place"), "doc_id", "raw", *empty)
    rows = blocks.select("place", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("raw"), *names).unionByName(texts)
    return rows.repartition(buckets, "place").sortWithinPartitions("place", F.col("doc_id").isNotNull())


def _by_document(batches: Iterable[pa.RecordBatch], names: list[str], kinds: list) -> Iterator[tuple[int, bytes, list[np.ndarray]]]:
    """Each text with its rows of the blocks, whose first column is the document."""
    place, parts, columns = None, [], None
    for batch in batches:
        for p, d, raw, *x in zip(*(batch.column(c).to_pylist() for c in ("place", "doc_id", "raw", *names)), strict=True):
            if p != place:
                place, parts, columns = p, [], None
            if raw is None:
                parts.append(x)
                continue
            if columns is None:
                columns = [np.frombuffer(b"".join(c), t) for c, t in zip(zip(*parts, strict=True), kinds, strict=True)] if parts else [np.empty(0, t) for t in kinds]
                order = np.argsort(columns[0], kind="stable")
                columns, parts = [c[order] for c in columns], []
            a, b = np.searchsorted(columns[0], [d, d + 1])
            yield d, raw, [c[a:b] for c in columns[1:]]


def _contexts(live: DataFrame, docs: DataFrame, bits: int, buckets: int) -> DataFrame:
    """(hash range, hashes, documents, positions, text lengths, bytes around) of the picked positions in shared buckets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        size = 0
        names = ["h", "d", "p", "n", "around"]

        def told() -> pa.RecordBatch:
            h, d, p, n, around = (np.concatenate(x) for x in zip(*out, strict=True))
            return _blocks(_range(h, bits), names, [h, d, p, n, around])

        for d, raw, (own,) in _by_document(batches, ["d", "h"], [np.int64, np.uint64]):
            if len(raw) < LENGTH or not len(own):
                continue
            at, h = _pick(raw)
            keep = np.isin(h, own)
            at, h = at[keep], h[keep]
            padded = np.frombuffer(bytes(LENGTH - Q) + raw + bytes(LENGTH), np.uint8)
            around = np.lib.stride_tricks.sliding_window_view(padded, SPAN)[at]
            out.append([h, np.full(len(at), d, np.int64), at.astype(np.uint32), np.full(len(at), len(raw), np.uint32), around])
            size += len(at)
            if size >= 100_000:
                yield told()
                out, size = [], 0
        if size:
            yield told()

    return _with_texts(live, docs, buckets, ["d", "h"]).mapInArrow(run, "place int, h binary, d binary, p binary, n binary, around binary")


def _pointers(bucket: np.ndarray, columns: Iterable[np.ndarray], d: np.ndarray) -> list[np.ndarray]:
    """Bucket pointers of each row before and after each column of bytes: buckets are refined by sorting on (own bucket,
    the byte at the next offset), the new rank is written back, and the next offset starts from it. Rows that are alone
    with their document are done: -1 from there on. ``bucket`` ascends; rows stay in bucket order, so a sort finds long
    runs in place."""
    on, key, out = np.arange(len(d)), bucket, []
    columns = iter(columns)
    while True:
        order = np.argsort(key, kind="stable")
        on, key = on[order], key[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        rank, first = np.cumsum(new) - 1, np.flatnonzero(new)
        pointer = np.full(len(d), -1, np.int32)
        if len(on):
            shared = (np.minimum.reduceat(d[on], first) < np.maximum.reduceat(d[on], first))[rank]
            on, rank = on[shared], rank[shared]
            pointer[on] = rank
        out.append(pointer)
        column = next(columns, None)
        if column is None:
            return out
        key = rank << 8 | column[on]


def _removed(h: np.ndarray, d: np.ndarray, p: np.ndarray, n: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, starts and ends of strings that a smaller document holds too, of whole q-gram buckets, h ascending."""
    wide, left = np.ascontiguousarray(around.T), WINDOW - 1
    after = _pointers(h, (wide[left + Q + k] for k in range(left)), d)
    before = _pointers(h, (wide[left - 1 - k] for k in range(left)), d)
    gap = np.zeros((len(d), WINDOW + 2), np.int8)
    p, n = p.astype(np.int64), n.astype(np.int64)
    for o in range(WINDOW):  # the string of ``left - o`` bytes before the q-gram and ``o`` after it
        start = p - left + o
        on = np.flatnonzero((start >= 0) & (start + LENGTH <= n) & (after[o] >= 0) & (before[left - o] >= 0))
        if not len(on):
            continue
        key = after[o][on].astype(np.int64) * len(d) + before[left - o][on]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        least = np.minimum.reduceat(d[on][order], first)
        smaller = np.repeat(least, np.diff(np.append(first, len(order)))) < d[on][order]
        gap[on[order[smaller]], o + 1] = 1
    step = np.diff(gap, axis=1)
    row, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    at = p[row] - left
    return d[row], at + a, at + b - 1 + LENGTH


def _refine(contexts: DataFrame, bits: int, buckets: int) -> DataFrame:
    """(document bucket, documents, starts, ends) of removed strings."""
    names = ["h", "d", "p", "n", "around"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _gather(batches, names)
        for r in list(by):
            h, d, p, n, around = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*by.pop(r), strict=True), (np.uint64, np.int64, np.uint32, np.uint32, np.uint8), strict=True))
            around = around.reshape(-1, SPAN)
            order = np.argsort(h, kind="stable")
            # whole buckets at a time, so that pointers of few rows are in memory
            edge = np.flatnonzero(np.append(True, np.diff(h[order]) != 0))
            edge = np.append(edge, len(order))
            a = 0
            while a < len(edge) - 1:
                b = max(a + 1, int(np.searchsorted(edge, edge[a] + 32_768, "right")) - 1)
                on = order[edge[a] : edge[b]]
                doc, start, end = _removed(h[on], d[on], p[on], n[on], around[on])
                if len(doc):
                    yield _blocks((doc % buckets).astype(np.int32), ["d", "s", "e"], [doc, start.astype(np.uint32), end.astype(np.uint32)])
                a = b

    return contexts.repartition(1 << bits, "place").mapInArrow(run, "place int, d binary, s binary, e binary")


def _apply(spans: DataFrame, docs: DataFrame, buckets: int, texts: bool) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def told() -> pa.RecordBatch:
            kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

        for d, raw, (s, e) in _by_document(batches, ["d", "s", "e"], [np.int64, np.uint32, np.uint32]):
            kept, n = raw, 0
            if len(s):
                order = np.argsort(s)
                s, top = s[order].astype(np.int64), np.maximum.accumulate(e[order].astype(np.int64))
                new = np.append(True, s[1:] > top[:-1])  # spans that touch are one run
                starts, ends = s[new], top[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]
                kept, n = b"".join(raw[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(raw)], strict=True)), len(starts)
            rows.append((d, len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            if len(rows) >= 2000:
                yield told()
                rows = []
        if rows:
            yield told()

    return _with_texts(spans, docs, buckets, ["d", "s", "e"]).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, *, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes left; else null)."""
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("raw"))
    print_of = [F.xxhash64("raw").alias("h1"), F.crc32("raw").alias("h2"), F.octet_length("raw").alias("n")]
    whole = cut(spark, docs.select("doc_id", *print_of), "prints")
    least = whole.where("doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1")
    copies = cut(spark, whole.join(least, ["h1", "h2", "n"]).where(F.col("doc_id") > F.col("least")).where(F.col("n") >= LENGTH).select("doc_id", "h1", "n"), "copies")
    ids = copies.select("doc_id", "h1").distinct()
    ids = F.broadcast(ids) if small(copies, 24) else ids
    rest = docs.withColumn("h1", F.xxhash64("raw")).join(ids, ["doc_id", "h1"], "left_anti").select("doc_id", "raw")
    total = whole.agg(F.sum("n")).first()[0] or 0
    bits = max(3, math.ceil(math.log2(max(1, total / 16 / RANGE_POSITIONS))))
    buckets = max(7, total // BUCKET_BYTES) | 1
    named = rest.where("doc_id is not null")
    live = cut(spark, _buckets(named, bits, buckets), "live")
    release(spark)
    spans = cut(spark, _refine(_contexts(live, named, bits, buckets), bits, buckets), "spans")
    drop_cut(spark, live)
    release(spark)
    out = _apply(spans, named, buckets, texts)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    gone = copies.select("doc_id", F.col("n").cast("long").alias("n_bytes"), F.col("n").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), empty.alias("kept_sha256"), (F.lit("") if texts else F.lit(None)).cast("binary").alias("kept"))
    nameless = rest.where("doc_id is null").select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("raw", 256).alias("kept_sha256"), (F.col("raw") if texts else F.lit(None).cast("binary")).alias("kept"))
    return out.unionByName(gone).unionByName(nameless)
