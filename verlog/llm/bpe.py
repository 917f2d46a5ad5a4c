"""Byte-level BPE encoding and decoding by ranked merges over the distinct words of a task.

A text is cut by the pre-tokeniser pattern; each distinct match is a byte array whose neighbouring pieces are merged,
lowest rank first and leftmost among equals, until no joined pair is in the rank map. The rank map is a literal of
fixed size (one public vocabulary) sent to every task; a task keeps the ids of the words it has met, so that the fold
runs once per distinct word. Decoding concatenates the binary pieces of the ids.

Defined results: a null text counts as empty and gives no ids; an empty text gives no ids; repeated rows give
repeated results; other columns of the input are neither read nor returned; a word of any length is merged with a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches, tidy

#: Words kept by a task before it starts over, and the longest word that is kept.
MEMO_WORDS, MEMO_BYTES = 300_000, 48
#: No rank, and no id.
NONE, PAD = 1 << 30, -2
#: From so many bytes on, merging uses a heap.
HEAP_FROM = 96


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def _spans(flags: np.ndarray, top: int) -> str:
    """The body of a character class for the code points below ``top`` whose flag is set."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags[:top].astype(np.int8), [0]))))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edge.reshape(-1, 2))


@lru_cache(maxsize=4)
def word_patterns(pattern: str) -> tuple[re.Pattern, re.Pattern]:
    """``pattern`` for the standard library: its Unicode properties written out as ranges, once for texts of the basic
    plane and once for all texts. White space is the Unicode property, without the four separators that ``re`` adds."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))

    def flags(prop: str) -> np.ndarray:
        out = np.zeros(0x110000, bool)
        for m in regex.finditer(prop, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = True
        out[0xD800:0xE000] = False
        return out

    letters, numbers, spaces = flags(r"\p{L}+"), flags(r"\p{N}+"), flags(r"\p{White_Space}+")
    out = []
    for top in (0x10000, 0x110000):
        body = {r"\p{L}": _spans(letters, top), r"\p{N}": _spans(numbers, top), r"\s": _spans(spaces, top)}
        text = pattern.replace(r"\S", f"[^{body[r'\s']}]")
        text = re.sub(r"\[(\^?)((?:\\s|\\p\{[LN]\})+)\]", lambda m: "[" + m[1] + re.sub(r"\\s|\\p\{[LN]\}", lambda k: body[k[0]], m[2]) + "]", text)
        text = re.sub(r"\\p\{[LN]\}|\\s", lambda m: f"[{body[m[0]]}]", text)
        out.append(re.compile(text))
    return out[0], out[1]


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: the ranked merges."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) >= HEAP_FROM:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
    while pairs:
        low = min(pairs)
        if low == 1 << 30:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        r, i = heapq.heappop(heap)
        if gone[i] or (j := end[i]) >= n or ranks.get(word[i : end[j]]) != r:
            continue
        gone[j] = 1
        end[i] = k = end[j]
        if k < n:
            before[k] = i
            if (x := ranks.get(word[i : end[k]])) is not None:
                heapq.heappush(heap, (x, i))
        if (h := before[i]) >= 0 and (x := ranks.get(word[h:k])) is not None:
            heapq.heappush(heap, (x, h))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def fold_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """word and its pieces (binary), by Spark's higher-order functions alone: ``aggregate`` folds one ranked merge a step
    over the word's pieces, a literal map has the ranks. ``words`` (word) are distinct and not null.

    Right, but slow, as Spark looks a key of a map up by going through all of them: see the README for figures, and
    ``RankMap`` for the form that the operator uses."""
    spark, none = words.sparkSession, F.lit(NONE)
    literal = F.broadcast(spark.createDataFrame([({t.hex(): r for t, r in ranks.items()},)], "ranks map<string,int>"))  # one vocabulary
    hexed = F.lower(F.hex(F.col("word").cast("binary")))
    each = F.transform(F.sequence(F.lit(0), (F.length(hexed) / 2 - 1).cast("int")), lambda i: F.substring(hexed, i * 2 + 1, F.lit(2)))

    def step(p: Column, _: Column) -> Column:
        rank = lambda i: F.coalesce(F.try_element_at(F.col("ranks"), F.concat(F.get(p, i - 1), F.get(p, i))), none)
        best = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: F.struct(rank(i).alias("r"), i.alias("i"))))
        merged = lambda i: F.concat(F.slice(p, 1, i - 1), F.array(F.concat(F.get(p, i - 1), F.get(p, i))), F.slice(p, i + 2, F.size(p)))
        return F.element_at(F.transform(F.array(best), lambda b: F.when((F.size(p) > 1) & (b["r"] < none), merged(b["i"])).otherwise(p)), 1)

    pieces = F.aggregate(F.sequence(F.lit(1), F.length(hexed)), each, step)
    return words.where("word <> ''").crossJoin(literal).select("word", F.transform(pieces, F.unhex).alias("pieces"))


class RankMap:
    """The rank map as a hash table from two neighbouring ids to the id of their joined bytes, for many words at once."""

    BITS = 21

    def __init__(self, ranks: dict[bytes, int]):
        assert len(ranks) < 1 << 16 and max(ranks.values()) < 1 << 16, "two ids share one 32-bit key"
        self.ranks = ranks
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]] << 16 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2
        self.keys, self.values = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, NONE, np.int32)
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            free = self.keys[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & ((1 << self.BITS) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, NONE where there is none."""
        keys = a.astype(np.int64) << 16 | b
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        for k in range(1, self.probes):
            on = np.flatnonzero((found != keys) & (found != -1))
            if not len(on):
                break
            slot[on] = (slot[on] + 1) & ((1 << self.BITS) - 1)
            found[on] = self.keys[slot[on]]
            out[on] = np.where(found[on] == keys[on], self.values[slot[on]], NONE)
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids, four bytes each, of words of about the same length: one merge a word and round."""
        n = np.array([len(w) for w in words])
        ids = np.full((len(words), n.max() + 1), PAD, np.int32)
        ids[np.arange(ids.shape[1]) < n[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((len(words), ids.shape[1]), NONE, np.int32)
        real = ids[:, 1:] != PAD
        rank[:, :-1][real] = self.joined(ids[:, :-1][real], ids[:, 1:][real])
        out: list[bytes] = [b""] * len(words)
        row = np.arange(len(words))
        while len(row):
            at = rank.argmin(1)
            low = rank[np.arange(len(row)), at]
            done = low == NONE
            if done.any():
                raw, width = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (i, m) in enumerate(zip(row[done].tolist(), n[done].tolist(), strict=True)):
                    out[i] = raw[k * width : k * width + 4 * m]
                go = ~done
                row, n, ids, rank, at, low = row[go], n[go], ids[go], rank[go], at[go], low[go]
                if not len(row):
                    break
            r = np.arange(len(row))
            column = np.arange(ids.shape[1] - 1)
            after = column >= (at + 1)[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(after, rank[:, 1:], rank[:, :-1])
            ids[:, -1], rank[:, -1] = PAD, NONE
            n = n - 1
            ids[r, at] = low
            top = n.max() + 1
            ids, rank = ids[:, :top], rank[:, :top]
            has = at + 1 < n
            rank[r[~has], at[~has]] = NONE
            rank[r[has], at[has]] = self.joined(low[has], ids[r[has], at[has] + 1])
            has = at > 0
            rank[r[has], at[has] - 1] = self.joined(ids[r[has], at[has] - 1], low[has])
        return out


class Encoder(dict):
    """Maps a word to its ids as little-endian bytes. Words not met before are merged together, by length."""

    def __init__(self, ranks: dict[bytes, int] | RankMap, pattern: str):
        self.map = ranks if isinstance(ranks, RankMap) else RankMap(ranks)
        self.basic, self.full = word_patterns(pattern)

    def __missing__(self, word: str) -> bytes:
        return np.array(merge_word(word.encode(), self.map.ranks), "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        by: dict[int, list[str]] = {}
        for w in words:
            raw = w.encode()
            if (whole := self.map.ranks.get(raw)) is not None:
                self[w] = whole.to_bytes(4, "little")
            elif len(raw) <= MEMO_BYTES:
                by.setdefault(len(raw), []).append(w)
        for group in by.values():
            for k in range(0, len(group), 1 << 12):
                part = group[k : k + (1 << 12)]
                self.update(zip(part, self.map.merge([w.encode() for w in part]), strict=True))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, four bytes each."""
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (size < 1 << 20 or end == at):
                size += len(texts[end])
                end += 1
            if len(self) > MEMO_WORDS:
                self.clear()
            words = [(self.basic if len(t.encode("utf-16-le")) == 2 * len(t) else self.full).findall(t) for t in texts[at:end]]
            self.learn(set().union(*words).difference(self))
            for w in words:
                yield b"".join(map(self.__getitem__, w))
            at = end

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


class Decoder:
    """Concatenates the pieces of ids, as one gather over the joined vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.joined = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        length = self.length[ids]
        ends = np.cumsum(length)
        at = np.repeat(self.start[ids] - (ends - length), length) + np.arange(ends[-1])
        return self.joined[at].tobytes()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """One row per document with its id and the asked outputs, of: ids (binary, four bytes each), ids_u2 (two bytes each), decoded (binary),
    n_tokens, ids_sha256, decoded_sha256. Narrow: no shuffle."""
    kinds = {"ids": "binary", "ids_u2": "binary", "decoded": "binary", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    small_batches(rows.sparkSession)
    ranks = rows.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))  # of fixed size: one vocabulary
    key = hash((ranks_path, pattern, len(ranks.value)))
    decodes = any(o.startswith("decoded") for o in outputs)
    fields = {"ids": pa.binary(), "ids_u2": pa.binary(), "decoded": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept("bpe", key, lambda: Encoder(ranks.value, pattern))  # one for each vocabulary and Python worker
        decoder = Decoder(ranks.value) if decodes else None
        for batch in batches:
            out: dict[str, list] = {o: [] for o in outputs}
            for ids in encoder.encode_all([t or "" for t in batch.column("text").to_pylist()]):
                decoded = decoder.decode(np.frombuffer(ids, "<u4")) if decoder else b""
                row = {"ids": ids, "decoded": decoded, "n_tokens": len(ids) // 4}
                if "ids_u2" in out:  # RankMap takes no ids above two bytes
                    row["ids_u2"] = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                for o in outputs:
                    out[o].append(hashlib.sha256(row[o[:-7]]).hexdigest() if o.endswith("_sha256") else row[o])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[o], fields[o]) for o in outputs)], ["doc_id", *outputs])

    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{o} {kinds[o]}" for o in outputs))
