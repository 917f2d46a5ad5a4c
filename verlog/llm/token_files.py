"""Token ids as Parquet list columns: dictionary or delta encoded, with set row groups and page indexes.

Documents are dealt by ranges of doc_id and sorted, so a file holds one range and files follow each other. Only the
raw text crosses the shuffle; encoding happens after it, and the sampling of the ranges reads doc_id alone. A file
row is (doc_id, shard, shard_start, n_tokens, ids): the metadata columns answer selective reads without the ids, and
``shard_start`` with the totals of the shards before gives a document's place among all ids.

Defined results: a null text is empty and gets the end id alone; rows with equal doc_id are ordered by text and each
keeps its own row; a null doc_id sorts first; an empty table writes no rows and reads back none; other columns of the
input are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small

#: Words kept by a worker before it keeps only those just met, and the longest word that is kept.
MEMO_WORDS, MEMO_BYTES = 900_000, 48
#: Text whose distinct words are looked up at once, about: larger pieces repeat fewer look-ups.
CHUNK_BYTES = 8 << 20
#: Punctuation that is split off the end of a word, and how much of it at most; a longer run stays with its word.
_TAIL, TAIL_BYTES = np.isin(np.arange(256), list(b".,!?:;#$%&*|")), 8
_ALNUM = np.array([bytes([b]).isalnum() for b in range(256)])
#: Lower-case letters that this normalizer and these pre-tokenizers leave as one piece, and the bytes of them that
#: stand as other characters in it.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_PLAIN_PARTS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
_BYTE_CHARS = (("\x9f", "\u0141"), ("\xa0", "\u0142"), ("\xad", "\u0143"))
SCHEMA = "doc_id bigint, shard int, shard_start bigint, n_tokens bigint, ids array<int>"
_TOKENIZERS: dict[int, object] = {}


def _tokenizer(text: str):
    """One tokenizer for each Python worker."""
    if (key := hash(text)) not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS.clear()
        _TOKENIZERS[key] = t = Tokenizer.from_str(text)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
    return _TOKENIZERS[key]


def _bytes_list(array: pa.Array) -> list[bytes]:
    """``array.to_pylist()`` of a binary column without nulls, in a fifth of its time."""
    _, offsets, data = array.buffers()
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in pairwise(np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].tolist())]


class WordEncoder(dict):
    """ASCII white space ends a word for the tokenizer, which drops it; so each distinct word is encoded once.

    Where the tokenizer's parts are the known ones, ASCII punctuation behind a letter or digit is a token of its own, so
    it is split off and words are kept without it; and words of plain lower-case letters go to the library's model
    behind a split at spaces, as the normalizer and pre-tokenizers would pass them on unchanged. The library gets the
    other distinct words as long texts, a mark between each two: one character that is in none of them, and so a token
    of its own wherever it stands.
    """

    MARKS = "^~`=|%$#&*"

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.plain, suffix = None, getattr(tokenizer.model, "end_of_word_suffix", None)
        if suffix and tuple(p and json.loads(p.__getstate__()) for p in (tokenizer.normalizer, tokenizer.pre_tokenizer)) == _PLAIN_PARTS:
            from tokenizers import Tokenizer, pre_tokenizers

            self.plain = Tokenizer(tokenizer.model)  # the same model behind nothing but a split at spaces
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocab = tokenizer.get_vocab(with_added_tokens=False)
            self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
            self.ends_word[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self.marks = {m: i[0] for m in self.MARKS if len(i := tokenizer.encode(m, add_special_tokens=False).ids) == 1}

    def __missing__(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<i4").tobytes()

    def _encode(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            joined = b" ".join(part).decode()
            mark = next((m for m in self.marks if m not in joined), None)
            if mark is None or not joined.isascii() and unicodedata.normalize("NFC", joined) != joined:
                self.update((w, self.__missing__(w)) for w in part)
                continue
            got = self.tokenizer.encode_batch_fast([joined.replace(" ", f" {mark} ")], add_special_tokens=False)[0]
            ids = np.array(got.ids, "<i4")
            ends = np.append(np.flatnonzero(ids == self.marks[mark]), len(ids)).tolist()
            if len(ends) != len(part):
                self.update((w, self.__missing__(w)) for w in part)
                continue
            raw = ids.tobytes()
            self.update(zip(part, (raw[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True)), strict=True))

    def _encode_plain(self, words: list[bytes]) -> bool:
        """Words of plain letters by the model: the id that ends a word is told by its token. Whether all were told apart."""
        ids = []
        for at in range(0, len(words), 50):
            text = b" ".join(words[at : at + 50]).decode("latin-1")
            for byte, char in _BYTE_CHARS:
                text = text.replace(byte, char)
            ids += self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = np.array(ids, "<i4")
        ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(ends) != len(words) or len(ids) != (ends or [0])[-1]:
            return False
        raw = ids.tobytes()
        self.update(zip(words, (raw[4 * a : 4 * b] for a, b in pairwise([0, *ends])), strict=True))
        return True

    def learn(self, words: list[bytes]) -> None:
        plain, rest = [], []
        for w in words:
            if len(w) <= MEMO_BYTES:
                (plain if self.plain and (w.isalpha() and w.islower() or _PLAIN(w)) else rest).append(w)
        if plain and not self._encode_plain(plain):
            rest += plain
        self._encode(rest)

    def _pieces(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(the words without the punctuation behind them, that being a piece of its own; the place of each word's first
        piece, and the number of pieces). ASCII capitals are lowered, unless a mark that may compose with one is there.
        Words of a tokenizer of other parts stay as they are."""
        words = words.cast(pa.string())
        _, offsets, data = words.buffers()
        at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
        raw = data.to_pybytes() if data else b""
        if self.plain and b"\xcc" not in raw and b"\xcd" not in raw:  # U+0300 to U+037F
            raw = raw.lower()
        byte, start, core = np.frombuffer(raw, np.uint8), at[:-1], at[1:].copy()
        left = np.flatnonzero(core > start) if self.plain else np.zeros(0, np.int64)
        for _ in range(TAIL_BYTES + 1):
            left = left[_TAIL[byte[core[left] - 1]]]
            core[left] -= 1
            left = left[core[left] > start[left]]
        cut = np.flatnonzero((core < at[1:]) & (core > start) & (core >= at[1:] - TAIL_BYTES))
        cut = cut[_ALNUM[byte[core[cut] - 1]] | (byte[core[cut] - 1] >= 128) & (core[cut] - start[cut] >= 2) & (byte[core[cut] - 2] == 0xC3) & ~np.isin(byte[core[cut] - 1], (0x97, 0xB7))]
        place = np.arange(len(at), dtype=np.int64)
        place[1:] += np.cumsum(np.bincount(cut, minlength=len(start)))
        edges = np.empty(place[-1] + 1, np.int32)
        edges[place], edges[place[cut] + 1] = at, core[cut]
        return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(raw)]), place

    def encode_column(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text with its end id, all those ids): words are told apart and laid out by columns."""
        parts = pc.ascii_split_whitespace(texts)
        pieces, first_piece = self._pieces(pc.list_flatten(parts))
        words = pieces.dictionary_encode()
        distinct = _bytes_list(words.dictionary)
        if len(self) > MEMO_WORDS:
            met = {w: self[w] for w in distinct if w in self}
            self.clear()
            self.update(met)
        self.learn([w for w in distinct if w not in self])
        known = list(map(self.__getitem__, distinct))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, first = np.frombuffer(b"".join(known), "<i4"), np.cumsum(size) - size
        index = words.indices.to_numpy(zero_copy_only=False)
        per_word = size[index]
        ends = np.concatenate(([0], np.cumsum(per_word)))
        place = np.arange(ends[-1]) + np.repeat(first[index] - ends[:-1], per_word)
        of_text = first_piece[np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)))]
        n = np.diff(ends[of_text]) + 1
        last = np.cumsum(n) - 1
        is_id = np.ones(len(place) + len(n), bool)
        is_id[last] = False
        ids = np.full(len(is_id), end_id, "<i4")
        ids[is_id] = flat[place]
        return n, ids


def _encoder(model: str) -> WordEncoder:
    """One encoder, and so one set of known words, for each Python worker."""
    tokenizer = _tokenizer(model)
    if getattr(_encoder, "kept", (None,))[0] is not tokenizer:
        _encoder.kept = tokenizer, WordEncoder(tokenizer)
    return _encoder.kept[1]


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int = 1, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000, compression: str = "zstd") -> None:
    """Encode ``docs`` (doc_id, text) and write the files. ``encoding``: dictionary, or delta (binary packed)."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())  # of fixed size: one vocabulary
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, start = _encoder(model.value), TaskContext.get().partitionId(), 0
        for whole in batches:
            sizes = pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False)
            piece = np.cumsum(sizes, dtype=np.int64) // CHUNK_BYTES  # rows of one number are encoded and written together
            edges = np.flatnonzero(np.diff(piece, prepend=-1, append=-1)).tolist() if len(piece) else []
            for at, to in zip(edges[:-1], edges[1:], strict=True):
                batch = whole.slice(at, to - at)
                n, ids = encoder.encode_column(batch.column("text"), end_id)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), shard, np.int32)), pa.array(start + ends - n), pa.array(n), lists], ["doc_id", "shard", "shard_start", "n_tokens", "ids"])
                start += int(n.sum())

    options = {"compression": compression, "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "v2" if encoding == "delta" else "v1", "parquet.dictionary.page.size": 1 << 20}
    rows.mapInArrow(run, SCHEMA).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, start (ids of all documents before it), n_tokens: from the metadata columns alone."""
    meta = read_token_files(spark, path).select("doc_id", "shard", "shard_start", "n_tokens")
    return meta.join(*_shard_starts(meta)).select("doc_id", "shard", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens")


def _shard_starts(meta: DataFrame):
    totals = meta.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row for each file's range
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return (F.broadcast(before) if small(before, 16) else before), "shard"


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: lengths and checksums are taken from the stored ids."""
    files = read_token_files(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, at = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("shard_start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    rows = files.select("doc_id", "shard", "shard_start", "ids").mapInArrow(run, "doc_id bigint, shard int, shard_start bigint, n_tokens bigint, ids_crc32 bigint")
    meta = files.select("shard", "n_tokens")
    return rows.join(*_shard_starts(meta)).select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
