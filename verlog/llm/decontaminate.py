"""Benchmark decontamination with a generalised suffix automaton of the normalised items.

Words are runs of ASCII letters (lower-cased), digits and all characters beyond ASCII. The automaton holds every
item's words; a document's words stream through it, and the longest matching length at each word tells whether a
window of ``window`` item words ends there. An item of fewer words is one window. A run of words outside the items'
vocabulary resets the automaton, so only runs that could hold a window are walked.

The items are split into automata of at most ``MAX_ITEM_WORDS`` words, so what is broadcast is bounded; documents
pass them one after another, with a written cut between, and spans and items are united.

Defined results: null and empty texts have no words and are clean; items without words never occur; repeated items
count once by item_id; a null item_id counts as ''; repeated documents each get their row; no items: all clean; other
columns are carried by ``clean_documents`` and ignored by ``find_contamination``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches, tidy

#: Words of one automaton, which a Python worker holds: about 1.2 KB each, so some 120 MB.
MAX_ITEM_WORDS = 100_000
#: ASCII letters fall to lower case; other ASCII but digits becomes a space.
_TABLE = bytes((b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class SuffixAutomaton:
    """Generalised over sequences of word numbers; knows which items hold each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, word in coded:
            last = 0
            for c in word:
                last = self._extend(last, c)
        self.items: list[set[str]] = [set() for _ in self.next]
        short: list[dict[int, set[str]]] = [{} for _ in self.next]
        self.least = min([window, *(len(w) for _, w in coded)])
        for name, word in coded:
            v = 0
            for c in word:
                v = u = self.next[v][c]
                while u > 0 and name not in self.items[u]:
                    self.items[u].add(name)
                    u = self.link[u]
            if len(word) < window:
                while self.length[self.link[v]] >= len(word):
                    v = self.link[v]
                short[v].setdefault(len(word), set()).add(name)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        #: The state of a state's last ``window`` words, -1 for shorter ones; the short items that end there.
        self.top, self.short = [-1] * len(self.next), [()] * len(self.next)
        for v in order:
            if self.length[v] >= window:
                self.top[v] = v if self.length[self.link[v]] < window else self.top[self.link[v]]
            self.short[v] = (*self.short[self.link[v]], *((n, frozenset(x)) for n, x in sorted(short[v].items())))
        self.items = [frozenset(x) if self.length[v] >= window > self.length[self.link[v]] else frozenset() for v, x in enumerate(self.items)]

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, q, c)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [a, b) of hit words, ascending and merged, and the items found."""
        if len(words) < self.least or not self.vocabulary:
            return [], set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0])))).reshape(-1, 2)
        edge = edge[edge[:, 1] - edge[:, 0] >= self.least]
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        nxt, link, length, top, short, window = self.next, self.link, self.length, self.top, self.short, self.window
        for a, b in edge.tolist():
            v = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                while v and c not in nxt[v]:
                    v = link[v]
                    n = length[v]
                if c in nxt[v]:
                    v = nxt[v][c]
                    n += 1
                hit = 0
                if n >= window:
                    hit = window
                    # the state of the last ``window`` words
                    found |= self.items[top[v]]
                for m, names in short[v]:
                    if m <= n:
                        hit = max(hit, m)
                        found |= names
                if hit:
                    start = i - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, found


def _automata(benchmark: DataFrame, window: int, text_col: str = "text") -> list[SuffixAutomaton]:
    """Parts of bounded size; items stream to the driver one partition at a time."""
    rows = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("i"), benchmark[text_col].cast("string").alias("t"))
    parts, size = [[]], 0
    for row in rows.toLocalIterator():
        words = words_of(row["t"] or "")
        if size + len(words) > MAX_ITEM_WORDS and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append((row["i"], words))
        size += len(words)
    return [SuffixAutomaton(p, window) for p in parts]


def _merge(*spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(x for s in spans for x in s):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _annotate(docs: DataFrame, benchmark: DataFrame, window: int, keep: list[str], max_coverage: float | None = None) -> DataFrame:
    """With the ``keep`` columns: n_words, spans (flat int array of word places), items; or, given ``max_coverage``, the
    cleaned text of documents that are covered so far at most."""
    spark = docs.sparkSession
    small_batches(spark)
    name = lambda c: f"{c}_{uuid.uuid4().hex}"  # noqa: E731  columns of the caller's may have any name
    text, spans_, items_ = name("text"), name("spans"), name("items")
    rows = docs.select(*(docs[c] for c in keep), docs["text"].cast("string").alias(text))
    rows = rows.withColumns({spans_: F.lit(None).cast("array<int>"), items_: F.lit(None).cast("array<string>")})
    schema = rows.schema
    told = rows.select(*keep).schema
    told = told.add("text", T.StringType()) if max_coverage is not None else told.add("n_words", T.LongType()).add("spans", T.ArrayType(T.IntegerType())).add("items", T.ArrayType(T.StringType()))
    parts = _automata(benchmark, window)
    for k, part in enumerate(parts):
        automaton, last = spark.sparkContext.broadcast(part), k == len(parts) - 1

        def run(batches: Iterable[pa.RecordBatch], automaton=automaton, last=last) -> Iterator[pa.RecordBatch]:
            scan = automaton.value.scan
            for batch in batches:
                texts, spans, items, n = batch.column(text).to_pylist(), [], [], []
                for t, s, x in zip(texts, batch.column(spans_).to_pylist(), batch.column(items_).to_pylist(), strict=True):
                    words = words_of(t or "")
                    at, found = scan(words)
                    spans.append(_merge(at, list(zip(s[::2], s[1::2], strict=True))) if s else at)
                    items.append(sorted(found | set(x or ())))
                    n.append(len(words))
                own = [batch.column(c) for c in keep]
                if last and max_coverage is not None:
                    left = [sum(b - a for a, b in s) <= max_coverage * m for s, m in zip(spans, n, strict=True)]
                    texts = pa.array([_cut_out(t, s) if s and t else t for t, s in zip(texts, spans, strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([*own, texts], [*keep, "text"]).filter(pa.array(left, pa.bool_()))
                    continue
                flat = pa.array([[y for z in s for y in z] for s in spans], pa.list_(pa.int32()))
                found = pa.array(items, pa.list_(pa.string()))
                if last:
                    yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), flat, found], [*keep, "n_words", "spans", "items"])
                else:
                    yield pa.RecordBatch.from_arrays([*own, batch.column(text), flat, found], [*keep, text, spans_, items_])

        rows = rows.mapInArrow(tidy(run), told if last else schema)
        if not last:
            rows = cut(spark, rows, "decontaminate")
    return rows


def _cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans, from a span's first character to its last."""
    raw = text.encode()
    at = [(m.start(), m.end()) for m in _WORD.finditer(raw.translate(_TABLE))]
    done, left = 0, []
    for a, b in spans:
        left.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*left, raw[done:]]).decode()


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (array), spans (array of word places)."""
    rows = _annotate(docs.select("doc_id", "text"), benchmark, window, ["doc_id"])
    n_hit = F.expr("aggregate(spans, 0L, (s, x) -> x - s) ")  # alternating sum, from the last end on: s' = x - s
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "items", "spans")


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without the words that windows hit, from a span's first character to its last; a document of which
    more than ``max_coverage`` of the words are hit goes as a whole. n_chars, where there is one, is counted anew."""
    out = _annotate(docs, benchmark, window, [c for c in docs.columns if c != "text"], max_coverage)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)
