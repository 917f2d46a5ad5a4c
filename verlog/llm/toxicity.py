"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around each hit.

The lexicon is learned: words, and stems that words begin with, whose document frequency among toxic training rows
far exceeds that among the others. A stem must begin several words, none of which accounts for most of its rows; it
makes the longer ones and the words that it begins superfluous.
It lies in a trie; a word of a text is looked up by walking the trie together with the word's Levenshtein automaton
(one edit, for terms of five letters and more; two neighbours that changed places count as one), so that misspelled
terms are met too. A token is looked up by its runs of letters, as a whole with the digits and marks inside of it, and
by its letters alone, so neither a digit for a letter nor marks between letters hide a term. Each hit is weighed by its
window: quotation marks around it speak for a mention, further hits near by for abuse. A logistic regression over
the sums of these weights gives the score. Lexicon and regression are learned from all labelled rows: a bitmap of hashed
ids, which is broadcast, leaves out most texts without a label before a join; rows of equal features are counted, and
each of Newton's steps takes sums over them, on the driver where these are few, else in tasks. Sums are of whole
numbers, so that no order of rows changes a score.

Defined results: null and empty texts have no hits and score as such; label rows with a null are left out, repeated
ones count once (toxic wins); repeated documents get equal scores; no labels: nothing is learned and every score is
0; other columns are carried by ``keep_clean`` and ignored by ``score_documents``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MAX_BROADCAST_BYTES, cut, drop_cut, kept, small_batches, tidy

#: The bitmap of ids: bits for each, bits at most (more ids share them then), bits of a binary of Spark's bitmap functions.
ID_BITS, MAX_BITS, BUCKET = 8, 8 * MAX_BROADCAST_BYTES, 1 << 15
#: What terms of the regression's sums are multiplied by and rounded; counted rows up to which the driver takes the sums.
SCALE, DRIVER_ROWS = 1 << 30, 50_000
#: What a term must show. As each is in at least ``MIN_TOXIC_SHARE`` of the toxic training rows, the lexicon has at most
#: the mean number of distinct words and stems of such a row divided by that share.
MIN_TOXIC_DOCS, MIN_TOXIC_SHARE, MIN_LOG_ODDS = 3, 0.015, 2.0
#: Letters of a stem, which is written with an asterisk; part of its rows that one longer term may have.
STEM_FROM, STEM_TO, STEM_SHARE = 3, 7, 0.8
#: Part of the largest weight from which a term is met misspelled, and what such a hit weighs.
FUZZY_SHARE, FUZZY_WEIGHT = 0.6, 0.8
#: Words on each side of a hit that speak for or against it.
WINDOW = 6
#: Words kept by a task before it starts over.
MEMO_WORDS = 120_000
_LETTERS = re.compile(r"[^\W\d_]+")
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")
_MARK, MASK = re.compile(r"[\W\d_]"), "\0"
_TOKEN = re.compile(r"\S+")
_QUOTES = frozenset("\"“”„«»‟‹›")
N_FEATURES = 6


class Trie:
    """Terms with weights; ``find`` gives the term itself, its stem, or the best of the strong words within one edit.

    Strong terms have ``FUZZY_SHARE`` of the largest weight at least: words near a weak one are no evidence. Of terms of
    four letters only a digit or mark in a letter's place counts as an edit."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.root = weights, {}
        least = FUZZY_SHARE * max(weights.values(), default=0.0)
        strong = sorted((t for t, w in weights.items() if w >= least and len(t) >= 4 and "*" not in t), key=lambda t: (weights[t], t))
        self.masked = {t[:i] + MASK + t[i + 1 :]: t for t in strong for i in range(len(t))}
        strong = [t for t in strong if len(t) >= 5]
        for term in strong:
            node = self.root
            for ch in term:
                node = node.setdefault(ch, {})
            node[""] = term
        # words one edit apart are equal after at most one deletion each: few others reach the automaton
        self.near = {v for t in strong for v in (t, *(t[:i] + t[i + 1 :] for i in range(len(t))))}
        self.longest = max(map(len, strong), default=0)
        # one edit leaves the first two letters of a term or its last two as they are
        self.heads, self.tails = {t[:2] for t in strong}, {t[-2:] for t in strong}
        self.stems = {t[:STEM_FROM] for t in weights if t[-1] == "*"}
        self.swapped = {t[:i] + t[i + 1] + t[i] + t[i + 2 :]: t for t in strong for i in range(len(t) - 1)}

    def find(self, word: str) -> tuple[str, int] | None:
        if word in self.weights:
            return word, 0
        if word[:STEM_FROM] in self.stems:
            for k in range(STEM_FROM, min(STEM_TO, len(word)) + 1):
                if (stem := word[:k] + "*") in self.weights:
                    return stem, 0
        if word in self.swapped:
            return self.swapped[word], 1
        if not word.isalpha() and (term := self.masked.get(_MARK.sub(MASK, word))):
            return term, 1
        n, near = len(word), self.near
        if word[:2] not in self.heads and word[-2:] not in self.tails:
            return None
        if not 4 <= n <= self.longest + 1 or not (word in near or any(word[:i] + word[i + 1 :] in near for i in range(n))):
            return None
        # automaton states as bits: places in the word that are reached with no edit, and with one
        places: dict[str, int] = {}
        for i, ch in enumerate(word):
            places[ch] = places.get(ch, 0) | 1 << i
        best, full, end, of = (0.0, ""), (2 << n) - 1, 1 << n, places.get
        stack = [(self.root, 1, 2)]
        while stack:
            node, none, one = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    if (none | one) & end:
                        best = max(best, (self.weights[child], child))
                    continue
                same = of(ch, 0)
                to = (none & same) << 1
                # the same letter; a letter too few; another letter; a letter too many
                to_one = ((one & same) << 1 | none | none << 1 | to << 1) & full
                if to or to_one:
                    stack.append((child, to, to_one))
        return (best[1], 1) if best[1] else None


class Scorer:
    def __init__(self, weights: dict[str, float]):
        self.trie, self.known, self.words, self.hits = Trie(weights), set(), {}, {}

    def learn(self, tokens: set[str]) -> None:
        """Looks up tokens not met before: their letter runs, their inner part and their letters; the heaviest counts."""
        words, weights = self.words, self.trie.weights
        for token in tokens:
            best, parts = None, (token,)
            if not token.isalpha():
                parts = _LETTERS.findall(token)
                if parts and (inner := _ENDS.sub("", token)) != parts[0]:
                    parts = [*parts, inner, "".join(parts)]
            for w in parts:
                if w not in words:
                    found = self.trie.find(w)
                    words[w] = (weights[found[0]], found[1]) if found else None
                if (x := words[w]) and (best is None or x > best):
                    best = x
            if best:
                self.hits[token] = best
        self.known |= tokens

    def features(self, text: str) -> list[float]:
        out = [0.0] * N_FEATURES
        low = text.lower()
        tokens = set(low.split())
        if new := tokens.difference(self.known):
            if len(self.known) > MEMO_WORDS:
                self.known, self.words, self.hits, new = set(), {}, {}, tokens
            self.learn(new)
        if tokens.isdisjoint(self.hits):
            return out
        at = [(m.start(), m.end(), self.hits.get(m[0])) for m in _TOKEN.finditer(low)]
        places = [i for i, x in enumerate(at) if x[2]]
        plain = quoted = top = 0.0
        terms = set()
        for k, i in enumerate(places):
            a, b, (weight, edits) = at[i]
            before = low[at[max(0, i - WINDOW)][0] : a]
            after = low[b : at[min(len(at) - 1, i + WINDOW)][1]]
            others = sum(abs(places[j] - i) <= WINDOW for j in range(max(0, k - WINDOW), min(len(places), k + WINDOW + 1))) - 1
            weight *= (1 + 0.25 * min(others, 4)) * (FUZZY_WEIGHT if edits else 1)
            terms.add(low[a:b])
            if sum(c in _QUOTES for c in before) % 2 and any(c in _QUOTES for c in after):
                quoted += weight
            else:
                plain += weight
                top = max(top, weight)
        return [np.log1p(plain), np.log1p(quoted), top / 5, min(len(terms), 8) / 4, min(1.0, 20 * len(places) / len(at)), float(plain > 0)]


def _maybe_labelled(docs: DataFrame, lab: DataFrame) -> DataFrame:
    """``docs`` without most of the rows whose doc_id is not in ``lab`` (a written cut); all others stay."""
    buckets = min(lab.count() * ID_BITS, MAX_BITS) // BUCKET + 1
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(buckets * BUCKET)).alias("place")
    maps = lab.select(place).groupBy(F.expr(f"place div {BUCKET}").alias("bucket")).agg(F.bitmap_construct_agg(F.expr(f"place % {BUCKET}")).alias("bits"))
    is_set = F.expr(f"bit_get(bigint(conv(hex(substring(bits, int(place % {BUCKET} div 8) + 1, 1)), 16, 10)), int(place % 8)) = 1")
    rows = docs.select("*", place).join(F.broadcast(maps), F.expr(f"place div {BUCKET} = bucket") & is_set)  # bounded by MAX_BITS
    return rows.select(*docs.columns)


def _train_rows(docs: DataFrame, lab: DataFrame) -> DataFrame:
    """doc_id, text, toxic of all rows of ``docs`` that ``lab`` (doc_id, toxic; a written cut) has."""
    return _maybe_labelled(docs.select("doc_id", F.col("text").cast("string").alias("text")), lab).join(lab.hint("shuffle_hash"), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, train) -> tuple[dict[str, float], np.ndarray | None]:
    """(lexicon with weights, coefficients with the intercept last). ``train``: which rows may be learned from."""
    spark = docs.sparkSession
    lab = labels.where("doc_id is not null and toxic is not null").where(train).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    lab = cut(spark, lab, "toxicity-labels")
    rows = cut(spark, _train_rows(docs, lab), "toxicity-train")
    drop_cut(spark, lab)
    total = rows.agg(F.sum("toxic").alias("p"), F.sum(F.expr("1 - toxic")).alias("n")).first()
    pos, neg = total["p"] or 0, total["n"] or 0
    if not pos or not neg:
        drop_cut(spark, rows) if pos + neg else None
        return {}, None
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 2))
    stems = F.transform(F.sequence(F.lit(STEM_FROM), F.lit(STEM_TO)), lambda k: F.transform(F.filter("words", lambda w: F.length(w) >= k), lambda w: F.concat(w.substr(F.lit(1), k), F.lit("*"))))
    words = rows.select("toxic", words.alias("words")).select("toxic", F.explode(F.array_distinct(F.concat("words", F.flatten(stems)))).alias("w"))
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
    often = words.where("toxic = 1").groupBy("w").agg(F.count("*").alias("p")).where(F.col("p") >= max(MIN_TOXIC_DOCS, int(MIN_TOXIC_SHARE * pos)))
    often = cut(spark, often, "toxicity-terms")
    others = words.where("toxic = 0").join(F.broadcast(often.select("w")), "w").groupBy("w").agg(F.count("*").alias("n"))  # bounded: see MIN_TOXIC_SHARE
    counts = often.join(others, "w", "left").select("w", "p", F.coalesce("n", F.lit(0)).alias("n")).withColumn("odds", odds)
    terms = {r["w"]: r for r in counts.where(F.col("odds") >= MIN_LOG_ODDS).collect()}  # bounded: see MIN_TOXIC_SHARE
    drop_cut(spark, often)
    most: dict[str, int] = {}  # rows of a stem's commonest longer term
    for w, r in terms.items():
        for k in range(STEM_FROM, min(STEM_TO, len(w) - 1) + 1):
            if (stem := w[:k] + "*") != w:
                most[stem] = max(most.get(stem, 0), r["p"])
    terms = {w: r for w, r in terms.items() if w[-1] != "*" or most.get(w, r["p"]) <= STEM_SHARE * r["p"]}
    found = [r for w, r in terms.items() if not any(w[:k] + "*" in terms and w[:k] + "*" != w for k in range(STEM_FROM, min(STEM_TO, len(w)) + 1))]
    # a term seen in a few documents only may be chance: its weight shrinks
    weights = {r["w"]: float(r["odds"] * r["p"] / (r["p"] + 3)) for r in found}
    features = _featurize(rows.select("doc_id", "text", "toxic"), weights, ["toxic"])
    counted = cut(spark, features.groupBy("f", "toxic").agg(F.count("*").alias("n")), "toxicity-features")
    drop_cut(spark, rows)
    beta = _fit(_driver_sums(counted.collect()) if counted.count() <= DRIVER_ROWS else _task_sums(counted))
    drop_cut(spark, counted)
    return weights, beta


def _terms(x: np.ndarray, y: np.ndarray, n: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """First and negative second derivatives of the log-likelihood at ``beta`` (the intercept last) over rows that are
    there ``n`` times: whole numbers, each row's times SCALE and rounded."""
    x = np.hstack([x, np.ones((len(x), 1))])
    z = sum(x[:, k] * b for k, b in enumerate(beta))  # not by BLAS, which adds in an order of its own
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    rounded = lambda v: n @ np.rint(v * SCALE).astype(np.int64)
    w = p * (1 - p) + 1e-9
    return np.concatenate([rounded((y - p)[:, None] * x), *(rounded((w * x[:, k])[:, None] * x) for k in range(x.shape[1]))])


def _driver_sums(rows: list) -> Callable:
    """``sums`` of ``_fit`` over rows on the driver: f, toxic, n."""
    x, y, n = np.array([r["f"] for r in rows]), np.array([r["toxic"] for r in rows], float), np.array([r["n"] for r in rows], np.int64)
    return lambda beta: _terms(x, y, n, beta).tolist()


def _task_sums(counted: DataFrame) -> Callable:
    """``sums`` of ``_fit`` over a DataFrame of the columns of ``_driver_sums``."""

    def sums(beta: np.ndarray) -> list[int]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("f").flatten().to_numpy().reshape(-1, N_FEATURES)
                    v = _terms(x, batch.column("toxic").to_numpy().astype(float), batch.column("n").to_numpy(), beta)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], ["k", "v"])

        added = counted.mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v"))
        return [int(r["v"]) for r in sorted(added.collect(), key=lambda r: r["k"])]  # one for each derivative

    return sums


def _fit(sums: Callable, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression with a ridge, by Newton's steps. ``sums(beta)``: what ``_terms`` gives for all rows."""
    width = N_FEATURES + 1
    beta, penalty = np.zeros(width), np.diag([ridge] * N_FEATURES + [1e-6])
    for _ in range(30):
        got = np.array([v / SCALE for v in sums(beta)])
        step = np.linalg.solve(got[width:].reshape(width, width) + penalty, got[:width] - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _featurize(rows: DataFrame, weights: dict[str, float], keep: list[str]) -> DataFrame:
    lexicon = rows.sparkSession.sparkContext.broadcast(weights)  # bounded: see MIN_TOXIC_SHARE
    small_batches(rows.sparkSession)
    key = hash(tuple(sorted(weights.items())))
    schema = rows.select("doc_id", *keep).schema.add("f", T.ArrayType(T.DoubleType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept("toxicity", key, lambda: Scorer(lexicon.value))
        for batch in batches:
            f = [scorer.features(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in keep), pa.array(f, pa.list_(pa.float64()))], ["doc_id", *keep, "f"])

    return rows.mapInArrow(tidy(run), schema)


def score_documents(docs: DataFrame, labels: DataFrame, *, train=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, score (0 to 1) and predicted (1 from 0.5 on). Narrow but for the learning."""
    weights, beta = learn(docs, labels, F.lit(True) if train is None else train)
    rows = docs.select("doc_id", *keep, *([] if "text" in keep else [F.col("text").cast("string").alias("text")]))
    if beta is None:
        score = F.lit(0.0)
        return rows.select("doc_id", *keep, score.alias("score"), F.lit(0).alias("predicted"))
    rows = _featurize(rows, weights, list(keep))
    z = sum((F.col("f")[k] * float(b) for k, b in enumerate(beta[:-1])), F.lit(float(beta[-1])))
    rows = rows.select("doc_id", *keep, (1 / (1 + F.exp(-z))).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, *, train=None) -> DataFrame:
    """``docs`` without the documents that are predicted toxic."""
    rest = tuple(c for c in docs.columns if c != "doc_id")
    return score_documents(docs, labels, train=train, keep=rest).where("predicted = 0").select(*docs.columns)
