"""Quality rules: distribution divergence from language references, with length guards. DataFrame functions only.

Each document has two histograms, of character classes and of its language's common words. A language's common words
are the most frequent ones of all its documents; a language without a word of letters has those of all languages.
The reference of a language is the sum of the histograms over all its documents that pass the base rules, on top of a
prior of fixed weight: the shares of all documents, for character classes of all languages, for words of the language's
own. So a language of few documents has a reference too, and no number of documents switches a test on. The
Jensen-Shannon divergence from it (base 2, its root being a distance) decides, for documents long enough to have a
histogram.

Defined results: a null text has no words and fails the base rules, as every text of under 50 words; a null language is
one of its own; ties and repeated rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_BYTES, cut, drop_cut

#: Base limits.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A divergence is judged from so many characters and words on.
GUARD_CHARS, GUARD_WORDS = 200, 80
#: Limits of the two divergences; a short text has more noise in its counts.
MAX_CHAR_JSD, CHAR_NOISE, MAX_WORD_JSD, WORD_NOISE = 0.025, 12.0, 0.10, 6.0
#: How many common words a language has, and the prior's weight in characters and words.
COMMON, PRIOR_CHARS, PRIOR_WORDS = 10, 20_000.0, 4_000.0
#: The entry of all languages.
ANY = "\0any"
CLASSES = {"lower": "[a-z]", "upper": r"\p{Lu}", "other_letter": r"[\p{L}&&[^a-z\p{Lu}]]", "digit": r"\p{N}", "stop": "[.,]", "symbol": "[#*$%&|<>]", "punct": r"[\p{P}&&[^.,#*%&]]"}


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in three-word windows that the text holds twice or more. Windows are told apart by 64-bit hashes."""
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = _let(ordered, lambda s: F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])))
        starts = F.array_sort(F.transform(twice, lambda e: e["i"].cast("long")))
        fold = F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("at")), lambda s, x: F.struct((s["n"] + F.least(F.lit(3).cast("long"), x - s["at"])).alias("n"), x.alias("at")))
        return fold["n"]

    return _let(hashes, lambda h: F.when(F.size(h) > F.size(F.array_distinct(h)), covered(h)).otherwise(F.lit(0).cast("long")))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, lang and text, without nulls but in doc_id."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return docs.select("doc_id", lang.alias("lang"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def _words(text: Column) -> Column:
    """The words of a text, and an empty one where it begins or ends with white space."""
    return F.split(text, r"[\x20\x09-\x0D]+")


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, w, n: how often all documents of a language have a word with a letter, in lower case."""
    words = _texts(docs).select("lang", F.explode(_words(F.lower("text"))).alias("w"))
    return words.groupBy("lang", "w").agg(F.count("*").alias("n")).where(F.col("w").rlike(r"\p{L}"))


def common_words(counts: DataFrame) -> DataFrame:
    """lang, common (its commonest words), prior (their counts and that of all its other words): a row for each language
    of ``counts`` and one for all of them. No task has more than ``COMMON`` words a language of another one."""
    every = counts.groupBy("w").agg(F.sum("n").alias("n")).select(F.lit(ANY).alias("lang"), "w", "n")
    counts = counts.unionByName(every)
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("rank") <= COMMON)
    top = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "w", "n"))).alias("top"))  # COMMON words a language
    found = counts.groupBy("lang").agg(F.sum("n").alias("n")).join(top, "lang")
    own = F.transform("top", lambda x: x["n"])
    return found.select("lang", F.transform("top", lambda x: x["w"]).alias("common"), F.concat(own, F.array(F.col("n") - F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + x))).alias("prior"))


def _few(common: DataFrame) -> bool:
    """Whether what is held by language may be broadcast: so it is but for languages almost as many as documents."""
    size = common.agg(F.sum(500 + F.octet_length(F.array_join("common", "")))).first()[0]
    return (size or 0) <= MAX_BROADCAST_BYTES


def _with_language(rows: DataFrame, by_lang: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(by_lang) if few else by_lang, "lang", "left")


def document_features(docs: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, lang (of ``common``), the base counts and the two histograms (arrays of long)."""
    rows = _texts(docs).withColumn("words", F.array_remove(_words(F.col("text")), ""))
    rows = _with_language(rows, common.select("lang", "common"), _few(common))
    every = F.broadcast(common.where(F.col("lang") == ANY).select(F.col("common").alias("any_common")))  # one row
    rows = rows.join(every, F.lit(True), "left").withColumn("n", F.size("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    spaced = F.concat(F.lit(" "), F.lower(F.array_join("words", "  ")), F.lit(" "))
    list_ = F.coalesce("common", "any_common", F.array().cast("array<string>"))
    hits = _let(spaced, lambda s: F.transform(list_, lambda w: ((F.length(s) - F.length(F.replace(s, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.length(w) + 2)).cast("long")))
    runs = lambda c: (F.length("text") - F.length(F.regexp_replace("text", f"{c}+", ""))).cast("long")  # noqa: E731  few runs, many characters
    return rows.select(
        "doc_id", F.when(F.col("common").isNotNull(), F.col("lang")).otherwise(ANY).alias("lang"), F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.col("n")).alias("n_repeat_words"),
        F.array(*(runs(c) for c in CLASSES.values())).alias("chars"),
        hits.alias("common"),
    ).withColumn("n_symbols", F.col("chars")[list(CLASSES).index("symbol")]).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two histograms (arrays of double); 0 if either is empty or null."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0) / 2
    both = F.struct(total(p).alias("p"), total(q).alias("q"))
    shares = _let(both, lambda t: F.when((t["p"] > 0) & (t["q"] > 0), F.zip_with(p, q, lambda a, b: F.struct((a / t["p"]).alias("a"), (b / t["q"]).alias("b")))))
    return F.coalesce(F.aggregate(shares, F.lit(0.0), lambda s, x: s + part(x["a"], (x["a"] + x["b"]) / 2) + part(x["b"], (x["a"] + x["b"]) / 2)), F.lit(0.0))


def _total(a: Column) -> Column:
    return F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x)


def _with_prior(own: Column, prior: Column, weight: float) -> Column:
    """Counts on top of a prior's shares of a fixed weight; either may be null."""
    return F.transform(prior, lambda x, i: F.coalesce(F.get(own, i), F.lit(0.0)) + F.when(_total(prior) > 0, weight * x / _total(prior)).otherwise(0.0))


def judge(features: DataFrame, common: DataFrame) -> DataFrame:
    """``features`` with char_jsd, word_jsd and kept. The references are sums over all plain rows; one row a language of
    ``common``."""
    k = len(CLASSES)
    rest = F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda s, x: s + x)
    rows = features.withColumn("hits", F.concat(F.col("common"), F.array(rest)))
    plain = ~F.col("base_failed") & (20 * F.col("n_symbols") <= F.col("n_words")) & (5 * F.col("chars")[1] <= F.col("chars")[0])
    char_sums = F.array(*(F.sum(F.col("chars")[i]).cast("double") for i in range(k)))
    word_sums = F.array(*(F.coalesce(F.sum(F.get("hits", F.lit(i))), F.lit(0)).cast("double") for i in range(COMMON + 1)))
    own = rows.where(plain).groupBy("lang").agg(char_sums.alias("own_chars"), word_sums.alias("own_words"))
    every = rows.where(plain).agg(char_sums.alias("any_chars")).withColumn("any_chars", F.transform("any_chars", lambda x: F.coalesce(x, F.lit(0.0))))  # one row
    refs = common.select("lang", "prior").join(own, "lang", "left").crossJoin(F.broadcast(every))
    refs = refs.select("lang", _with_prior(F.col("own_chars"), F.col("any_chars"), PRIOR_CHARS).alias("ref_chars"), _with_prior(F.col("own_words"), F.col("prior"), PRIOR_WORDS).alias("ref_words"))
    rows = _with_language(rows, refs, _few(common))
    rows = rows.withColumn("total", F.aggregate("chars", F.lit(0).cast("long"), lambda s, x: s + x))
    chars, words = _jsd(F.col("chars").cast("array<double>"), F.col("ref_chars")), _jsd(F.col("hits").cast("array<double>"), F.col("ref_words"))
    rows = rows.withColumn("char_jsd", F.when(F.col("total") >= GUARD_CHARS, chars).otherwise(0.0)).withColumn("word_jsd", F.when(F.col("n_words") >= GUARD_WORDS, words).otherwise(0.0))
    limit = F.lit(MAX_CHAR_JSD) + F.lit(CHAR_NOISE) / F.greatest("total", F.lit(1))
    word_limit = F.lit(MAX_WORD_JSD) + F.lit(WORD_NOISE) / F.greatest("n_words", F.lit(1))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("char_jsd") <= limit) & (F.col("word_jsd") <= word_limit)).select(*features.columns, "char_jsd", "word_jsd", "kept")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, char_jsd, word_jsd. The texts are read twice, for the words of
    the languages and for the counts, which are written; the written rows hold no text."""
    spark = docs.sparkSession
    counts = cut(spark, word_counts(docs), "words")
    common = cut(spark, common_words(counts), "common")
    drop_cut(spark, counts)
    rows = judge(cut(spark, document_features(docs, common), "quality"), common)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_jsd", "word_jsd")
