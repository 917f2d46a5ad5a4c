"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans follow fixed formats and always stay. High-recall generators, each on its own, propose further spans, which
overlap one another: long runs with a digit, groups of digits, values given to a name, spelled-out addresses. Boosted
trees score them by two views kept apart: the labels of the training candidates come from evidence that the trees never
see (a valid base format at that place, or a name such as token or password that the value is given to), the features
from a candidate's own form and the characters around it. So the trees find what looks like the proven ones but lacks
the proof. As such ones count as unproven in the fit, a score is an understatement; how much so, a part of the
candidates tells that the trees were not fitted on: a generator's threshold is ``CONFIDENCE`` times the mean score of
its proven ones there (Elkan and Noto 2008), and ``LEAST_SCORE`` at least. Of overlapping
candidates the best scored stays. All candidates of all documents are learned from, three in four by the trees, the
others by the thresholds: candidates of one form are counted, their features put into bins at sixteenths of all values,
and each level of a tree takes sums over the counted bins, on the driver where these are few, else grouped ones over the
rows. Sums are of whole numbers, so that no order of rows changes a tree. The trees are compiled into CASE expressions: scoring is a lambda within the row, without a shuffle and
without Python.

Offsets are code points, ends exclusive. Matches are found by splitting: the lengths of what lies between them and
of themselves add up to their places, in blocks, so that many matches of one text take linear time. Patterns begin
where a run begins and never give back what they took, so long runs take linear time and no stack.

Defined results: a null text is empty and has no spans (``redact`` leaves it null); equal rows get equal results; of
overlapping added spans the best scored, then the leftmost, then the longest stays; no candidates, or of one label
only: nothing is added; an empty table gives no rows; other columns, of whatever names, are carried by
``redact`` and ignored by ``find``.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Boosting: rounds, depth, shrinkage. Thresholds; proven candidates that a generator's calibration needs.
ROUNDS, DEPTH, SHRINKAGE, CONFIDENCE, LEAST_SCORE, LEAST_PROVEN = 12, 3, 0.3, 0.9, 0.5, 5
#: Bins of a feature; what gradients and scores are multiplied by and rounded for sums; rows of counted bins up to which
#: the driver takes the sums.
BINS, SCALE, DRIVER_ROWS = 16, 1 << 24, 50_000
KINDS = ["email", "ip", "card", "phone"]
_SPANS = "array<struct<s:int,e:int,v:string>>"
#: Matches whose places are added up together.
BLOCK = 256
#: The generators: kind of the span, what tells that a text may have one, and the pattern.
GENERATORS = {
    "secret": (r"[0-9]", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+=*+"),
    "number": (r"[0-9][0-9()\x20./-]{5,}[0-9]", r"(?<![0-9])\(?[0-9]++(?:[)\x20./-]{1,2}+\(?[0-9]++)*+"),
    "value": (r"[=:]", r"(?<=[=:]|[=:]\x20|[=:][\"']|[=:]\x20[\"'])[^\s\"',;=:]{6,}+"),
    "email": (r"[\[(]at[\])]", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,}+"),
}
#: Names that a value is given to: evidence for labels only.
CUE = r"(?i)(token|key|secret|passw[a-z]*|pwd|auth|api|bearer|tel|phone|fax|mobile|card|iban|account|ssn)[a-z_]*\x20?[=:]\x20?[\"']?$"
FEATURES = ["length", "digit_share", "letter_share", "digits", "separators", "longest_run", "groups", "hex", "mixed", "distinct", "opened", "quoted", "after_word", "before_word"]


def _matches(text: Column, pattern: str) -> Column:
    """All leftmost matches with their places."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("p"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["p"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        own = F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("v")))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), s["out"]).otherwise(F.concat(s["out"], own)).alias("out"))

    def blocked(z: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(z, b * BLOCK + 1, BLOCK), zero, step))
        return F.element_at(F.transform(F.array(blocks), shifted), 1)

    def shifted(blocks: Column) -> Column:
        ends = F.aggregate(blocks, F.array(F.lit(0)), lambda s, b: F.concat(s, F.array(F.element_at(s, -1) + b["at"])))
        return F.flatten(F.zip_with(blocks, F.slice(ends, 1, F.size(blocks)), lambda b, at: F.transform(b["out"], lambda x: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e"), x["v"].alias("v")))))

    return F.when(F.size(found) <= BLOCK, F.aggregate(zipped, zero, step)["out"]).otherwise(F.element_at(F.transform(F.array(zipped), blocked), 1))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""

    def total(d: Column) -> Column:
        def at(i: Column) -> Column:
            x = F.try_element_at(F.split(d, ""), -i).cast("int")
            return F.when(i % 2 == 1, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + at(i)) % 10 == 0

    d = _digits(v)
    return F.when(F.length(d).between(12, 19), total(d)).otherwise(False)


def _guarded(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> list[Column]:
    """For each kind of KINDS, its valid spans (start, end, text) by start. A match begins where a run of its first
    characters does, or the match before ends; repetitions are possessive, as no shorter one could match more."""
    email = _guarded(F.instr(text, "@") > 0, _matches(text, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"))
    ip = _guarded(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _matches(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"))
    part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    small = lambda p: F.coalesce(F.try_to_number(F.right(F.concat(F.lit("000"), p), F.lit(3)), F.lit("999")).cast("int"), F.lit(999)) <= 255
    ip = F.filter(ip, lambda x: F.forall(F.split(x["v"], r"\."), lambda p: part(p) & small(p)))
    card = _guarded(text.rlike(r"(?:[0-9][\x20-]?){12}"), _matches(text, r"[0-9](?:[\x20-]?[0-9])++"))
    card = F.filter(card, lambda x: _luhn(x["v"]))
    phone = _guarded(text.rlike(r"\+[0-9]"), _matches(text, r"\+[0-9][\x20().0-9-]+[0-9]"))
    phone = F.filter(phone, lambda x: F.length(_digits(x["v"])).between(9, 15))
    return [email, ip, card, phone]


def _tagged(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def _with_base(docs: DataFrame) -> DataFrame:
    """doc (a struct of the columns of ``docs``), text, the base spans of each kind, base (all of them by start and kind)
    and found: the generators' candidates (s, e, v, g), by start."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns(dict(zip(KINDS, base_spans(F.col("text")), strict=True)))
    rows = rows.withColumn("base", F.array_sort(F.concat(*(_tagged(F.col(k), i, k) for i, k in enumerate(KINDS)))))
    named = lambda kind: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), F.lit(kind).alias("g"))
    found = [F.transform(_guarded(F.col("text").rlike(sign), _matches(F.col("text"), pattern)), named(kind)) for kind, (sign, pattern) in GENERATORS.items()]
    enough = lambda x: (x["g"] != "number") | (F.length(_digits(x["v"])) >= 7)
    return rows.withColumn("found", F.filter(F.array_sort(F.concat(*found)), enough))


def _features(text: Column, x: Column) -> list[Column]:
    """The form of a candidate and the characters next to it; nothing of what labels are made of."""
    v = x["v"]
    before, after = F.substring(text, F.greatest(x["s"], F.lit(1)), F.least(x["s"], F.lit(1))), F.substring(text, x["e"] + 1, F.lit(1))
    n, digits = F.length(v), F.length(_digits(v))
    letters = F.length(F.regexp_replace(v, "[^A-Za-z]", ""))
    runs = F.filter(F.split(v, "[^0-9]+"), lambda r: F.length(r) > 0)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        n.cast("double"), digits / n, letters / n, digits.cast("double"), (n - digits - letters).cast("double"),
        F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("double"), F.size(runs).cast("double"),
        flag(v.rlike("^[\"']?[0-9a-f]+$")), flag(v.rlike("[a-z]") & v.rlike("[A-Z]")), F.size(F.array_distinct(F.split(v, ""))).cast("double"),
        flag(v.rlike("^[\"'(]")), flag(before.isin("\"", "'") | after.isin("\"", "'")), flag(after.rlike(r"[\p{L}\p{N}]")), flag(before.rlike(r"[\p{L}\p{N}]")),
    ]


def _touches(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))


def _forms(docs: DataFrame) -> DataFrame:
    """f, g, held, n, p of the candidates of all documents: features, generator, whether they are left to the
    calibration, how many candidates there are of these and how many of them are proven."""
    rows = _with_base(docs.select("doc_id", "text"))
    rows = rows.select(F.col("doc.doc_id").alias("doc_id"), "text", "base", F.explode("found").alias("x"))
    before = F.substring(F.col("text"), F.greatest(F.col("x.s") - 31, F.lit(1)), F.least(F.col("x.s"), F.lit(32)))
    proven = _touches(F.col("x"), F.col("base")) | before.rlike(CUE)
    held = F.pmod(F.xxhash64("doc_id", "x.s", "x.g"), F.lit(4)) == 0
    rows = rows.select(F.array(*_features(F.col("text"), F.col("x"))).alias("f"), F.col("x.g").alias("g"), held.alias("held"), proven.cast("int").alias("y"))
    return rows.groupBy("f", "g", "held").agg(F.count("*").alias("n"), F.sum("y").alias("p"))


def _limits(fit: DataFrame, total: int) -> list[list[float]]:
    """For each feature its values at the sixteenths of the ``total`` candidates, each once, by size."""
    values = fit.select("n", F.posexplode("f").alias("j", "v")).groupBy("j", "v").agg(F.sum("n").alias("n"))
    values = values.withColumn("upto", F.sum("n").over(Window.partitionBy("j").orderBy("v")))
    met = F.expr(f"exists(sequence(0, {BINS - 1}), q -> ({total - 1} * bigint(q)) div {BINS} between upto - n and upto - 1)")
    out: list[list[float]] = [[] for _ in FEATURES]
    for r in values.where(met).select("j", "v").collect():  # BINS a feature
        out[r["j"]].append(r["v"])
    return [sorted(x) for x in out]


def _train(docs: DataFrame) -> tuple[list, dict[str, float]]:
    """(trees fitted on the candidates not held out, threshold of each generator from the others), of all documents. No
    trees if there is one label only; no threshold for a generator without enough proven ones. The driver has sums only."""
    spark = docs.sparkSession
    forms = cut(spark, _forms(docs), "pii-forms")
    fit = forms.where(~F.col("held"))
    n, p = fit.agg(F.sum("n"), F.sum("p")).first()
    if not n or p in (0, n):
        drop_cut(spark, forms)
        return [], {}
    limits = _limits(fit, n)
    cuts = F.array(*(F.array(*(F.lit(float(c)) for c in of)) for of in limits))
    bins = F.transform("f", lambda v, j: F.size(F.filter(F.get(cuts, j), lambda c: c < v)))
    binned = cut(spark, fit.select(bins.alias("bins"), "n", "p").groupBy("bins").agg(F.sum("n").alias("n"), F.sum("p").alias("p")), "pii-bins")

    if binned.count() <= DRIVER_ROWS:
        rows = binned.collect()
        trees = _grown(limits, _driver_sums([r["bins"] for r in rows], [r["n"] for r in rows], [r["p"] for r in rows]))
    else:
        trees = _grown(limits, _grouped_sums(binned))
    proven = forms.where(F.col("held") & (F.col("p") > 0)).select("g", "p", (F.col("p") * F.rint(_compiled(trees, F.col("f")) * SCALE).cast("long")).alias("s"))
    scores = proven.groupBy("g").agg(F.sum("p").alias("p"), F.sum("s").alias("s")).collect()  # a row a generator
    drop_cut(spark, binned)
    drop_cut(spark, forms)
    return trees, {r["g"]: max(LEAST_SCORE, CONFIDENCE * r["s"] / SCALE / r["p"]) for r in scores if r["p"] >= LEAST_PROVEN}


def _grouped_sums(binned: DataFrame) -> Callable:
    """``sums`` of ``_grown`` over a DataFrame: bins, n (candidates of these), p (proven ones of them)."""

    def sums(trees: list, splits: dict, least: int) -> dict:
        def node(i: int) -> Column:
            return F.when(F.col("bins")[splits[i][0]] <= splits[i][1], node(2 * i)).otherwise(node(2 * i + 1)) if i in splits else F.lit(i)

        rows = binned.select("bins", "n", "p", node(1).alias("node"), _compiled(trees, F.col("bins")).alias("q")).where(F.col("node") >= least)
        g, h = F.col("p") * SCALE - F.col("n") * F.rint(F.col("q") * SCALE).cast("long"), F.col("n") * F.rint(F.greatest(F.col("q") * (1 - F.col("q")), F.lit(1e-6)) * SCALE).cast("long")
        rows = rows.select("node", "n", g.alias("g"), h.alias("h"), F.posexplode("bins").alias("j", "b")).groupBy("node", "j", "b").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))
        out: dict = {}
        for r in rows.collect():  # at most 2 ** (DEPTH - 1) nodes of BINS + 1 bins a feature
            out.setdefault(r["node"], {}).setdefault(r["j"], {})[r["b"]] = (r["n"], r["g"], r["h"])
        return out

    return sums


def _driver_sums(bins: list, n: list, p: list) -> Callable:
    """``sums`` of ``_grown`` over rows on the driver, of the columns of ``_grouped_sums``."""
    b, count, proven = np.array(bins, np.int64), np.array(n, np.int64), np.array(p, np.int64)
    z, done = np.zeros(len(b)), 0

    def leaf(tree) -> np.ndarray:
        return np.where(b[:, tree[0]] <= tree[1], leaf(tree[2]), leaf(tree[3])) if isinstance(tree, tuple) else np.full(len(b), tree)

    def sums(trees: list, splits: dict, least: int) -> dict:
        nonlocal z, done

        def node(i: int) -> np.ndarray:
            return np.where(b[:, splits[i][0]] <= splits[i][1], node(2 * i), node(2 * i + 1)) if i in splits else np.full(len(b), i)

        for tree in trees[done:]:
            z, done = z + leaf(tree), done + 1
        q = 1 / (1 + np.exp(-z))
        rounded = lambda x: np.rint(x * SCALE).astype(np.int64)
        added = np.stack([count, proven * SCALE - count * rounded(q), count * rounded(np.maximum(q * (1 - q), 1e-6))], axis=1)
        at, out = node(1), {}
        for i in np.unique(at[at >= least]).tolist():
            on = at == i
            for f in range(b.shape[1]):
                table = np.zeros((BINS + 1, 3), np.int64)
                np.add.at(table, b[on, f], added[on])
                out.setdefault(i, {})[f] = {k: tuple(x) for k, x in enumerate(table.tolist()) if x[0]}
        return out

    return sums


def _grown(limits: list[list[float]], sums: Callable) -> list:
    """Boosted regression trees for the logistic loss. A tree is a leaf value or (feature, limit, low tree, high tree).
    ``sums(trees, splits, least)`` has, for each node from ``least`` on of the tree that ``splits`` begins (the root is 1,
    the nodes under i are 2 i and 2 i + 1), each feature and bin, the candidates and their sums of gradients and of second
    derivatives, times SCALE, after ``trees``, which are of bins."""
    trees: list = []
    for _ in range(ROUNDS):
        splits: dict[int, tuple[int, int]] = {}
        leaves: dict[int, float] = {}
        for depth in range(DEPTH):
            for node, of in sums(trees, splits, 2**depth).items():
                n, gs, hs = (sum(x[k] for x in of[0].values()) for k in range(3))
                gs, hs, best = gs / SCALE, hs / SCALE, (1e-3, None, None, None)
                leaves.setdefault(node, SHRINKAGE * gs / (hs + 1))
                for f, cuts in enumerate(limits):
                    low = gl = hl = 0
                    for k in range(len(cuts) - 1):
                        low, gl, hl = (a + b for a, b in zip((low, gl, hl), of[f].get(k, (0, 0, 0)), strict=True))
                        if n >= 10 and 5 <= low <= n - 5:
                            a, b = gl / SCALE, hl / SCALE
                            gain = a * a / (b + 1) + (gs - a) ** 2 / (hs - b + 1) - gs * gs / (hs + 1)
                            best = max(best, (gain, f, k, (a, b)), key=lambda t: t[0])
                if best[1] is not None:
                    splits[node], (a, b) = best[1:3], best[3]
                    leaves[2 * node], leaves[2 * node + 1] = SHRINKAGE * a / (b + 1), SHRINKAGE * (gs - a) / (hs - b + 1)

        def built(i: int):
            return (*splits[i], built(2 * i), built(2 * i + 1)) if i in splits else leaves[i]

        trees.append(built(1))

    def valued(tree):
        return (tree[0], limits[tree[0]][tree[1]], valued(tree[2]), valued(tree[3])) if isinstance(tree, tuple) else tree

    return [valued(t) for t in trees]


def boost(x: list[list[float]], y: list[int]) -> list:
    """The trees of plain rows on the driver, of features and labels: what ``_train`` does over DataFrames."""
    limits = [sorted({sorted(col)[(len(col) - 1) * q // BINS] for q in range(BINS)}) for col in zip(*x, strict=True)]
    bins = [[bisect_left(of, v) for of, v in zip(limits, row, strict=True)] for row in x]
    return _grown(limits, _driver_sums(bins, [1] * len(y), y))


def _leaf(tree, row: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _score(trees: list, row: list[float]) -> float:
    return 1 / (1 + math.exp(-sum(_leaf(t, row) for t in trees)))


def _compiled(trees: list, f: Column) -> Column:
    def case(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(f[tree[0]] <= float(tree[1]), case(tree[2])).otherwise(case(tree[3]))

    total = sum((case(t) for t in trees), F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def _with_spans(docs: DataFrame) -> DataFrame:
    """``_with_base`` with spans: (s, k, e, kind) by start and kind, base and added."""
    trees, thresholds = _train(docs)
    rows = _with_base(docs)
    if not thresholds:
        return rows.withColumn("spans", F.col("base"))
    text = F.col("text")
    score = lambda x: F.element_at(F.transform(F.array(F.array(*_features(text, x))), lambda f: _compiled(trees, f)), 1)
    free = F.filter("found", lambda x: ~_touches(x, F.col("base")))
    scored = F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["g"].alias("g"), score(x).alias("p")))
    limits = F.create_map(*(F.lit(v) for g, t in thresholds.items() for v in (g, float(t))))
    enough = lambda x: x["p"] >= F.coalesce(F.try_element_at(limits, x["g"]), F.lit(2.0))
    scored = F.array_sort(F.filter(scored, enough), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["e"] - a["e"]))
    none = F.slice(scored, 1, 0)

    def step(out: Column, x: Column) -> Column:
        alone = (F.size(out) == 0) | (F.try_element_at(out, F.lit(-1))["e"] <= x["s"])
        better = F.try_element_at(out, F.lit(-1))["p"] < x["p"]
        return F.when(alone, F.concat(out, F.array(x))).when(better, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(x))).otherwise(out)

    picked = F.aggregate(scored, none, step)
    kind = lambda x: F.when(x["g"] == "value", F.lit("secret")).otherwise(x["g"])
    added = F.transform(picked, lambda x: F.struct(x["s"].alias("s"), F.lit(4).alias("k"), x["e"].alias("e"), kind(x).alias("kind")))
    return rows.withColumn("spans", F.when(F.size("found") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base")))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (all spans, base and added)."""
    rows = _with_spans(docs.select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc.doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span's text as its kind in brackets; n_chars, where there is one, is counted anew."""
    rows = _with_spans(docs)
    text = F.col("text")

    def step(s: Column, x: Column) -> Column:
        piece = F.concat(F.substring(text, s["at"] + 1, x["s"] - s["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.struct(F.greatest(s["at"], x["e"]).alias("at"), F.when(x["s"] >= s["at"], F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("spans", zero, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    new = F.when(F.size("spans") > 0, done).otherwise(F.col("doc.text").cast("string"))
    columns = {c: F.col("doc").getField(c) for c in docs.columns} | {"text": new}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.coalesce(F.length(new).cast(docs.schema["n_chars"].dataType), columns["n_chars"])
    return rows.select(*(c.alias(name) for name, c in columns.items()))
