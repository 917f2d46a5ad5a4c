"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from verlog.llm import bpe, decontaminate, html_extract, ngram_join, pii, quality_rules, separator_scan, suffix_dedup, token_files, toxicity
from verlog.llm.queries import PATTERN, RANKS, WORD_BPE

random.seed(11)
VOCAB = ["the", "of", "Alpha", "beta,", "gämma", "δ", "x9", "4111", "漢字"]
PASSAGE = " ".join(f"shared{i}" for i in range(40))


def prose(n):
    return " ".join(random.choice(VOCAB) + str(random.randint(0, 400)) for _ in range(n))


BASE = prose(120)
TEXTS = [None, "", " \n\t", "one two", "one two", BASE, BASE, BASE.replace("x9", "y9", 1), prose(60) + " " + PASSAGE, PASSAGE + " " + prose(60), prose(3000), "ab" * 400, "For For " * 200, prose(5) + " a.b@c.de +1 (234) 555-1234"]
SCHEMA = "doc_id long, text string, lang string, n long, h string, key long, place int, kind string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, random.choice(["en", None]), 1, "h", 2, 3, "k") for i, t in enumerate(TEXTS)] + [(5, BASE, "en", 1, "h", 2, 3, "k"), (None, BASE, "en", 1, "h", 2, 3, "k")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_bpe(docs, empty):
    ranks = bpe.load_ranks(RANKS)
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.encode_documents(docs, RANKS, PATTERN))
    for i, t in enumerate(TEXTS):
        ids = lib.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(empty, RANKS, PATTERN).count() == 0
    encoder = bpe.Encoder(ranks, PATTERN)
    for _ in range(300):
        s = "".join(random.choice("ab 'stLL\n\t\x1c\x85\xa0é漢😀١²Ⅷ_-́ 12") for _ in range(random.randint(0, 200)))
        assert np.frombuffer(encoder.encode(s), "<u4").tolist() == lib.encode_ordinary(s)


def test_bpe_by_higher_order_functions(spark):
    ranks = bpe.load_ranks(RANKS)
    words = ["a", "the", " tokenisation", "gämma", "漢字", "4111", "zzqxj", "😀"]
    got = bpe.fold_words(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()
    assert {r["word"]: [ranks[bytes(p)] for p in r["pieces"]] for r in got} == {w: bpe.merge_word(w.encode(), ranks) for w in words}


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD_BPE)
    lib.encode_special_tokens = True
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    for kind in ("dictionary", "delta"):
        path = str(tmp_path / kind)
        token_files.write_token_files(known, WORD_BPE, path, encoding=kind)
        got, at = by_id(token_files.token_digest(spark, path)), 0
        for i, t in enumerate(TEXTS):
            ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
            assert tuple(got[i])[1:] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
        assert {tuple(r) for r in token_files.document_index(spark, path).select("doc_id", "start").collect()} == {(i, r["start"]) for i, r in got.items()}
    token_files.write_token_files(empty, WORD_BPE, str(tmp_path / "none"))
    assert token_files.token_digest(spark, str(tmp_path / "none")).count() == 0


def test_token_files_words():
    """Each piece of a text is encoded once, whatever its capitals and the punctuation behind it, and as the library does."""
    import pyarrow as pa
    from tokenizers import Tokenizer, normalizers

    lib = Tokenizer.from_file(WORD_BPE)
    lib.encode_special_tokens = True
    encoder = token_files.WordEncoder(lib)

    def same(texts):
        n, ids = encoder.encode_column(pa.array(texts, pa.string()), 1)
        want = [[*lib.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert n.tolist() == list(map(len, want))
        assert ids.tolist() == [i for w in want for i in w]

    same(["Tree, tree;  TREE. très&&& tree", "", "\n", "treE,"])
    assert set(encoder) - {b""} == {b"tree", b",", b";", b".", b"tr\xc3\xa8s", b"&&&"}
    same(["H\u0331 h\u0331, É, é, e\u0301. ×, ÷; İ. Σ, ς ª, µ; ß! ÿ? à\xa0b, x\u0300y"])  # capitals that compose, letters that are none
    same(["a" * 60 + ", b" + "." * 8 + " b" + "." * 9 + " " + "!" * 30 + " #,a,# it's, 's. 12, <|ENDOFTEXT|>,"])
    atoms = [*"abAHeéÉß×\xadà漢１²12.,!?:;#$%&*|'^~` \n\t\x1c\x85\xa0\u3000", "\u0331", "\u0301", "'s", "The", "ing"]
    for _ in range(60):
        some = random.sample(atoms, random.randint(2, len(atoms)))
        same(["".join(random.choices(some, k=random.randint(0, 30))) for _ in range(30)])
    lib.normalizer = normalizers.NFC()  # other parts: capitals stay
    encoder = token_files.WordEncoder(lib)
    same(["Tree, tree;  TREE. Très&&& tree", ""])


def test_separator_scan(spark, docs, tmp_path):
    path = str(tmp_path / "flat")
    separator_scan.write_flat_files(docs, RANKS, PATTERN, path, end_id=50256, files_rows=4)
    want = sorted(r["n_tokens"] for r in bpe.encode_documents(docs, RANKS, PATTERN).collect())
    for block in (7, 1 << 20):
        got = separator_scan.count_documents(spark, path, end_id=50256, block_ids=block).collect()
        assert sorted(r["n_tokens"] for r in got) == want
        assert all(r["complete"] for r in got)
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.bin").write_bytes(np.array([1, 2, 9, 9, 3], "<u2").tobytes())
    got = separator_scan.count_documents(spark, str(tmp_path / "cut"), end_id=9, block_ids=2).orderBy("doc_no").collect()
    assert [(r["start"], r["n_tokens"], r["complete"]) for r in got] == [(0, 2, True), (3, 0, True), (4, 1, False)]


def sets_of(texts):
    out = []
    for t in texts:
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if x]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def components(texts):
    s, root = sets_of(texts), list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(s):
            for j, b in enumerate(s):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return [len(x) for x in s], root


def test_ngram_join(spark, docs, empty, monkeypatch):
    got = by_id(ngram_join.near_duplicate_components(docs))
    n, root = components(TEXTS)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(TEXTS))] == list(zip(n, root, strict=True))
    assert ngram_join.near_duplicate_components(empty).count() == 0
    # large groups, their bands and bitmaps
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    words = [f"w{i}" for i in range(60)]
    many = [" ".join(words[: 60 - k % 20] + [f"own{k}x{j}" for j in range(k % 9)]) for k in range(60)]
    got = by_id(ngram_join.near_duplicate_components(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")))
    n, root = components(many)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(60)] == list(zip(n, root, strict=True))
    # the full comparison alone, without the forests
    monkeypatch.setattr(ngram_join, "_forest_pairs", lambda members, sets: spark.createDataFrame([], "a long, b long"))
    got = by_id(ngram_join.near_duplicate_components(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(60)] == list(zip(n, root, strict=True))
    monkeypatch.undo()
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns


def test_ngram_join_null_and_repeated_ids(spark):
    near = BASE + " one more"
    rows = [(None, prose(40)) for _ in range(5)] + [(7, prose(40)) for _ in range(3)] + [(None, BASE), (None, near), (9, near), (7, near + " two"), (8, prose(30)), (None, None), (None, ""), (8, "")]
    data = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = ngram_join.keep_one_of_each(data)
    assert kept.columns == ["doc_id", "text"]
    want = rows[:8] + [(7, near + " two")] + rows[12:]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))
    # links of a text that only null ids hold
    got = ngram_join.near_duplicate_components(spark.createDataFrame([(None, BASE), (3, near), (2, near + " two")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, 2), (3, 2), (2, 2)}
    only = spark.createDataFrame([(None, BASE), (None, near), (None, prose(40))], "doc_id long, text string")
    assert ngram_join.keep_one_of_each(only).count() == 2


def check_repeats(got, texts):
    seen: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        hit, new = bytearray(len(raw)), []
        for k in range(len(raw) - 49):
            if seen.get(raw[k : k + 50], i) < i:
                hit[k : k + 50] = b"\1" * 50
            new.append(raw[k : k + 50])
        for x in new:
            seen.setdefault(x, i)
        kept = bytes(b for b, c in zip(raw, hit, strict=True) if not c)
        assert bytes(got[i]["kept"]) == kept
        assert got[i]["n_spans"] == len(re.findall(rb"\x01+", bytes(hit)))


def test_suffix_dedup(docs, empty):
    check_repeats(by_id(suffix_dedup.remove_repeats(docs, texts=True)), TEXTS)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_shared_buckets(spark):
    """Passages that differ by a byte just before, within or after a shared q-gram, NUL bytes, and texts of one letter."""
    rng = random.Random(4)
    base = "".join(rng.choice("ab") for _ in range(90))
    changed = [base[:k] + "c" + base[k + 1 :] for k in range(0, 90, 3)]
    cuts = [base[rng.randrange(40) : 50 + rng.randrange(40)] for _ in range(15)]
    rest = ["a" * 49, "a" * 50, "a" * 51, "a" * 120, "\0" * 60, base + "\0" * 30, "\0" * 30 + base, "\0" * 55, base * 2, "é" * 40, "é" * 26]
    texts = changed + cuts + rest
    rng.shuffle(texts)
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    check_repeats(by_id(suffix_dedup.remove_repeats(data, texts=True)), texts)


def test_decontamination(spark, docs, empty, monkeypatch):
    random.seed(3)
    for _ in range(300):
        items = [(str(k % 6), [random.choice([b"a", b"b", b"c"]) for _ in range(random.randint(0, 9))]) for k in range(random.randint(0, 8))]
        words = [random.choice([b"a", b"b", b"c", b"d"]) for _ in range(random.randint(0, 30))]
        spans, found = decontaminate.SuffixAutomaton(items, 3).scan(words)
        hit, want = set(), set()
        for name, it in items:
            m = min(3, len(it))
            for i in range(len(words) - m + 1):
                if m and any(words[i : i + m] == it[j : j + m] for j in range(len(it) - m + 1)):
                    hit |= set(range(i, i + m))
                    want.add(name)
        assert ({x for a, b in spans for x in range(a, b)}, found) == (hit, want)
    bench = spark.createDataFrame([(1, PASSAGE.upper()), (2, None), (None, "one two")], "item_id long, text string")
    got = by_id(decontaminate.find_contamination(docs, bench))
    assert [i for i in got if got[i]["contaminated"]] and got[8]["n_hit"] == 40 and got[3]["n_hit"] == 2 and got[0]["n_words"] == 0
    cleaned = by_id(decontaminate.clean_documents(docs, bench))
    assert PASSAGE not in cleaned[8]["text"] and cleaned[5]["text"] == BASE and cleaned[0]["text"] is None and 3 not in cleaned
    # several automata, one after another, and columns of the names that are used within
    odd = docs.withColumn("spans", F.lit("mine")).withColumn("__text", F.lit("too"))
    monkeypatch.setattr(decontaminate, "MAX_ITEM_WORDS", 2)
    assert by_id(decontaminate.find_contamination(docs, bench)) == got
    again = by_id(decontaminate.clean_documents(odd, bench))
    assert {i: r["text"] for i, r in again.items()} == {i: r["text"] for i, r in cleaned.items()} and again[5]["spans"] == "mine"
    monkeypatch.undo()
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.find_contamination(docs, bench.limit(0)).collect())


def test_toxicity(spark, docs, empty):
    rows = [(i, prose(30) + (" worthless scoundrel" if i % 4 == 0 else ""), "en") for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(150)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.score_documents(train, labels))
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in range(200))
    find = toxicity.Trie({"scoundrel": 2.0}).find
    assert all(find(w) for w in ("scoundrel", "scoundel", "scoundreel", "scoundrol", "xscoundrel", "scuondrel", "sc0undrel")) and not find("scundrol")
    assert {r["score"] for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(empty, labels).count() == 0
    assert toxicity.keep_clean(docs, labels.limit(0)).columns == docs.columns
    long = prose(40_000)
    more = [(900, "you w0rthless scuondrel"), (901, "w.o.r.t.h.l.e.s.s scoundr3l"), (902, "worthles scoundreel!"), (903, long), (904, "WORTHLESS, scoundrel " + long)]
    more = spark.createDataFrame([(i, t, "en") for i, t in more], train.schema)
    got = by_id(toxicity.score_documents(train.unionByName(more), labels))
    assert [got[i]["predicted"] for i in range(900, 904)] == [1, 1, 1, 0] and got[904]["score"] > got[903]["score"]


def edits(a, b):
    """Optimal string alignment distance."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_toxicity_automaton_against_edit_distance():
    rng = random.Random(5)
    word = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randint(a, b)))
    for _ in range(60):
        terms = {word(5, 8): rng.uniform(1, 1.6) for _ in range(6)}
        trie = toxicity.Trie(terms)
        for _ in range(200):
            w = word(3, 9)
            near = {t for t in terms if edits(w, t) <= 1}
            got = trie.find(w)
            assert (got is None) == (not near) and (got is None or got[0] in near and got[1] == (w not in terms))


def test_quality(docs, empty):
    got = by_id(quality_rules.quality(docs))
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)} if len(w) < 700 else None
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)))
        if twice is not None:
            assert r["n_repeat_words"] == len(twice)
            assert r["base_failed"] == (len(w) < 50 or 100 * len(twice) > 50 * len(w))
    assert quality_rules.quality(empty).count() == 0


def test_quality_verdicts_against_brute_force(spark):
    """Divergences and verdicts of a small corpus, with every step done plainly."""
    import regex

    rng = random.Random(8)
    lists = {"en": "the of and to in is it for on with".split(), "xx": "ba bo bi bu".split(), None: "zz yy xx".split()}
    text = lambda lang, n: " ".join(rng.choice(lists[lang]) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = [(i, text(lang := rng.choice(["en", "en", "en", None]), rng.randint(60, 200)), lang) for i in range(60)]
    rows += [(60, text("xx", 120), "xx"), (61, " ".join("".join(rng.choice("QXZ#%$0123") for _ in range(7)) for _ in range(120)), "en"), (62, text("xx", 150), "en"), (63, None, "en"), (64, "kurz", "en"), (65, rows[0][1], rows[0][2])]
    got = by_id(quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)))
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, _ in rows}
    count = {}
    for i, _, lang in rows:
        for w in words[i]:
            if regex.search(r"\p{L}", w):
                of = count.setdefault(lang or "", {})
                of[w.lower()] = of.get(w.lower(), 0) + 1
    common = {lang: sorted(of, key=lambda w: (-of[w], w))[: quality_rules.COMMON] for lang, of in count.items()}
    prior = {lang: [*(count[lang][w] for w in ws), sum(count[lang].values()) - sum(count[lang][w] for w in ws)] for lang, ws in common.items()}
    regexes = [regex.compile(c.replace("[\\p{L}&&[^a-z\\p{Lu}]]", "[\\p{L}--[a-z\\p{Lu}]]").replace("[\\p{P}&&[^.,#*%&]]", "[\\p{P}--[.,#*%&]]"), regex.V1) for c in quality_rules.CLASSES.values()]
    chars = {i: [len(x.findall(t or "")) for x in regexes] for i, t, _ in rows}
    hits = {i: [*(h := [sum(w.lower() == c for w in words[i]) for c in common[lang or ""]]), len(words[i]) - sum(h)] for i, _, lang in rows}
    plain = [i for i, _, _ in rows if not got[i]["base_failed"] and 20 * chars[i][5] <= len(words[i]) and 5 * chars[i][1] <= chars[i][0]]
    add = lambda rows_, n: [sum(r[k] for r in rows_) for k in range(n)]
    lang_of = {i: lang or "" for i, _, lang in rows}
    every = add([chars[i] for i in plain], 7)

    def jsd(p, q):
        p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
        m = (p + q) / 2
        return sum(float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum()) / 2 for x in (p, q))

    for i, t, _ in rows:
        lang, n, total = lang_of[i], len(words[i]), sum(chars[i])
        own = [k for k in plain if lang_of[k] == lang]
        ref_chars = [a + quality_rules.PRIOR_CHARS * b / sum(every) for a, b in zip(add([chars[k] for k in own], 7), every, strict=True)]
        ref_words = [a + quality_rules.PRIOR_WORDS * b / sum(prior[lang]) for a, b in zip(add([hits[k] for k in own], len(prior[lang])), prior[lang], strict=True)]
        c = jsd(chars[i], ref_chars) if total >= quality_rules.GUARD_CHARS else 0.0
        w = jsd(hits[i], ref_words) if n >= quality_rules.GUARD_WORDS else 0.0
        assert abs(got[i]["char_jsd"] - c) < 1e-9 and abs(got[i]["word_jsd"] - w) < 1e-9
        assert got[i]["kept"] == (not got[i]["base_failed"] and c <= quality_rules.MAX_CHAR_JSD + quality_rules.CHAR_NOISE / max(total, 1) and w <= quality_rules.MAX_WORD_JSD + quality_rules.WORD_NOISE / max(n, 1))
    assert got[60]["kept"] and not got[61]["kept"] and not got[62]["kept"]


def test_quality_common_words_of_all_documents(spark, monkeypatch):
    """Every document counts for its language's words, however many there are, and every language has words of its own."""
    n = 6_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('Alpha beta 12 ', if(id % 2 = 0, 'gamma', 'w' || id)) as text", "'en' as lang")
    alone = spark.createDataFrame([(n + i, f"  only{i} only{i} 7\n", f"l{i}") for i in range(40)] + [(None, "beta", "en"), (n + 99, "7 8", "none"), (n + 98, None, None)], "doc_id long, text string, lang string")
    got = {r["lang"]: r for r in quality_rules.common_words(quality_rules.word_counts(docs.unionByName(alone).repartition(5))).collect()}
    assert got["en"]["common"][:3] == ["beta", "alpha", "gamma"] and list(got["en"]["prior"][:3]) == [n + 1, n, n // 2]
    assert len(got["en"]["common"]) == quality_rules.COMMON and sum(got["en"]["prior"]) == 3 * n + 1
    assert all((list(got[f"l{i}"]["common"]), list(got[f"l{i}"]["prior"])) == ([f"only{i}"], [2, 0]) for i in range(40))
    assert set(got) == {"en", quality_rules.ANY, *(f"l{i}" for i in range(40))} and sum(got[quality_rules.ANY]["prior"]) == 3 * n + 81
    rows = sorted(map(tuple, quality_rules.quality(alone).select("n_words", "kept", "word_jsd", "char_jsd").collect()))
    monkeypatch.setattr(quality_rules, "MAX_BROADCAST_BYTES", 0)  # too many languages to broadcast
    assert rows == sorted(map(tuple, quality_rules.quality(alone).select("n_words", "kept", "word_jsd", "char_jsd").collect()))


def test_pii(docs, empty):
    text = TEXTS[-1]
    got = by_id(pii.find(docs))
    mail, phone = text.index("a.b@c.de"), text.index("+1 (")
    base = f"email:{mail}:{mail + 8},phone:{phone}:{phone + 17}"
    assert got[13]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert (got[13]["n_email"], got[13]["n_phone"], got[0]["n_ip"]) == (1, 1, 0)
    cleaned = by_id(pii.redact(docs))
    assert cleaned[13]["text"].endswith("[email] [phone]") and cleaned[0]["text"] is None and cleaned[5]["text"] == BASE
    assert pii.find(empty).count() == 0
    trees = pii.boost([[float(i % 2), float(i)] for i in range(60)], [i % 2 for i in range(60)])
    assert all((pii._score(trees, [float(i % 2), float(i)]) > 0.5) == bool(i % 2) for i in range(60))


def base_of(text):
    """Base spans by plain regular expressions and checks."""
    def luhn(v):
        d = [int(c) for c in re.sub("[^0-9]", "", v)][::-1]
        return 12 <= len(d) <= 19 and (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
    ]
    return sorted((m.start(), k, m.end(), kind) for k, (kind, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, text) if good(m[0]))


def test_pii_base_against_brute_force(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 120))) for chars in ("a.@-1_ ", "0123456789 -", "0125.", "+0123456789 ().-", "a@b.c_%+1é😀\n") for _ in range(150)]
    texts += [part * n for part in ("a", "1", "1.", "+1", "4111111111111111 ", "x@y.z ", "a@b.") for n in (1, 700)]
    got = by_id(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)))
    for i, t in enumerate(texts):
        base = base_of(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base).encode()).hexdigest(), t[:200]
        spans = [x.split(":") for x in got[i]["spans"].split(",") if x]
        assert {f"{k}:{a}:{b}" for a, _, b, k in base} <= {":".join(x) for x in spans} and got[i]["n_spans"] == len(spans)
    # megabytes of one run: linear, and whole (the plain expressions above would be quadratic)
    huge = ["a" * 300_000 + "@b.c", "1" * 300_000, "1." * 100_000, "+1" * 100_000, "+" + "(" * 300_000, "x@y.z " * 50_000, "é" * 500_000 + "me@a.b"]
    got = by_id(pii.find(spark.createDataFrame(list(enumerate(huge)), "doc_id long, text string").repartition(7)))
    assert [tuple(got[i][f"n_{k}"] for k in pii.KINDS) for i in range(7)] == [(1, 0, 0, 0), (0, 0, 0, 0), (0, 25_000, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (50_000, 0, 0, 0), (1, 0, 0, 0)]


def test_pii_added_spans(spark):
    """Tokens without a name, like those that are named elsewhere, are found; the evidence of a label is no feature."""
    rng = random.Random(4)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f"{prose(30)} token = \"{secret()}\" {prose(5)}") for i in range(300)] + [(i, f"{prose(30)} see section-{i}-of-the-report/{i} {prose(5)}") for i in range(300, 600)]
    bare = [secret() for _ in range(100)]
    rows += [(1000 + i, f"{prose(30)} (\"{x}\") {prose(5)}") for i, x in enumerate(bare)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, base int")
    cleaned = by_id(pii.redact(docs))
    assert sum(x not in cleaned[1000 + i]["text"] for i, x in enumerate(bare)) >= 90
    clean = [(i, t) for i, t in rows[300:600] if not base_of(t)]
    assert len(clean) > 200 and sum(cleaned[i]["text"] == t for i, t in clean) >= 0.99 * len(clean)
    assert docs.columns == list(cleaned[0].asDict()) and cleaned[0]["spans"] == "x" and cleaned[0]["base"] == 1


def test_pii_learns_from_all_candidates(spark, monkeypatch):
    """Trees and thresholds over DataFrames are those of plain rows, of every candidate of every document, in any order."""
    rng = random.Random(12)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(16, 44)))
    texts = [rng.choice([f"token={secret()} a", f"see part-{i}-of-the-report/{i}", f"({secret()})", f"x={i * 7919}ab, y", f"call +1 {i * 7919 % 10**9 + 10**9} now"]) for i in range(4_800)]
    rows = [(i % 4_790 if i % 900 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    forms = pii._forms(docs.repartition(5)).collect()
    found = sum(len(r["found"]) for r in pii._with_base(docs).select("found").collect())
    assert sum(r["n"] for r in forms) == found > 4_500 and 0 < sum(r["p"] for r in forms) < found
    fit = [(list(r["f"]), int(k < r["p"])) for r in forms if not r["held"] for k in range(r["n"])]
    trees, thresholds = pii._train(docs.repartition(3))
    monkeypatch.setattr(pii, "DRIVER_ROWS", 0)  # too many for the driver
    monkeypatch.setattr(pii, "ROUNDS", 3)
    grouped, _ = pii._train(docs.repartition(2))
    monkeypatch.undo()
    want = pii.boost([x for x, _ in fit], [y for _, y in fit])

    def same(a, b):
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3]) if isinstance(a, tuple) and isinstance(b, tuple) else abs(a - b) < 1e-6

    assert len(trees) == len(want) == pii.ROUNDS and all(same(a, b) for a, b in zip(trees, want, strict=True))
    assert len(grouped) == 3 and all(same(a, b) for a, b in zip(grouped, want, strict=False))
    scores = {}
    for r in forms:
        if r["held"]:
            scores.setdefault(r["g"], []).extend([pii._score(want, list(r["f"]))] * r["p"])
    limits = {g: max(pii.LEAST_SCORE, pii.CONFIDENCE * sum(s) / len(s)) for g, s in scores.items() if len(s) >= pii.LEAST_PROVEN}
    assert limits and limits.keys() == thresholds.keys() and all(abs(limits[g] - thresholds[g]) < 1e-6 for g in limits)


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a href='x'>Menu</a></nav><div class='tip'>Same tip</div><article><h1>H {0} &amp; x</h1><p>one  {0}<p>two<br>{0} <b>b</b><div class='comments'><p>bad</p></div></article><footer>f</footer></body>"
    rows = [(i, f"http://A.example/{i}", page.replace("{0}", f"n{i}")) for i in range(6)] + [(6, None, None), (7, "", ""), (8, "x", "plain  text"), (9, "http://b/", "<p>a<script>if (1<2) x</script><!-- c --><p>b &lt;3"), (9, "http://b/", "<p>a")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got if r["page_id"] != 9}
    assert all(text[i] == f"H n{i} & x\n\none n{i}\n\ntwo n{i} b" for i in range(6))
    assert (text[6], text[7], text[8]) == ("", "", "plain text")
    assert sorted(r["text"] for r in got if r["page_id"] == 9) == ["a", "a\n\nb <3"]
    tip = [(i, "http://c/", f"<body><div class='x'>Always here</div><p>own {i}</p></body>") for i in range(8)]
    assert {r["text"] for r in html_extract.extract_pages(spark.createDataFrame(tip, "page_id long, url string, html string")).collect()} == {f"own {i}" for i in range(8)}


def texts_of(spark, pages, host="http://h/"):
    rows = html_extract.extract_pages(spark.createDataFrame([(i, host, p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)).collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["page_id"])]


def test_html_parser():
    text = lambda page: html_extract.extract(page, None)
    assert text('<div style="overflow: hidden"><p>Body') == "Body"
    assert text('<article><h1 class="article-header">T</h1><p aria-hidden="false">a<p title="a hidden truth">b<div data-id="social">c</div></article>') == "T\n\na\n\nb\n\nc"
    assert text("<p>a < b and 3<4 <a href=\"x>y\" title='q\"'>link</a> it's</p><p hidden>no</p><div id=cookie-notice>no</div>") == "a < b and 3<4 link it's"
    # deep, long and broken pages take linear time and lose no text
    deep = text("<div>" * 10_000 + "deep <b>x</b> y" + "</div>tail" * 10_000)
    assert deep == "deep x y" + "\n\ntail" * 10_000
    assert text("<div hidden>" * 300 + "no" + "</div>" * 300 + "yes") == "yes" and text("<b>" * 10_000 + "z") == "z"
    for page in ("<a " * 50_000, '<a "' * 50_000, "<p><div>" * 20_000 + "</span>" * 20_000, "<!-" * 50_000):
        tree = html_extract._bare(html_extract.view(html_extract.parse(page)))
        html_extract.merge(html_extract._as_wrapper(tree), html_extract._as_wrapper(tree))


def test_tree_matching_against_brute_force():
    rng = random.Random(2)

    def tree(depth):
        return [rng.choice("ab"), [], [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []]

    def size(a, b):
        """Largest match of two trees of one label: every order-keeping choice of children, equal lists place by place."""
        if [x[0] for x in a[2]] == [x[0] for x in b[2]]:
            return 1 + sum(map(size, a[2], b[2]))

        def best(i, j):
            if i == len(a[2]) or j == len(b[2]):
                return 0
            both = size(a[2][i], b[2][j]) + best(i + 1, j + 1) if a[2][i][0] == b[2][j][0] else 0
            return max(both, best(i + 1, j), best(i, j + 1))

        return 1 + best(0, 0)

    for _ in range(200):
        a, b = tree(3), tree(3)
        if a[0] == b[0]:
            pairs = html_extract._align(a[2], b[2], {})
            assert pairs == sorted(pairs) and all(a[2][i][0] == b[2][j][0] for i, j, _ in pairs)
            assert html_extract._size(a, b, {}) == size(a, b) == 1 + sum(s for *_, s in pairs)


def test_html_edges(spark):
    schema = "page_id long, url string, html string, host string, text string, wrapper string"
    assert html_extract.extract_pages(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "http://h/", "<p>a", "x", "y", "z"), (None, None, "<div>" * 2000 + "b", "x", None, "z"), (1, "http://h/", "<p>a", "x", "y", "z")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == [("1", "a", 1), ("1", "a", 1), ("None", "b", 1)]


def test_html_wrapper_decides(spark):
    # a constant advert among an article's paragraphs, and main text outside of the only article
    page = "<body><article><h1>H{0}</h1><p>own {0} first</p><p>Read our other offers</p><p>own {0} last <span>Advert</span></p></article></body>"
    assert texts_of(spark, [page.replace("{0}", f"n{i}") for i in range(8)]) == [f"Hn{i}\n\nown n{i} first\n\nown n{i} last" for i in range(8)]
    page = "<body><div><p>the main text {0} of this page</p></div><article><p>teaser {0}</p></article></body>"
    assert texts_of(spark, [page.replace("{0}", f"n{i}") for i in range(8)]) == [f"the main text n{i} of this page\n\nteaser n{i}" for i in range(8)]


def test_html_copies(spark):
    page = "<body><div class='x'>Always here</div><div class='y'>own text of page {0}</div><div class='z'>{1}</div></body>"
    # exact copies are most of a host's pages
    got = texts_of(spark, [page.format(0, "")] * 12 + [page.format(i, "") for i in range(1, 7)])
    assert got == ["own text of page 0"] * 12 + [f"own text of page {i}" for i in range(1, 7)]
    # near copies are: one body, and menus and endings of their own
    body = " ".join(f"word{k}" for k in range(60))
    near = [f"<body><nav>menu {i}</nav><div class='y'>{body}</div><div class='z'>end {i}</div></body>" for i in range(12)]
    assert texts_of(spark, near + [page.format(i, f"end {i}") for i in range(20, 26)])[:12] == [f"{body}\n\nend {i}" for i in range(12)]


def test_html_long_flat_pages(spark):
    # template behind more than 48 runs of siblings, and a text that most pages share after copies of others
    flat = lambda i: "<body>" + "".join(f"<h3>t {i} {k}</h3><p>u {i} {k}</p>" for k in range(40 + i % 3)) + "<div>Template end</div></body>"
    got = texts_of(spark, [flat(i) for i in range(9)])
    assert all("Template" not in t and t.count("t ") == 40 + i % 3 for i, t in enumerate(got))
    twice = [f"<body><div>old {i // 2}</div><p>own {i} text of a page</p></body>" for i in range(12)]
    hot = [f"<body><div>Hot notice</div><p>own {i} text of a page</p></body>" for i in range(12, 60)]
    assert texts_of(spark, twice + hot)[12:] == [f"own {i} text of a page" for i in range(12, 60)]
    # no majority text is lost while pages are folded, in whatever order
    for order in (1, -1):
        trees = ([["#", [f"a{i // 2}"], []] for i in range(90)] + [["#", ["hot"], []] for _ in range(110)])[::order]
        w = html_extract._as_wrapper(trees[0])
        for t in trees[1:]:
            html_extract.merge(w, html_extract._as_wrapper(t))
        assert w[2]["hot"][0] == 110 and len(w[2]) < 60
    a = [["abc"[i * i % 3], []] for i in range(100)]
    pairs = html_extract._align_long(a, a[:30] + a[60:])
    assert len(pairs) == 70 and all(a[i][0] == (a[:30] + a[60:])[j][0] for i, j in pairs)


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "pii", "byte_bpe"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() <= 200
    assert public_tokenizers.PATTERN == PATTERN and out.where(F.col("n_tokens") < 0).count() == 0


def test_pipeline_rows(spark, tmp_path):
    """The rows of a run on a small fixture against brute force: near copies by pairs, passages by search, ids by the library."""
    import corpus_pipeline

    passage = " ".join(f"bench{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(30))
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "ijklmnop"]
    texts = [" ".join(random.choice(words) for _ in range(60)) for _ in range(12)]
    texts += [texts[0], texts[1] + " ending", passage, "", ""]
    d = tmp_path / "small"
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    _, root = components(texts)
    want = set()
    for i, t in enumerate(texts):
        if root[i] == i and passage not in t:
            ids = lib.encode_ordinary(t)
            want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(d)).collect()]
    assert len(got) == len(want) == 14 and set(got) == want


def test_pipeline_learns_personal_data_from_every_row(spark):
    """Named tokens in rows without a doc_id count for the stage's trees and thresholds as all others do."""
    import corpus_pipeline

    rng = random.Random(6)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(None, f"{prose(30)} token = \"{secret()}\" {prose(5)}") for _ in range(200)] + [(None, f"{prose(30)} see section-{i}-of-the-report/{i} {prose(5)}") for i in range(200)]
    bare = [secret() for _ in range(50)]
    docs = spark.createDataFrame(rows + [(i, f"{prose(30)} (\"{x}\") {prose(5)}") for i, x in enumerate(bare)], "doc_id long, text string")
    cleaned = by_id(corpus_pipeline.redact_personal_data(spark, docs, ""))
    assert sum(x not in cleaned[i]["text"] for i, x in enumerate(bare)) >= 45


def test_pipeline_learns_toxicity_from_every_label(spark, tmp_path):
    """More than 20,000 labelled rows; the toxic ones are those of the largest hashes, which a sample of the smallest left out."""
    import corpus_pipeline

    ids = spark.range(30_000).orderBy(F.xxhash64("id"))
    ids = [r["id"] for r in ids.collect()]
    toxic = set(ids[-800:])
    rows = [(i, f"a kind word of {i % 97} people" + (" you worthless scoundrel" if i in toxic else ""), "en") for i in ids]
    docs = spark.createDataFrame([*rows, (None, "a worthless scoundrel", "en")], "doc_id long, text string, lang string")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in ids], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in left.collect()} == set(ids) - toxic


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """Training rows against a plain join, also where ids share bits; sums of tasks and of the driver are the same numbers."""
    rng = random.Random(3)
    rows = [(rng.choice([None, rng.randint(0, 9_000)]) if i % 50 == 0 else i, f"text {i}") for i in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    known = {rng.randint(-50, 9_000): rng.randint(0, 1) for _ in range(4_000)}
    want = sorted((i, t, known[i]) for i, t in rows if i in known)
    lab = spark.createDataFrame(list(known.items()), "doc_id long, toxic int")
    passed = toxicity._maybe_labelled(docs, lab)
    assert passed.columns == docs.columns and len(want) < passed.count() < 0.75 * len(rows)
    for most in (toxicity.MAX_BITS, 1):
        monkeypatch.setattr(toxicity, "MAX_BITS", most)
        assert sorted(map(tuple, toxicity._train_rows(docs.repartition(3), lab).collect())) == want

    x = [[rng.choice([0.0, rng.uniform(0, 3)]) for _ in range(toxicity.N_FEATURES)] for _ in range(700)]
    y = [int(sum(v) + rng.gauss(0, 2) > 6) for v in x]
    n = [rng.choice([1, 1, 3, 40_000]) for _ in x]
    counted = spark.createDataFrame(list(zip(x, y, n, strict=True)), "f array<double>, toxic int, n long").repartition(5)
    beta = toxicity._fit(toxicity._driver_sums(counted.collect()))
    assert beta.tolist() == toxicity._fit(toxicity._task_sums(counted.repartition(3))).tolist()
    full, t, w = np.hstack([np.array(x), np.ones((len(x), 1))]), np.array(y, float), np.array(n, float)
    slope = full.T @ (w * (t - 1 / (1 + np.exp(-full @ beta)))) - np.append(beta[:-1], 1e-6 * beta[-1])
    assert np.abs(slope).max() < 1e-3 and np.abs(beta).max() > 0.5  # the ridged likelihood is flat there
    docs = spark.createDataFrame([(i, prose(20) + (" worthless scoundrel" if i % 3 == 0 else "")) for i in range(300)], "doc_id long, text string")
    lab = docs.select("doc_id", F.expr("int(doc_id % 3 = 0)").alias("toxic"))
    monkeypatch.undo()
    few = toxicity.learn(docs, lab, F.lit(True))
    monkeypatch.setattr(toxicity, "DRIVER_ROWS", 0)
    many = toxicity.learn(docs.repartition(7), lab, F.lit(True))
    assert few[0] == many[0] and few[1].tolist() == many[1].tolist()
