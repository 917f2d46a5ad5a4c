"""Main text of web pages by wrapper induction.

The DOM trees of a host's pages are aligned by simple tree matching (the largest order-keeping match of children,
recursively, of equal labels; a run of siblings of one label is one node). The aligned tree is the host's wrapper:
per node the pages that have it and the fingerprints of its elements' texts. Elements whose text stays the same from
page to page are template, inside of an article too; slots that vary are content, but for elements which are never
article text. Emphasis and links within running text that varies are part of their sentence and not judged apart.

Every page takes part, each distinct body of a host once: pages whose longest blocks, of ``BODY_SHARE`` of their text,
are the same are one body, so copies and near copies do not turn their text into template. Each task folds bodies into
one tree per host, trees of a host are merged as a stream, by lossy counting, which loses no text that a large part of
a node's bodies share; a second pass counts what is left exactly. Pages then meet their wrapper in a join.

Defined results: a null or empty page gives ''; a page without a tag is one block of text; a null url is a host of
its own ('' as all urls without one); elements below ``MAX_DEPTH`` stand side by side there, with all their text, so a
tree of any depth is walked; a tag that never ends is text; a host of few bodies has no constant nodes, so the element rules alone decide
(the article and main elements, where there are any); repeated rows each give their row; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

#: Hosts that a task holds at once; child lists of more pairs than this are aligned in numpy.
MAX_HOSTS, LONG_CELLS = 2000, 4096
#: Part of a node's pages that a fingerprint or child may have and yet not be kept while pages are folded.
LOSSY = 16
#: From so many distinct page bodies on a node can be constant: if one text has this share of them.
MIN_PAGES, CONSTANT_SHARE = 4, 0.5
#: Levels of a tree; deeper elements are laid flat, as browsers do.
MAX_DEPTH = 120
#: Part of a page's text by which its body is known.
BODY_SHARE = 0.8
# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select option button".split())
DROPPED = RAW | frozenset("head nav footer aside form dialog menu audio video canvas label fieldset".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
FORMAT, WHOLE = frozenset("b i em strong u a code".split()), frozenset("# html body main article".split())
BLOCK_BUT_P = BLOCK - {"p"}
CLOSES_P = BLOCK | frozenset("nav footer aside form menu".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar aside footer header masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist reply replies respond discussion disqus widget widgets toolbar pager pagination copyright legal disclaimer skip".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that name the head of the page, but of an article's own title inside of one.
HEADS = frozenset("header masthead".split())
# Each part of a tag starts with a character of its own, so no text is tried twice; a < that could start a tag ends it.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|<(?![a-zA-Z/!?])|\"[^\"]*+\"|'[^']*+'|[\"'](?=[^\"'<>]*+>))*+)>", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'<>]++)))?+|\"[^\"]*+\"|'[^']*+'")
_NAME = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("tag", "label", "kids", "dropped", "verdict", "print")

    def __init__(self, tag: str, label: str, dropped: bool):
        self.tag, self.label, self.kids, self.dropped, self.verdict, self.print = tag, label, [], dropped, False, ""


def _attributes(raw: str) -> dict[str, str]:
    """Names (first of each) with values; what stands within a value is no name."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        if m[1]:
            out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


class _Tree:
    """The open elements while a page is read. Nodes deeper than ``MAX_DEPTH`` are children of the one there: an inline
    one is part of its parent, and what follows a closed one stands in a second node of its parent."""

    def __init__(self):
        self.root = Node("#", "#", False)
        self.open: list[tuple[str, Node]] = [("#", self.root)]
        self.count: dict[str, int] = {}

    def add(self, tag: str, node: Node, stays: bool) -> None:
        deep = len(self.open) > MAX_DEPTH
        parent = self.open[-1][1]
        if deep:
            node.dropped |= parent.dropped
            if stays and node.tag not in BLOCK and node.dropped == parent.dropped:
                node = parent
            else:
                self.open[MAX_DEPTH - 1][1].kids.append(node)
                if not stays:
                    self._continue(len(self.open) - 1)
        else:
            parent.kids.append(node)
        if stays:
            self.open.append((tag, node))
            self.count[tag] = self.count.get(tag, 0) + 1

    def _continue(self, at: int) -> None:
        """Later text of an open deep element stands behind what has just been closed."""
        tag, old = self.open[at]
        if at >= MAX_DEPTH:
            node = Node(old.tag, old.label, old.dropped)
            self.open[MAX_DEPTH - 1][1].kids.append(node)
            self.open[at] = tag, node

    def close(self, depth: int) -> None:
        """Close the open element at ``depth`` and all within."""
        if depth:
            last, above = self.open[-1][1], self.open[depth - 1][1]
            for tag, _ in self.open[depth:]:
                self.count[tag] -= 1
            del self.open[depth:]
            if last is not above:
                self._continue(len(self.open) - 1)

    def within(self, *tags: str) -> bool:
        return any(self.count.get(t) for t in tags)

    def find(self, tags: tuple[str, ...], stop) -> int:
        """Depth of the innermost open element of ``tags``, 0 if there is none before one of ``stop``."""
        if self.within(*tags):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] in tags:
                    return k
                if self.open[k][0] in stop:
                    break
        return 0


def parse(page: str) -> Node:
    """A tolerant tree: unclosed elements end with their parent, p and li end at the next of their kind."""
    tree, at = _Tree(), 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            tree.open[-1][1].kids.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                tree.open[-1][1].kids.append(html.escape(m[0][9:-3]))
            continue
        tag = m[2].lower()
        if m[1]:
            tree.close(tree.find((tag,), () if tag in BLOCK else BLOCK_BUT_P))
            continue
        if tag in CLOSES_P:
            tree.close(tree.find(("p",), BLOCK_BUT_P))
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            tree.close(tree.find((tag,), ("ul", "ol", "dl", "table")))
        attrs = _attributes(m[3]) if m[3].strip(" /") else {}
        names = [w.lower() for w in _NAME.findall(" ".join(attrs.get(k, "") for k in ("class", "id", "role")))] if attrs else []
        inside = tree.within("article", "main")
        words = WORDS.intersection(names) if tag not in ("html", "body", "article", "main") and not (inside and tag in HEADINGS) else ()
        if inside and words:
            words = words - HEADS
        node = Node(tag, f"{tag}.{'.'.join(sorted(names))}" if names else tag, tag in DROPPED or "hidden" in attrs or bool(words) or tag == "header" and not inside)
        raw = tag in RAW and not m[3].endswith("/")
        tree.add(tag, node, not raw and tag not in VOID and not m[3].endswith("/"))
        if raw:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
    if at < len(page):
        tree.open[-1][1].kids.append(page[at:])
    return tree.root


def _own_text(node: Node) -> str:
    """The text of an element but for dropped ones in it; its fingerprint is noted, '' without any."""
    text = "" if node.dropped else "".join([k if isinstance(k, str) else _own_text(k) for k in node.kids])
    kept = text.strip()
    node.print = f"{zlib.crc32(kept.encode('utf-8', 'replace')):x}-{len(kept):x}" if kept else ""
    return text


def view(root: Node) -> list:
    """[label, fingerprint of each element, elements, children] of a page; a run of siblings of one label is one node."""
    _own_text(root)
    return _view(root.label, [root])


def _view(label: str, nodes: list[Node]) -> list:
    runs: list[tuple[str, list[Node]]] = []
    for node in nodes:
        if not node.dropped:
            for k in node.kids:
                if not isinstance(k, str):
                    if runs and runs[-1][0] == k.label:
                        runs[-1][1].append(k)
                    else:
                        runs.append((k.label, [k]))
    return [label, [n.print for n in nodes], nodes, [_view(*r) for r in runs]]


def _bare(v: list) -> list:
    """[label, distinct fingerprints, children]: what of a view is counted."""
    return [v[0], sorted({p for p in v[1] if p}), [_bare(k) for k in v[3]]]


def body_print(root: Node) -> int:
    """One number for pages of the same body: a hash of the longest blocks that hold ``BODY_SHARE`` of the page's text
    outside of dropped elements. Copies share it whatever their menus, footers and short blocks are."""
    blocks: list[list[str]] = [[]]
    _blocks(root, blocks)
    texts = sorted((t for b in blocks if (t := " ".join("".join(b).split()))), key=lambda t: (-len(t), t))
    left, taken = BODY_SHARE * sum(map(len, texts)), []
    for t in texts:
        if left <= 0:
            break
        left -= len(t)
        taken.append(t)
    return xxhash.xxh3_64_intdigest("\n\n".join(sorted(taken)).encode("utf-8", "replace")) - (1 << 63)


def _size(a: list, b: list, memo: dict) -> int:
    """Nodes in the largest match of two trees of one label."""
    if (key := (id(a), id(b))) not in memo:
        memo[key] = 1 + sum(s for _, _, s in _align(a[-1], b[-1], memo))
    return memo[key]


def _align(a: list[list], b: list[list], memo: dict) -> list[tuple[int, int, int]]:
    """Simple tree matching of two child lists: places that match, and their sizes. Lists of equal labels match place by
    place, others by the largest order-keeping match."""
    if len(a) == len(b) and all(x[0] == y[0] for x, y in zip(a, b, strict=True)):
        return [(i, i, _size(x, y, memo)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    if len(a) * len(b) > LONG_CELLS:
        return [(i, j, _size(a[i], b[j], memo)) for i, j in _align_long(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + _size(a[i], b[j], memo) if a[i][0] == b[j][0] else 0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i][0] == b[j][0] and best[i][j] == best[i + 1][j + 1] + (s := _size(a[i], b[j], memo)):
            out.append((i, j, s))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def _align_long(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """The largest order-keeping match of two long child lists, row by row in numpy and halved as by Hirschberg, so
    memory is linear; a pair weighs the smaller of its trees."""
    labels = {x: i for i, x in enumerate({x[0] for x in (*a, *b)})}
    la, lb = (np.array([labels[x[0]] for x in xs]) for xs in (a, b))
    wa, wb = (np.array([_nodes(x) for x in xs]) for xs in (a, b))

    def scores(la: np.ndarray, wa: np.ndarray, lb: np.ndarray, wb: np.ndarray) -> np.ndarray:
        """Of all of ``a`` with each prefix of ``b``."""
        row = np.zeros(len(lb) + 1, np.int64)
        for label, w in zip(la, wa, strict=True):
            row[1:] = np.maximum(row[1:], np.where(lb == label, row[:-1] + np.minimum(w, wb), 0))
            np.maximum.accumulate(row, out=row)
        return row

    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        if i == k or j == m:
            continue
        if k - i == 1:
            fit = np.where(lb[j:m] == la[i], np.minimum(wa[i], wb[j:m]), 0)
            if fit.any():
                out.append((i, j + int(fit.argmax())))
            continue
        half = (i + k) // 2
        at = j + int((scores(la[i:half], wa[i:half], lb[j:m], wb[j:m]) + scores(la[half:k][::-1], wa[half:k][::-1], lb[j:m][::-1], wb[j:m][::-1])[::-1]).argmax())
        todo += [(i, half, j, at), (half, k, at, m)]
    return sorted(out)


def _nodes(x: list) -> int:
    return 1 + sum(map(_nodes, x[-1]))


def _as_wrapper(t: list) -> list:
    """[label, pages, fingerprint -> [pages, pages it may have missed], pages missed, children] of a bare tree."""
    return [t[0], 1, {p: [1, 0] for p in t[1]}, 0, [_as_wrapper(k) for k in t[2]]]


def merge(a: list, b: list, memo: dict | None = None) -> None:
    """Fold the wrapper ``b`` into the wrapper ``a`` of the same label.

    Lossy counting (Manku and Motwani 2002): a fingerprint or child goes only when its pages and the pages that it may
    have missed are together at most a ``LOSSY``-th of the node's; its place among its siblings does not matter."""
    memo = {} if memo is None else memo
    before, other = a[1] // LOSSY, b[1] // LOSSY
    a[1] += b[1]
    least = a[1] // LOSSY
    if other:
        for p, c in a[2].items():
            if p not in b[2]:
                c[1] += other
    for p, (n, missed) in b[2].items():
        if p in a[2]:
            a[2][p][0] += n
            a[2][p][1] += missed
        else:
            a[2][p] = [n, missed + before]
    matched = {j: i for i, j, _ in _align(a[4], b[4], memo)}
    both = set(matched.values())
    for i, k in enumerate(a[4]):
        if other and i not in both:
            k[3] += other
    kids, done = [], 0
    for j, k in enumerate(b[4]):
        if j in matched:
            kids += a[4][done : matched[j] + 1]
            done = matched[j] + 1
            at = a[4][matched[j]]
            merge(at, k, memo)
            at[3] += k[3]
        else:
            k[3] += before
            kids.append(k)
    kids += a[4][done:]
    if least > before:
        a[2] = {p: c for p, c in a[2].items() if sum(c) > least}
        kids = [k for k in kids if k[1] + k[3] > least]
    a[4] = kids


def _told(w: list, at: list[int]) -> list:
    """[label, number of the node, fingerprints to be counted, children]."""
    at[0] += 1
    return [w[0], at[0] - 1, sorted(w[2]) if w[1] >= MIN_PAGES else [], [_told(k, at) for k in w[4]]]


def _tally(w: list, t: list, host: str, counts: dict, memo: dict) -> None:
    """Count a page for each node of its host's wrapper that it has, and for the node's fingerprints."""
    counts[host, w[1], None] = counts.get((host, w[1], None), 0) + 1
    for p in set(t[1]).intersection(w[2]):
        counts[host, w[1], p] = counts.get((host, w[1], p), 0) + 1
    for i, j, _ in _align(w[-1], t[-1], memo):
        _tally(w[-1][i], t[-1][j], host, counts, memo)


def _judge(w: list, v: list, constant: dict[int, set], memo: dict) -> None:
    """Mark the elements of a page that the wrapper finds constant."""
    same = constant.get(w[1], ())
    for p, node in zip(v[1], v[2], strict=True):
        node.verdict = p in same
    if not all(n.verdict for n in v[2]):
        running = any(isinstance(k, str) and k.strip() for n in v[2] if n.tag not in WHOLE for k in n.kids)
        for i, j, _ in _align(w[-1], v[-1], memo):
            if not (running and v[-1][j][2][0].tag in FORMAT):
                _judge(w[-1][i], v[-1][j], constant, memo)


def _blocks(node: Node, blocks: list[list[str]]) -> None:
    for k in node.kids:
        if isinstance(k, str):
            blocks[-1].append(k)
        elif k.dropped or k.verdict:
            if k.tag in CLOSES_P:
                blocks.append([])
        elif k.tag == "br":
            blocks[-1].append(" ")
        elif k.tag in BLOCK:
            blocks.append([])
            _blocks(k, blocks)
            blocks.append([])
        else:
            _blocks(k, blocks)


def _mains(node: Node, out: list[Node]) -> None:
    for k in node.kids:
        if not isinstance(k, str) and not k.dropped:
            if k.tag in ("article", "main"):
                out.append(k)
            else:
                _mains(k, out)


def extract(page: str, wrapper: tuple[list, dict[int, set], int] | None) -> str:
    """The varying slots of a page; with too few pages for a wrapper, its article or main elements if it has any."""
    root = parse(page)
    mains: list[Node] = []
    if wrapper is not None and wrapper[2] >= MIN_PAGES:
        _judge(wrapper[0], view(root), wrapper[1], {})
        root.verdict = False
    else:
        _mains(root, mains)
    blocks: list[list[str]] = [[]]
    for m in mains or [root]:
        _blocks(m, blocks)
        blocks.append([])
    text = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return "\n\n".join(t for t in text if t)


def page_bodies(pages: DataFrame) -> DataFrame:
    """host, tree (JSON): one row for each distinct body of a host's pages."""

    def trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            out = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if page:
                    root = parse(page)
                    row = host, body_print(root), json.dumps(_bare(view(root)), separators=(",", ":"))
                    key = host, row[1], hash(row[2])
                    if key not in seen:  # only saves work: what is not caught here is below
                        if len(seen) > 100_000:
                            seen.clear()
                        seen.add(key)
                        out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["host", "body", "tree"])

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep = []
            for key in zip(batch.column("host").to_pylist(), batch.column("body").to_pylist(), strict=True):
                keep.append(key != last)
                last = key
            yield batch.filter(pa.array(keep, pa.bool_())).select(["host", "tree"])

    rows = _hosts(pages).select("host", "html").mapInArrow(trees, "host string, body bigint, tree string")
    return rows.repartition("host", "body").sortWithinPartitions("host", "body", "tree").mapInArrow(first, "host string, tree string")


def induce(bodies: DataFrame) -> DataFrame:
    """host, wrapper (JSON): one row a host, from all its bodies."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list] = {}
        for batch in batches:
            for host, tree in zip(batch.column("host").to_pylist(), batch.column("tree").to_pylist(), strict=True):
                w = _as_wrapper(json.loads(tree))
                if host in by:
                    merge(by[host], w)
                else:
                    by[host] = w
                if len(by) >= MAX_HOSTS:
                    yield told(by)
                    by = {}
        if by:
            yield told(by)

    def told(by: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array([json.dumps(w) for w in by.values()], pa.string())], ["host", "wrapper"])

    def unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, w = None, None
        for batch in batches:
            for h, x in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                x = json.loads(x)
                if h == host:
                    merge(w, x)
                else:
                    if host is not None:
                        yield told({host: _told(w, [0])})
                    host, w = h, x
        if host is not None:
            yield told({host: _told(w, [0])})

    parts = bodies.mapInArrow(fold, "host string, wrapper string")
    return parts.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(unite, "host string, wrapper string")


def _joined(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    return rows.join(F.broadcast(wrappers) if small(wrappers, 64) and size <= 32 << 20 else wrappers, "host", "left")


def judged(bodies: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, wrapper, bodies, constant: exact counts of all bodies say which fingerprints of a node are constant."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        counts: dict[tuple, int] = {}
        for batch in batches:
            for host, tree, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "tree", "wrapper")), strict=True):
                if host not in known:
                    if len(known) >= MAX_HOSTS:
                        known.clear()
                    known[host] = json.loads(wrapper)
                _tally(known[host], json.loads(tree), host, counts, {})
                if len(counts) > 200_000:
                    yield told(counts)
                    counts = {}
        yield told(counts)

    def told(counts: dict[tuple, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in counts], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))), pa.array(list(counts.values()), pa.int64())], ["host", "node", "print", "c"])

    rows = _joined(bodies, wrappers).select("host", "tree", "wrapper").mapInArrow(count, "host string, node int, print string, c bigint")
    rows = rows.groupBy("host", "node", "print").agg(F.sum("c").alias("c"))
    rows = rows.withColumn("n", F.max(F.when(F.col("print").isNull(), F.col("c"))).over(Window.partitionBy("host", "node")))
    same = (F.col("print").isNotNull()) & (F.col("n") >= MIN_PAGES) & (F.col("c") >= CONSTANT_SHARE * F.col("n"))
    told_ = rows.groupBy("host").agg(F.max(F.when(F.col("node") == 0, F.col("n"))).alias("bodies"), F.collect_list(F.when(same, F.concat_ws(" ", "node", "print"))).alias("constant"))
    return wrappers.join(told_, "host")


def _hosts(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    spark = pages.sparkSession
    bodies = cut(spark, page_bodies(pages), "bodies")
    wrappers = cut(spark, judged(bodies, cut(spark, induce(bodies), "wrappers")), "judged")
    rows = _joined(_hosts(pages), wrappers).select("page_id", "url", "html", "host", "wrapper", "bodies", "constant")

    def load(wrapper: str, bodies: int, constant: list[str]) -> tuple[list, dict[int, set], int]:
        by: dict[int, set] = {}
        for x in constant:
            node, p = x.split(" ")
            by.setdefault(int(node), set()).add(p)
        return json.loads(wrapper), by, bodies

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            told = [batch.column(c) for c in ("wrapper", "bodies", "constant")]
            for i, (page, host) in enumerate(zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True)):
                if host not in known and told[0][i].is_valid:
                    if len(known) >= MAX_HOSTS:
                        known.clear()
                    known[host] = load(*(c[i].as_py() for c in told))
                texts.append(extract(page, known.get(host)) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
