"""HTML extraction: gradient-boosted trees over DOM-node features, and hierarchical decoding.

Pages are parsed into nodes. Each node is described by the size and density of its subtree, its links,
its attributes' tokens, its depth, and how it compares with its siblings and its parent. Trees boosted
on logistic loss give each node the log-odds of being content. A dynamic programme over the tree then
chooses: a subtree is kept whole, dropped whole, or its node left open, that is each child decided by
itself and the node's own text by its own odds; so nothing is kept in a dropped subtree nor dropped in
a kept one, and the choice has the greatest total log-odds.

There are no labelled pages. The model is fitted on pages whose markup tells: nodes within ``article``
or ``main`` are content, the body's other nodes aren't. Those tags, and ``nav``, ``header``,
``footer`` and ``aside``, are hidden from the features, so that what is learnt carries over to pages
without them.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import renamed, slices, strings, tidied

#: Pages used for fitting, at most, and nodes of each of them, at most, evenly spread over the page.
TRAIN_PAGES = 400
TRAIN_NODES_A_PAGE = 2_000
TREES = 40
DEPTH = 4
RATE = 0.25
BINS = 32
LEAST_LEAF = 20
RIDGE = 1.0
#: Cost, in log-odds, of deciding a node's children one by one.
OPEN_COST = 0.5
ATTRIBUTE_BUCKETS = 16

EXTRACTED = "page_id long, text string, n_nodes long, n_kept long"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s>/]*)[^>]*(?:>|\Z)"
    r"|<(?P<tag>[a-zA-Z][^\s>/]*)(?P<attrs>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|(?=<)|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"[a-zA-Z0-9]+")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "cite", "code", "em", "font", "i", "kbd", "label", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "var"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SIBLING_CLOSE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_IN_HEAD = {"meta", "link", "base", "title"}
_HIDDEN = {"article", "main", "nav", "header", "footer", "aside", "section"}
_CONTENT, _OTHER = {"article", "main"}, {"nav", "header", "footer", "aside"}
_KINDS = {t: i for i, t in enumerate(["p", "div", "li", "a", "ul", "ol", "table", "td", "tr", "form", "h1", "h2", "h3", "b", "span", "pre", "blockquote", "img", "br", "input", "button"])}


class Page:
    """A parsed page: nodes in document order, and the texts with the node each stands in."""

    def __init__(self, source: str):
        self.tag, self.parent, self.end, self.depth, self.attrs = ["#"], [-1], [0], [0], [""]
        self.texts: list[tuple[int, str]] = []
        self.open = [0]
        self.named: dict[str, list[int]] = {}  # of each tag, the places in ``open`` where it stands
        self.solid: list[int] = []  # the places in ``open`` of all that isn't inline
        head = False
        for m in _TOKEN.finditer(source):
            kind = m.lastgroup
            if kind == "text":
                if not head:
                    text = entities.unescape(m["text"])
                    if text.strip():
                        self.texts.append((self.open[-1], text))
                    elif text and self.texts:
                        self.texts.append((self.open[-1], " "))
            elif m["end"]:
                name = m["end"].lower()
                if name in ("head", "title"):
                    head = False
                if self.named.get(name):
                    self._close(self.named[name][-1])
            elif m["tag"]:
                name = m["tag"].lower()
                if name == "head":
                    head = True
                    continue
                if name == "title" and (head or not self.texts):
                    head = True
                    continue
                if head and name in _IN_HEAD:
                    continue
                head = False
                if name in _CLOSES_P:
                    self._close_nearest({"p"})
                if name in _SIBLING_CLOSE:
                    self._close_nearest(_SIBLING_CLOSE[name])
                node = len(self.tag)
                self.tag.append(name)
                self.parent.append(self.open[-1])
                self.depth.append(len(self.open))
                self.attrs.append(m["attrs"])
                self.end.append(node + 1)
                if name not in _VOID and not m["attrs"].endswith("/"):
                    self.named.setdefault(name, []).append(len(self.open))
                    if name not in _INLINE:
                        self.solid.append(len(self.open))
                    self.open.append(node)
        self._close(1)
        self.end[0] = len(self.tag)
        del self.open, self.named, self.solid

    def _close(self, i: int) -> None:
        """Ends the open nodes from place ``i`` on."""
        while len(self.open) > i:
            node = self.open.pop()
            self.end[node] = len(self.tag)
            self.named[self.tag[node]].pop()
            if self.solid and self.solid[-1] == len(self.open):
                self.solid.pop()

    def _close_nearest(self, names: set[str]) -> None:
        """Ends the nearest open node of these names, past inline nodes and a table's cells and rows only."""
        for i in reversed(self.solid):
            name = self.tag[self.open[i]]
            if name in names:
                self._close(i)
                return
            if name not in ("td", "th", "tr"):
                return


def describe(pages: list[Page]) -> np.ndarray:
    """The features of all nodes of these pages, page after page."""
    sizes = np.array([len(p.tag) for p in pages])
    base = np.concatenate([[0], np.cumsum(sizes)])
    n = int(base[-1])
    parent = np.concatenate([np.maximum(p.parent, 0) + b for p, b in zip(pages, base, strict=False)])
    end = np.concatenate([np.array(p.end) + b for p, b in zip(pages, base, strict=False)])
    depth = np.concatenate([p.depth for p in pages])
    first = np.repeat(base[:-1], sizes)
    index = np.arange(n)
    tags = [t for p in pages for t in p.tag]
    kind = np.array([-1 if t in _HIDDEN else _KINDS.get(t, len(_KINDS)) for t in tags])
    own = np.zeros((n, 5))  # characters, words, signs, capitals, digits
    for p, b in zip(pages, base, strict=False):
        for node, text in p.texts:
            own[b + node] += (len(text), text.count(" ") + 1, sum(map(text.count, ".,;:!?")), sum(map(str.isupper, text)), sum(map(str.isdigit, text)))
    link = kind == _KINDS["a"]
    in_link = np.zeros(n, bool)
    at = np.flatnonzero(link)
    mark = np.zeros(n + 1, int)
    np.add.at(mark, at, 1)
    np.add.at(mark, end[at], -1)
    in_link = np.cumsum(mark)[:n] > 0

    def below(x: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(x, dtype=float)])
        return run[end] - run[index]

    chars, n_words, signs, capitals, digits = (below(own[:, i]) for i in range(5))
    linked, count = below(own[:, 0] * in_link), (end - index).astype(float)
    n_links, paragraphs = below(link), below(kind == _KINDS["p"])
    children = np.bincount(parent[1:], minlength=n).astype(float) if n > 1 else np.zeros(n)
    density, link_share = chars / count, linked / np.maximum(chars, 1)
    order = np.lexsort((index, parent))
    place = np.zeros(n)
    starts = np.flatnonzero(np.concatenate([[True], parent[order][1:] != parent[order][:-1]]))
    place[order] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    siblings = np.maximum(1, children[parent])
    same = np.unique(parent * 64 + kind + 1, return_inverse=True, return_counts=True)
    before, after = np.zeros(n), np.zeros(n)
    beside = parent[order][1:] == parent[order][:-1]
    before[order[1:][beside]] = chars[order[:-1][beside]]
    after[order[:-1][beside]] = chars[order[1:][beside]]
    buckets = np.zeros((n, ATTRIBUTE_BUCKETS))
    n_tokens = np.zeros(n)
    for i, a in enumerate(x for p in pages for x in p.attrs):
        if a:
            found = _ATTRIBUTE.findall(a.lower())
            n_tokens[i] = len(found)
            for t in found:
                if t not in ("href", "class", "id"):
                    buckets[i, xxhash.xxh32_intdigest(t) % ATTRIBUTE_BUCKETS] += 1
    links_in_attributes = buckets * ~link[:, None]  # a link's target is a text of its own
    log = np.log1p
    return np.column_stack(
        [
            depth, kind, log(chars), log(own[:, 0]), link_share, log(count), log(density), log(n_words), chars / np.maximum(n_words, 1),
            signs / np.maximum(chars, 1), capitals / np.maximum(chars, 1), digits / np.maximum(chars, 1), log(n_links), log(paragraphs),
            log(children), log(place), place / siblings, log(siblings), same[2][same[1]] / siblings, log(before), log(after),
            chars / np.maximum(1, chars[parent] / siblings), log(chars[parent]), link_share[parent], log(density[parent]), kind[parent],
            (index - first) / np.maximum(1, np.repeat(sizes, sizes)), chars / np.maximum(1, chars[first]), log(n_tokens), links_in_attributes,
        ]
    ).astype(np.float32)


class Trees:
    """Boosted regression trees on logistic loss, all of the same depth, over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH):
        self.depth = depth
        quantiles = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0) if len(x) else np.zeros((BINS - 1, x.shape[1]))
        self.edges = [np.unique(q) for q in quantiles.T]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        self.base = float(np.log(rate / (1 - rate)))
        self.feature, self.cut, self.leaf = [], [], []
        bins = self._bins(x)
        score = np.full(len(y), self.base)
        for _ in range(trees if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            self._grow(bins, y - p, np.maximum(p * (1 - p), 1e-6))
            score += self._one(bins, len(self.leaf) - 1)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def _grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        nodes = 1 << self.depth
        feature, cut, at = np.zeros(nodes, np.int64), np.full(nodes, 255, np.int64), np.ones(len(g), np.int64)
        n_features = bins.shape[1]
        for level in range(self.depth):
            low, wide = 1 << level, 1 << level
            best = np.full(wide, 1e-9)
            for j in range(n_features):
                key = (at - low) * BINS + bins[:, j]
                gs, hs, ns = (np.bincount(key, w, wide * BINS).reshape(wide, BINS).cumsum(1) for w in (g, h, np.ones(len(g))))
                G, H, N = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (G - gs) ** 2 / (H - hs + RIDGE) - G**2 / (H + RIDGE)
                gain[(ns < LEAST_LEAF) | (N - ns < LEAST_LEAF)] = 0
                k = gain.argmax(1)
                most = gain[np.arange(wide), k]
                better = most > best
                best[better] = most[better]
                feature[low : low + wide][better], cut[low : low + wide][better] = j, k[better]
            at = 2 * at + (bins[np.arange(len(at)), feature[at]] > cut[at])
        leaf = at - nodes
        value = RATE * np.bincount(leaf, g, nodes) / (np.bincount(leaf, h, nodes) + RIDGE)
        self.feature.append(feature)
        self.cut.append(cut)
        self.leaf.append(value)

    def _one(self, bins: np.ndarray, t: int) -> np.ndarray:
        at, row = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            at = 2 * at + (bins[row, self.feature[t][at]] > self.cut[t][at])
        return self.leaf[t][at - (1 << self.depth)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        bins = self._bins(x)
        return self.base + sum((self._one(bins, t) for t in range(len(self.leaf))), np.zeros(len(x)))


def labelled(page: Page, most: int = TRAIN_NODES_A_PAGE) -> tuple[np.ndarray, np.ndarray]:
    """Nodes whose place in the markup tells what they are, ``most`` of them at most, and whether they are content."""
    n = len(page.tag)
    inside = np.zeros(n, bool)
    around = np.zeros(n, bool)
    for i, t in enumerate(page.tag):
        if t in _CONTENT:
            inside[i : page.end[i]] = True
            j = page.parent[i]
            while j >= 0 and not around[j]:
                around[j] = True
                j = page.parent[j]
    for i, t in enumerate(page.tag):
        if t in _OTHER:
            inside[i : page.end[i]] = False
    known = ~around if inside.any() else np.zeros(n, bool)
    at = np.flatnonzero(known)
    if len(at) > most:
        at = at[np.linspace(0, len(at) - 1, most).astype(np.int64)]
    return at, inside[at]


def fit_pages(sources: list[str], train_nodes: int = TRAIN_NODES_A_PAGE) -> Trees:
    pages = [Page(s) for s in sources]
    xs, ys = [np.zeros((0, 29 + ATTRIBUTE_BUCKETS), np.float32)], [np.zeros(0, bool)]
    for p in pages:
        at, y = labelled(p, train_nodes)
        if len(at):
            xs.append(describe([p])[at])
            ys.append(y)
    return Trees(np.concatenate(xs), np.concatenate(ys).astype(float))


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES, train_nodes: int = TRAIN_NODES_A_PAGE) -> Trees:
    """A model of ``train_pages`` pages at most, ``train_nodes`` nodes at most of each, evenly spread over it.

    They are the pages of lowest hash among those with an ``article`` or ``main`` tag; of repeated ids
    the page whose text is first in order.
    """
    rows = renamed(pages, {"page_id": "long", "html": "string"}).where("html is not null and page_id is not null")
    telling = rows.where(F.col("html").rlike(r"(?i)<(article|main)([\s/>]|$)"))
    keys = telling.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages).collect()
    found = telling.where(F.col("page_id").isin([r.page_id for r in keys])).groupBy("page_id").agg(F.min("html").alias("html")).collect() if keys else []
    return fit_pages([r.html for r in sorted(found, key=lambda r: r.page_id)], train_nodes)


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the consistent choice of greatest total log-odds, weighted by the nodes' own text."""
    n = len(page.tag)
    own = np.zeros(n)
    for node, text in page.texts:
        own[node] += len(text)
    gain = odds * np.log1p(own)
    run = np.concatenate([[0.0], np.cumsum(gain)])
    whole = (run[page.end] - run[:n]).tolist()
    mixed, choice = [0.0] * n, [0] * n  # 0 dropped, 1 kept whole, 2 open
    single = np.maximum(gain, 0.0).tolist()
    parent = page.parent
    for i in range(n - 1, -1, -1):
        open_gain = mixed[i] + single[i] - OPEN_COST if page.end[i] > i + 1 else -1.0
        best = max(0.0, whole[i], open_gain)
        choice[i] = 0 if best == 0.0 else 1 if best == whole[i] else 2
        if i:
            mixed[parent[i]] += best
    kept = np.zeros(n, bool)
    i = 0
    while i < n:
        if choice[i] == 2:
            kept[i] = gain[i] > 0
            i += 1
        else:
            kept[i : page.end[i]] = choice[i] == 1
            i = page.end[i]
    return kept


def text_of(page: Page, kept: np.ndarray) -> str:
    """The kept nodes' text, a line per block."""
    block = list(range(len(page.tag)))
    for i, t in enumerate(page.tag):
        if i and t in _INLINE:
            block[i] = block[page.parent[i]]
    breaks = {i for i, t in enumerate(page.tag) if t in ("br", "hr")}
    lines: list[list[str]] = []
    last, last_node = None, 0
    for node, text in page.texts:
        if kept[node]:
            if block[node] != last or any(i in breaks for i in range(last_node + 1, node + 1)):
                lines.append([])
            lines[-1].append(text)
            last, last_node = block[node], max(node, last_node)
    return "\n".join(x for x in (" ".join("".join(line).split()) for line in lines) if x)


def _extractor(shared) -> Callable:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Trees = shared.value
        for batch in tidied(batches):
            null = batch.column(1).is_null()
            sources = strings(batch.column(1))
            for a, b in slices(sources):
                pages = [Page(s) for s in sources.slice(a, b - a).to_pylist()]
                odds = trees.score(describe(pages))
                base = np.cumsum([0, *(len(p.tag) for p in pages)])
                kept = [decode(p, odds[base[i] : base[i + 1]]) for i, p in enumerate(pages)]
                texts = pa.array([text_of(p, k) for p, k in zip(pages, kept, strict=True)], pa.string())
                texts = pa.array(texts.to_pylist(), pa.string(), mask=null.slice(a, b - a).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), texts, pa.array([len(p.tag) - 1 for p in pages]), pa.array([int(k[1:].sum()) for k in kept])],
                    ["page_id", "text", "n_nodes", "n_kept"],
                )

    return extract


def extract_pages(pages: DataFrame, model: Trees | None = None) -> DataFrame:
    """``page_id, text, n_nodes, n_kept`` for each row of ``pages(page_id, html, …)``.

    A null page has a null text and no nodes; an empty page, or one without content, the empty text.
    Broken markup is read as far as it can be: what isn't closed ends with its parent, at any depth.
    Very long pages are read whole. Repeated rows each give a row, a null ``page_id`` stays null, other columns are ignored, an empty table gives no
    rows. Where no page tells content by its markup, every node's odds are even and nothing is kept.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages))
    return renamed(pages, {"page_id": "long", "html": "string"}).mapInArrow(_extractor(shared), EXTRACTED)
