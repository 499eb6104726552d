"""HTML extraction against a version without stacks, running sums or histograms."""

import math
import random

import numpy as np
import pytest
import xxhash

from corpuscule.llm import html_extract as h


def tree_of(source):
    """Nodes as dicts, by scanning the whole list of open ones at each tag."""
    nodes, texts, stack, head = [dict(tag="#", parent=-1, attrs="", depth=0)], [], [0], False
    closes_p, siblings = h._CLOSES_P, h._SIBLING_CLOSE

    def nearest(names):
        for i in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[i]]["tag"]
            if tag in names:
                del stack[i:]
                return
            if tag not in h._INLINE and tag not in ("td", "th", "tr"):
                return

    for m in h._TOKEN.finditer(source):
        if m["text"] and not head:
            text = h.entities.unescape(m["text"])
            if text.strip():
                texts.append((stack[-1], text))
            elif texts:
                texts.append((stack[-1], " "))
        elif m["end"]:
            name = m["end"].lower()
            head = head and name not in ("head", "title")
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]]["tag"] == name:
                    del stack[i:]
                    break
        elif m["tag"]:
            name = m["tag"].lower()
            if name == "head" or name == "title" and (head or not texts):
                head = True
                continue
            if head and name in h._IN_HEAD:
                continue
            head = False
            if name in closes_p:
                nearest({"p"})
            if name in siblings:
                nearest(siblings[name])
            nodes.append(dict(tag=name, parent=stack[-1], attrs=m["attrs"], depth=len(stack)))
            if name not in h._VOID and not m["attrs"].endswith("/"):
                stack.append(len(nodes) - 1)
    return nodes, texts


def family(nodes):
    children = {i: [] for i in range(len(nodes))}
    for i, n in enumerate(nodes):
        if i:
            children[n["parent"]].append(i)
    below = lambda i: [i, *(k for c in children[i] for k in below(c))]
    return children, below


def features_of(nodes, texts):
    children, below = family(nodes)
    rows = []
    kind = lambda i: -1 if nodes[i]["tag"] in h._HIDDEN else h._KINDS.get(nodes[i]["tag"], len(h._KINDS))
    said = {i: [t for n, t in texts if n == i] for i in range(len(nodes))}
    count = lambda i, f: sum(f(t) for t in said[i])

    def in_link(i):
        return i >= 0 and (nodes[i]["tag"] == "a" or in_link(nodes[i]["parent"]))

    def sums(i):
        under = below(i)
        return dict(
            chars=sum(count(k, len) for k in under), words=sum(count(k, lambda t: t.count(" ") + 1) for k in under),
            signs=sum(count(k, lambda t: sum(c in ".,;:!?" for c in t)) for k in under), capitals=sum(count(k, lambda t: sum(c.isupper() for c in t)) for k in under),
            digits=sum(count(k, lambda t: sum(c.isdigit() for c in t)) for k in under), linked=sum(count(k, len) for k in under if in_link(k)), n=len(under),
            links=sum(nodes[k]["tag"] == "a" for k in under), paragraphs=sum(nodes[k]["tag"] == "p" for k in under),
        )

    all_sums = [sums(i) for i in range(len(nodes))]
    for i, node in enumerate(nodes):
        s, up = all_sums[i], max(0, node["parent"])
        beside = children[up] if i else [0]
        # the root counts as the first of its own children
        line = [0, *children[0]] if up == 0 else beside
        place = line.index(i)
        siblings = max(1, len(children[up]))
        same = sum(kind(k) == kind(i) for k in line)
        tokens = h._ATTRIBUTE.findall(node["attrs"].lower())
        buckets = [0] * h.ATTRIBUTE_BUCKETS
        if node["tag"] != "a":
            for t in tokens:
                if t not in ("href", "class", "id"):
                    buckets[xxhash.xxh32_intdigest(t) % h.ATTRIBUTE_BUCKETS] += 1
        share = lambda x: x["linked"] / max(x["chars"], 1)
        per = max(s["chars"], 1)
        rows.append([
            node["depth"], kind(i), math.log1p(s["chars"]), math.log1p(count(i, len)), share(s), math.log1p(s["n"]), math.log1p(s["chars"] / s["n"]), math.log1p(s["words"]),
            s["chars"] / max(s["words"], 1), s["signs"] / per, s["capitals"] / per, s["digits"] / per, math.log1p(s["links"]), math.log1p(s["paragraphs"]), math.log1p(len(children[i])),
            math.log1p(place), place / siblings, math.log1p(siblings), same / siblings, math.log1p(all_sums[line[place - 1]]["chars"] if place else 0),
            math.log1p(all_sums[line[place + 1]]["chars"] if place + 1 < len(line) else 0), s["chars"] / max(1, all_sums[up]["chars"] / siblings), math.log1p(all_sums[up]["chars"]),
            share(all_sums[up]), math.log1p(all_sums[up]["chars"] / all_sums[up]["n"]), kind(up), i / len(nodes), s["chars"] / max(1, all_sums[0]["chars"]), math.log1p(len(tokens)), *buckets,
        ])
    return np.array(rows, np.float32)


def boosted(x, y, trees, depth):
    """Trees by trying every cut of every feature on the rows themselves; returns a scoring function."""
    edges = [np.unique(q) for q in np.quantile(x, np.linspace(0, 1, h.BINS + 1)[1:-1], axis=0).T]
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = math.log(rate / (1 - rate))
    bins = lambda v: np.array([[sum(e < f for e in edges[j]) for j, f in enumerate(row)] for row in v])
    at, score, made = bins(x), np.full(len(y), base), []

    def loss(g, k):
        return g.sum() ** 2 / (k.sum() + h.RIDGE)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, k = y - p, np.maximum(p * (1 - p), 1e-6)
        splits = {}

        def grow(rows, name, level):
            if level == depth:
                splits[name] = h.RATE * g[rows].sum() / (k[rows].sum() + h.RIDGE)
                return
            best, how = 1e-9, (0, 255)
            for j in range(x.shape[1]):
                for c in range(h.BINS):
                    low = rows[at[rows, j] <= c]
                    high = rows[at[rows, j] > c]
                    if len(low) < h.LEAST_LEAF or len(high) < h.LEAST_LEAF:
                        continue
                    gain = loss(g[low], k[low]) + loss(g[high], k[high]) - loss(g[rows], k[rows])
                    if gain > best + 1e-9:
                        best, how = gain, (j, c)
            splits[name] = how
            grow(rows[at[rows, how[0]] <= how[1]], name + "0", level + 1)
            grow(rows[at[rows, how[0]] > how[1]], name + "1", level + 1)

        def walk(row, splits=splits):
            name = ""
            while len(name) < depth:
                j, c = splits[name]
                name += str(int(row[j] > c))
            return splits[name]

        grow(np.arange(len(y)), "", 0)
        made.append(walk)
        score = score + np.array([walk(r) for r in at])
    return lambda v: np.array([base + sum(w(r) for w in made) for r in bins(v)])


def chosen(nodes, texts, odds):
    children, below = family(nodes)
    own = [sum(len(t) for n, t in texts if n == i) for i in range(len(nodes))]
    gain = [o * math.log1p(n) for o, n in zip(odds, own, strict=True)]
    kept = set()

    def best(i):
        whole = sum(gain[k] for k in below(i))
        opened = max(0.0, gain[i]) + sum(best(c) for c in children[i]) - h.OPEN_COST if children[i] else -1.0
        return max(0.0, whole, opened)

    def take(i):
        whole = sum(gain[k] for k in below(i))
        most = best(i)
        if most == 0.0:
            return
        if abs(most - whole) < 1e-12:
            kept.update(below(i))
            return
        if gain[i] > 0:
            kept.add(i)
        for c in children[i]:
            take(c)

    take(0)
    return kept


def page(i):
    rng = random.Random(i)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "Gamma,", "delta.", "42", "omega"]) for _ in range(n))
    menu = "".join(f"<li class='item n{k}'><a href='/{k}'>{words(2)}</a>" for k in range(rng.randint(3, 6)))
    body = "".join(f"<p>{words(20)} <b>{words(2)}</b>" for _ in range(rng.randint(2, 5)))
    table = f"<table><tr><td>{words(1)}<td>{words(2)}<tr><th>{words(1)}</table>" if i % 3 == 0 else ""
    tags = ("article", "nav") if i % 4 else ("main", "aside")
    return f"<html><head><title>x</title></head><body><{tags[1]} id='menu'><ul>{menu}</ul></{tags[1]}><{tags[0]}><h1>{words(3)}</h1>{body}{table}</{tags[0]}><footer>{words(4)}</footer></body></html>"


SOURCES = [page(i) for i in range(24)] + ["", "<p>a<p>b<i>c", "<b><i>x</b>y</i>", "<ul><li>a<ul><li>b</ul><li>c</ul>", "text only", "<td>a<td>b<tr>c"]


@pytest.mark.parametrize("source", [*SOURCES[:4], *SOURCES[-6:]])
def test_trees_and_features(source):
    p, (nodes, texts) = h.Page(source), tree_of(source)
    assert (p.tag, p.parent, p.depth, p.texts) == ([n["tag"] for n in nodes], [n["parent"] for n in nodes], [n["depth"] for n in nodes], texts)
    _, below = family(nodes)
    assert p.end == [max(below(i)) + 1 for i in range(len(nodes))]
    np.testing.assert_allclose(h.describe([p]), features_of(nodes, texts), rtol=1e-5, atol=1e-5)


def test_the_operator_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(h, "TREES", 3)
    train = [h.Page(s) for s in SOURCES]
    x, y = [], []
    for p, s in zip(train, SOURCES, strict=True):
        at, inside = h.labelled(p)
        if len(at):
            x.append(features_of(*tree_of(s))[at])
            y.append(inside)
    x, y = np.concatenate(x), np.concatenate(y).astype(float)
    model, slow = h.Trees(x, y, trees=3, depth=2), boosted(x, y, 3, 2)
    np.testing.assert_allclose(model.score(x), slow(x), rtol=1e-9)
    held = [page(1_000 + i).replace("article", "div").replace("main", "div") for i in range(12)]
    pages = spark.createDataFrame(list(enumerate(held)), "page_id long, html string")
    got = {r.page_id: r for r in h.extract_pages(pages, model).collect()}
    for i, source in enumerate(held):
        nodes, texts = tree_of(source)
        kept = chosen(nodes, texts, slow(features_of(nodes, texts)))
        assert got[i].n_nodes == len(nodes) - 1 and got[i].n_kept == len(kept - {0})
        assert "".join(got[i].text.split()) == "".join("".join(t for n, t in texts if n in kept).split())


def test_ends_far_above_close_all_between():
    for n in (10, 300, 5_000):
        p = h.Page("<article>" + "<b>" * n + "x</article><p>after")
        assert p.tag[-1] == "p" and p.depth[-1] == 1 and p.end[1] == n + 2
        q = h.Page("<p>" + "<b>" * n + "x<p>after")
        assert q.depth[-1] == 1 and q.parent[-1] == 0


def test_all_attribute_tokens_count_and_training_nodes_spread_over_the_page():
    many = " ".join(f"a{i}=b{i}" for i in range(200))
    assert h.describe([h.Page(f"<div {many}>x")])[1, 28] == pytest.approx(math.log1p(400))
    p = h.Page("<article>" + "<p>x" * 3_000 + "</article>" + "<div>y</div>" * 3_000)
    at, inside = h.labelled(p, 100)
    assert len(at) == 100 and 40 <= inside.sum() <= 60
