import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpuscule.llm import quality


@pytest.fixture(scope="module")
def labelled(spark, written):
    rows = []
    for i in range(240):
        text, good, toxic = written(i, 40), int(i % 4 != 0), int(i % 5 == 0)
        text = text if good else text.replace(" ", "### ")
        rows.append((i, text + (" horrid rotten" if toxic else ""), good, toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_held_out_accuracy(labelled):
    rows, docs, labels = labelled
    model = quality.fit(docs.where("doc_id < 160"), labels)
    got = {r.doc_id: r for r in quality.score_documents(docs, labels, model).collect()}
    assert all(got[i].keep == (q == 1 and x == 0) for i, _, q, x in rows[160:])


def test_indicators_equal_brute_force(written):
    texts = [written(1, 30), "a a a b", "", "x, y!! 12 1234", None]
    column = pa.array([t or "" for t in texts])
    f, d = quality.indicators(column)
    for i in range(len(texts)):
        alone = quality.indicators(column.slice(i, 1))[0]
        assert sorted(f[d == i].tolist()) == sorted(alone.tolist()) == sorted(set(quality.features(column.slice(i, 1))[0].tolist()))


def test_dual_descent_reaches_the_least_loss():
    rng = np.random.default_rng(2)
    x, true = rng.normal(size=(120, 6)), rng.normal(size=6)
    y = np.where(x @ true > 0, 1.0, -1.0)
    cols = np.tile(np.arange(6), 120)
    w = quality.dual_descent(np.arange(121) * 6, cols, x.ravel(), y, np.ones(120), 6, epochs=500)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v[:6] + v[6])).sum()
    assert all(loss(w) <= loss(w + rng.normal(scale=0.02, size=7)) + 1e-2 for _ in range(300))


def test_odd_rows(clashing, nothing, labelled):
    _, _, labels = labelled
    got = quality.score_documents(clashing, labels).collect()
    assert len(got) == clashing.count()
    kept = quality.keep_good(clashing, labels)
    assert kept.columns == clashing.columns and kept.count() == sum(r.keep for r in got)
    assert quality.score_documents(nothing, labels).count() == 0
    assert all(r.keep for r in quality.score_documents(clashing, labels.limit(0)).collect())


def test_documents_below_the_threshold_are_dropped(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b c")], "doc_id long, text string")
    model = quality.Model([], np.zeros(0, bool), np.zeros(0, bool))
    for score, n in ((-0.2, 0), (-0.11, 0), (-0.1, 2), (0.5, 2)):
        model.quality_bias = score  # all there is to the score
        assert sum(r.keep for r in quality.score_documents(docs, None, model).collect()) == n
        assert quality.keep_good(docs, None, model).count() == n


def test_the_fit_uses_five_thousand_rows(spark):
    docs = spark.range(6_000).selectExpr("id as doc_id", "'text' as text")
    labels = spark.range(6_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    assert len(quality.training_rows(docs, labels)) == 5_000


MASK = (1 << 64) - 1


def plain_mix(h, salt=0):
    h ^= salt
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def plain_hash(span: bytes) -> int:
    """The polynomial hash of a span, one byte after the other."""
    h, power = 0, 1
    for c in span:
        h, power = (h + (c + 1) * power) & MASK, (power * 0x100000001B3) & MASK
    return plain_mix((h + len(span) * 0x9E3779B97F4A7C15) & MASK)


def plain_features(text: str) -> set[int]:
    """Tokens by a regular expression, their pairs and the beginnings of words, each hashed by itself."""
    raw = text.lower().encode()
    tokens = [(m.lastgroup, m[0]) for m in re.finditer(rb"(?P<word>[a-zA-Z\x80-\xff]+)|(?P<number>[0-9]+)|(?P<sign>[!-/:-@\[-`{-~]+)", raw)]
    found, before = [], None
    for kind, token in tokens:
        h = 0xD161 if kind == "number" else plain_hash(token[:2] if kind == "sign" else token)
        found.append(h)
        if before is not None:
            found.append(0x4E9 if before == h else plain_mix((before * 0x9E3779B97F4A7C15 + h) & MASK, 0x2))
        before = h
        if kind == "word":
            found += [plain_mix(plain_hash(token[:n]), n << 8) for n in quality.PREFIXES if len(token) > n]
    return {plain_mix(h, 0x5EED) >> (64 - quality.FEATURE_BITS) for h in found}


def plain_model(texts, positive):
    """Weights by feature, from dictionaries and loops."""
    rows = [plain_features(t) for t in texts]
    counts = Counter(f for r in rows for f in r)
    common = {f for f, n in counts.items() if n >= quality.LEAST_ROWS}
    p, q = Counter(f for r, y in zip(rows, positive, strict=True) if y for f in r), Counter(f for r, y in zip(rows, positive, strict=True) if not y for f in r)
    total_p, total_q = sum(p[f] + 1 for f in common), sum(q[f] + 1 for f in common)
    ratio = {f: math.log((p[f] + 1) / total_p) - math.log((q[f] + 1) / total_q) for f in common}
    xs = [{f: ratio[f] / math.sqrt(max(1, len(r & common))) for f in r & common} for r in rows]
    cost = [len(rows) / (2 * sum(y == z for z in positive)) for y in positive]
    w, bias, alpha = dict.fromkeys(common, 0.0), 0.0, [0.0] * len(rows)
    rng = np.random.default_rng(quality.SEED)
    for _ in range(quality.EPOCHS):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            y, norm = 1.0 if positive[i] else -1.0, sum(v * v for v in xs[i].values()) + 1
            gradient = y * (sum(w[f] * v for f, v in xs[i].items()) + bias) - 1
            new = min(max(alpha[i] - gradient / norm, 0.0), cost[i])
            step, alpha[i] = new - alpha[i], new
            worst = max(worst, abs(step) * norm)
            for f, v in xs[i].items():
                w[f] += step * y * v
            bias += step * y
        if worst < 1e-3:
            break
    mean = sum(map(abs, w.values())) / len(w)
    return {f: ratio[f] * (0.25 * mean + 0.75 * w[f]) for f in common}, 0.75 * bias


def test_the_operator_equals_brute_force(spark, labelled):
    """Features, both models, scores and decisions of every row, none of the operator's own functions used."""
    rows, docs, labels = labelled
    train = rows[:120]
    extra = [(1_000, "Ünï çödé 12 34!!! ?? x", 1, 0), (1_001, "", 1, 0), (1_002, "a a a a b, b, b", 1, 0)]
    good, toxic = plain_model([t for _, t, _, _ in train], [q == 1 for _, _, q, _ in train]), plain_model([t for _, t, _, _ in train], [x == 1 for *_, x in train])
    more = docs.unionByName(spark.createDataFrame([(i, t) for i, t, _, _ in extra], "doc_id long, text string"))
    got = {r.doc_id: r for r in quality.score_documents(more, labels.where("doc_id < 120")).collect()}
    for i, text, _, _ in [*rows, *extra]:
        found = plain_features(text)
        a, b = (sum(w.get(f, 0.0) for f in found) / math.sqrt(max(1, sum(f in good[0] or f in toxic[0] for f in found))) + bias for w, bias in (good, toxic))
        assert got[i].quality_score == pytest.approx(a, abs=2e-3) and got[i].toxic_score == pytest.approx(b, abs=2e-3), i
        if abs(a - quality.LEAST_QUALITY) > 2e-3 and abs(b - quality.MOST_TOXIC) > 2e-3:
            assert got[i].keep == (a >= quality.LEAST_QUALITY and b <= quality.MOST_TOXIC)


def test_repeated_ids_train_alike_in_any_order(spark):
    docs = [(i, f"text {i} {x}") for i in range(20) for x in "cab"]
    labels = [(i, q, 0) for i in range(20) for q in (1, 0, 1)]
    got = [
        quality.training_rows(spark.createDataFrame(d, "doc_id long, text string").repartition(n), spark.createDataFrame(x, "doc_id long, quality int, toxic int").repartition(n))
        for d, x, n in ((docs, labels, 1), (docs[::-1], labels[::-1], 5))
    ]
    assert got[0] == got[1] == [(i, f"text {i} a", 0, 0) for i in range(20)]
