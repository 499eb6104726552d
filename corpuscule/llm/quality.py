"""Quality classifier: naive Bayes support vectors.

Features are indicators: tokens (runs of letters, of digits, of signs), pairs of neighbours, and the
beginnings of words. Each is scaled by its class log-count ratio; on the scaled indicators a linear
model of hinge loss is fitted by dual coordinate descent and interpolated with the plain naive Bayes
weights. Two such models are fitted to the labels, one for quality and one for toxicity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKEN_CLASS, buffer_of, mix, renamed, runs, slices, span_hashes, strings, tidied, tidy

#: Labelled rows used, at most, half of them from either class where there are enough.
TRAIN_ROWS = 5_000
#: Features are told apart by so many bits of their hash.
FEATURE_BITS = 20
#: Lengths in bytes of the word beginnings.
PREFIXES = (5, 7)
#: Features in fewer training rows aren't used.
LEAST_ROWS = 3
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 10
#: Weight of the fitted model against the plain naive Bayes one.
INTERPOLATION = 0.75
SEED = 7
#: A row is kept whose quality score is at least, and whose toxic score is at most, this.
LEAST_QUALITY = -0.1
MOST_TOXIC = -0.15

SCORED = "doc_id long, quality_score double, toxic_score double, keep boolean"


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and text numbers of a slice, repetitions included, in no set order."""
    data, offsets = buffer_of(pc.utf8_lower(column))
    starts, ends, doc = runs(data, offsets, TOKEN_CLASS)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = TOKEN_CLASS[data[starts]]
    h = span_hashes(data, starts, ends)
    h[kind == 2] = np.uint64(0xD161)  # all numbers alike
    signs = kind == 3
    if signs.any():  # a run of one sign counts as that sign doubled
        at = np.flatnonzero(signs & (ends - starts > 2))
        h[at] = span_hashes(data, starts[at], starts[at] + 2)
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:], 0x2)
    pair[h[:-1] == h[1:]] = np.uint64(0x4E9)  # a token and itself
    both = doc[:-1] == doc[1:]
    out, docs = [h, pair[both]], [doc, doc[:-1][both]]
    for n in PREFIXES:
        at = np.flatnonzero((kind == 1) & (ends - starts > n))
        out.append(mix(span_hashes(data, starts[at], starts[at] + n), n << 8))
        docs.append(doc[at])
    all_h = mix(np.concatenate(out), 0x5EED)
    return (all_h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), np.concatenate(docs)


def indicators(column: pa.Array, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct features, sorted by text; of the ``useful`` ones only, if given."""
    f, d = features(column)
    if useful is not None:
        there = useful[f]
        f, d = f[there], d[there]
    key = np.unique((d << FEATURE_BITS) | f)
    return key & ((1 << FEATURE_BITS) - 1), key >> FEATURE_BITS


def dual_descent(starts: np.ndarray, cols: np.ndarray, x: np.ndarray, y: np.ndarray, cost: np.ndarray, n: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the linear model of least hinge loss, L2-penalised; the last weight is the bias.

    Solves the dual one coordinate at a time in random order, the weights kept up to date.
    """
    w, alpha = np.zeros(n + 1), np.zeros(len(y))
    bounds = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
    norm = np.array([x[a:b] @ x[a:b] + 1 for a, b in bounds])
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            a, b = bounds[i]
            at, v = cols[a:b], x[a:b]
            gradient = y[i] * (w[at] @ v + w[n]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                w[n] += (new - alpha[i]) * y[i]
                worst = max(worst, abs(new - alpha[i]) * norm[i])
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


def fit_nbsvm(texts: list[str], positive: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each feature and the bias; a score above 0 means the positive class."""
    size = 1 << FEATURE_BITS
    column = pa.array(texts, pa.string())
    f_parts, d_parts = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for a, b in slices(column):
        f, d = indicators(column.slice(a, b - a))
        f_parts.append(f.astype(np.int32))
        d_parts.append((d + a).astype(np.int32))
    f, d = np.concatenate(f_parts), np.concatenate(d_parts)
    del f_parts, d_parts
    common = np.bincount(f, minlength=size) >= LEAST_ROWS
    f, d = f[common[f]], d[common[f]]
    y = np.where(positive, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):  # one class only
        return np.zeros(size, np.float32), float(np.sign(y.sum())) if len(y) else 1.0
    p = SMOOTHING + np.bincount(f[positive[d]], minlength=size)
    q = SMOOTHING + np.bincount(f[~positive[d]], minlength=size)
    ratio = np.where(common, np.log(p / p[common].sum()) - np.log(q / q[common].sum()), 0.0)
    starts = np.searchsorted(d, np.arange(len(y) + 1))
    length = np.sqrt(np.maximum(1, np.diff(starts)))  # long texts have more indicators
    x = ratio[f] / np.repeat(length, np.diff(starts))
    cost = np.where(positive, len(y) / (2 * positive.sum()), len(y) / (2 * (~positive).sum())) * COST
    w = dual_descent(starts, f, x, y, cost, size)
    mean = np.abs(w[:size][common]).mean() if common.any() else 0.0
    weights = ratio * ((1 - INTERPOLATION) * mean + INTERPOLATION * w[:size])
    return weights.astype(np.float32), float(INTERPOLATION * w[size])


class Model:
    """The two fitted models; only features with a weight are looked up."""

    def __init__(self, texts: list[str], good: np.ndarray, toxic: np.ndarray):
        self.quality, self.quality_bias = fit_nbsvm(texts, good)
        self.toxic, self.toxic_bias = fit_nbsvm(texts, toxic)
        if not len(texts):
            self.toxic_bias = -1.0
        self.useful = (self.quality != 0) | (self.toxic != 0)

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        f, d = indicators(column, self.useful)
        n = np.sqrt(np.maximum(1, np.bincount(d, minlength=len(column))))
        return (
            np.bincount(d, self.quality[f], len(column)) / n + self.quality_bias,
            np.bincount(d, self.toxic[f], len(column)) / n + self.toxic_bias,
        )


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> list:
    """``doc_id, text, quality, toxic`` of labelled rows, those of lowest hash from each class first.

    Of repeated ids the lowest label and the text first in order count.
    """
    known = renamed(labels, {"doc_id": "long", "quality": "int", "toxic": "int"}).dropna()
    known = known.groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("label")).select("doc_id", "label.*")
    by = Window.partitionBy("quality", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = known.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= most // 2)
    known = known.orderBy("nth", "quality", "toxic").limit(most)
    rows = renamed(docs, {"doc_id": "long", "text": "string"}).where("doc_id is not null and text is not null")
    by_id = {r.doc_id: r for r in known.collect()}  # most rows at most
    found = rows.where(F.col("doc_id").isin(list(by_id))).groupBy("doc_id").agg(F.min("text").alias("text")).collect() if by_id else []
    return sorted(((r.doc_id, r.text, by_id[r.doc_id].quality, by_id[r.doc_id].toxic) for r in found))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Models of ``labels(doc_id, quality, toxic)``, from ``train_rows`` labelled rows at most.

    Unlabelled rows, and labels without a document or with a null, don't count.
    """
    rows = training_rows(docs, labels, train_rows)
    model = Model([t for _, t, _, _ in rows], np.array([q == 1 for *_, q, _ in rows], bool), np.array([t == 1 for *_, t in rows], bool))
    del rows
    tidy()
    return model


def _scores(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [model.score(texts.slice(a, b - a)) for a, b in slices(texts)]
    empty = [np.zeros(0)]
    return np.concatenate(empty + [q for q, _ in parts]), np.concatenate(empty + [t for _, t in parts])


def _scorer(shared) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            quality, toxic = _scores(shared.value, strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(quality), pa.array(toxic), pa.array((quality >= LEAST_QUALITY) & (toxic <= MOST_TOXIC))], ["doc_id", "quality_score", "toxic_score", "keep"])

    return score


def score_documents(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, quality_score, toxic_score, keep`` for each row of ``docs(doc_id, text, …)``.

    A row is kept whose quality score is at least LEAST_QUALITY and whose toxic score at most MOST_TOXIC.
    Null and empty texts get the models' biases, very long ones are read whole, repeated rows each give a
    row, a null ``doc_id`` stays null, other columns are ignored, an empty table gives no rows. Without
    labels every row is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))
    return renamed(docs, {"doc_id": "long", "text": "string"}).mapInArrow(_scorer(shared), SCORED)


def keep_good(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that ``score_documents`` keeps, with their own columns, whatever these are called.

    Null and empty texts stay or go by the models' biases; repeated rows all stay or go; very long texts
    are read whole; without labels every row stays; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            quality, toxic = _scores(shared.value, strings(batch.column(at)))
            yield batch.filter(pa.array((quality >= LEAST_QUALITY) & (toxic <= MOST_TOXIC)))

    return docs.mapInArrow(keep, docs.schema)
