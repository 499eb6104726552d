"""Exact top-k search by BM25, every row of a table of queries being a query.

A first pass counts, over all documents, their number, their length and the documents that hold each
query term. A second one indexes the documents in shards, the query terms' postings only, and runs
MaxScore on each: a query's terms, ordered by the most they can add, split into those that together
can't reach the score of the k-th best so far (non-essential) and the rest (essential). Documents in
essential postings are scored; the others are probed only for documents that can still compete. A
shard is searched in ranges of documents, short ones first, and the split is made anew for each, so
that the first few documents' scores spare most postings of the rest. The shards of a partition are
searched one after the other and share their thresholds; the partitions' best are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Vocabulary, renamed, slices, strings, tidied, word_hash, words, words_of

TOP_K = 10
K1 = 1.2
B = 0.75
#: Postings in a shard, about.
SHARD_POSTINGS = 1_500_000
#: Documents in a shard's first range and in its longest; ranges double in between.
FIRST_RANGE, LONGEST_RANGE = 128, 8_192
#: Non-essential terms probed at once, and how many postings are read in the time of one probe.
PROBED = 8
PROBE_COST = 8
#: Queries whose terms are held at once; further ones are searched in groups of as many.
QUERIES_A_GROUP = 20_000
#: Scores are given, compared and tied to so many decimals.
DECIMALS = 6
SLACK = 2e-6


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    for batch in tidied(batches):
        texts = strings(batch.column(1))
        for a, b in slices(texts):
            yield batch.column(0).slice(a, b - a), texts.slice(a, b - a)


def _statistics(shared) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value[0]
        df, n, length = np.zeros(len(vocabulary), np.int64), 0, 0
        for _, texts in _texts(batches):
            h, doc = words(texts)
            at, term = vocabulary.find(h)
            pair = np.unique(doc[at] * len(vocabulary) + term)
            df += np.bincount(pair % max(1, len(vocabulary)), minlength=len(vocabulary))
            n += len(texts)
            length += len(h)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], there])), pa.array(np.concatenate([[n, length], df[there]]))], ["term", "n"])

    return count


class Best:
    """The best k of a query so far: scores rounded, highest first, of equal ones the smallest id first, null ones last."""

    def __init__(self, k: int):
        self.k, self.score, self.held, self.null = k, np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> float:
        """What a document has to score at least to be among them."""
        return float(self.score[-1]) if len(self.score) == self.k else 0.0

    def add(self, score: np.ndarray, held: np.ndarray, null: np.ndarray) -> None:
        score = np.concatenate([self.score, np.round(score, DECIMALS)])
        held, null = np.concatenate([self.held, held]), np.concatenate([self.null, null])
        order = np.lexsort((held, null, -score))[: self.k]
        self.score, self.held, self.null = score[order], held[order], null[order]


class Shard:
    """Postings by term: documents in order, and what each adds to a score."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray, idf: np.ndarray, average: float, ids: np.ndarray | None = None, null: np.ndarray | None = None):
        norm = K1 * (1 - B + B * lengths / average) if average else np.full(len(lengths), K1)
        self.n = len(lengths)
        self.ids = np.arange(self.n) if ids is None else ids
        self.null = np.zeros(self.n, bool) if null is None else null
        key = term * np.int64(max(1, self.n)) + doc
        order = np.argsort(key, kind="stable")
        term, self.key, self.doc, tf = term[order], key[order], doc[order], tf[order].astype(float)
        self.adds = idf[term] * (tf * (K1 + 1) / (tf + norm[self.doc]))
        self.most = np.zeros(len(idf))
        np.maximum.at(self.most, term, self.adds)
        self.ranges, width = [0], FIRST_RANGE
        while self.ranges[-1] < self.n:
            self.ranges.append(min(self.n, self.ranges[-1] + width))
            width = min(2 * width, LONGEST_RANGE)
        #: Where each term's postings of each range begin.
        self.cuts = np.searchsorted(self.key, (np.arange(len(idf)) * np.int64(max(1, self.n)))[:, None] + np.array(self.ranges)[None, :])
        #: Postings of queries' terms, and those of them that were neither scored nor probed.
        self.postings = self.skipped = 0

    def probe(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """What each of the terms (rows) adds to each of these documents (columns)."""
        wanted = terms[:, None] * np.int64(max(1, self.n)) + docs[None, :]
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.adds[at], 0.0)

    def scores(self, terms: np.ndarray, r: int) -> np.ndarray:
        """What the terms' postings add to each document of a range."""
        begin, size = self.cuts[terms, r], self.cuts[terms, r + 1] - self.cuts[terms, r]
        ends = np.cumsum(size)
        at = np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.doc[at] - self.ranges[r], self.adds[at], self.ranges[r + 1] - self.ranges[r])

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Adds to ``best`` what of the shard belongs there; terms are added up in the order given."""
        here = terms[self.most[terms] > 0]
        if not len(here):
            return
        order = here[np.argsort(self.most[here], kind="stable")]
        bound = np.cumsum(self.most[order])
        self.postings += int((self.cuts[here, -1] - self.cuts[here, 0]).sum())
        for r, low in enumerate(self.ranges[:-1]):
            split = int(np.searchsorted(bound, best.least - SLACK, "left"))
            if split == len(order):  # no document left can compete
                self.skipped += int((self.cuts[here, -1] - self.cuts[here, r]).sum())
                return
            size = self.cuts[order, r + 1] - self.cuts[order, r]
            self.skipped += int(size[:split].sum())
            score = self.scores(order[split:], r)
            rest = bound[split - 1] if split else 0.0
            docs = np.flatnonzero((score > 0) & (score + rest >= best.least - SLACK))
            score, docs = score[docs], docs + low
            for i in range(split, 0, -PROBED):
                if not len(docs):
                    break
                some, n = order[max(0, i - PROBED) : i], int(size[max(0, i - PROBED) : i].sum())
                probes = len(some) * len(docs)
                if PROBE_COST * probes < n:
                    self.skipped -= probes
                    score = score + self.probe(some, docs).sum(0)
                else:  # so many documents compete that reading the postings is cheaper
                    self.skipped -= n
                    score = score + self.scores(some, r)[docs - low]
                left = bound[i - PROBED - 1] if i > PROBED else 0.0
                near = score + left >= best.least - SLACK
                docs, score = docs[near], score[near]
            if len(docs) > best.k:  # the k best of these leave the others no place
                near = score >= np.partition(score, -best.k)[-best.k] - SLACK
                docs = docs[near]
            if len(docs):
                adds, exact = self.probe(here, docs), np.zeros(len(docs))
                for row in adds:
                    exact += row
                best.add(exact, self.ids[docs], self.null[docs])


def _searcher(shared, k: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, queries, idf, average = shared.value
        best = [Best(k) for _ in queries]
        parts: list[list[np.ndarray]] = [[], [], [], []]
        ids: list[pa.Array] = []
        rows = postings = 0

        def flush() -> None:
            nonlocal rows, postings
            term, doc, tf, lengths = (np.concatenate(p) for p in parts)
            names = pa.concat_arrays(ids)
            shard = Shard(term, doc, tf, lengths, idf, average, names.fill_null(0).to_numpy(), names.is_null().to_numpy(zero_copy_only=False))
            for terms, so_far in zip(queries, best, strict=True):
                shard.search(terms, so_far)
            for p in parts:
                p.clear()
            ids.clear()
            rows = postings = 0

        for names, texts in _texts(batches):
            h, doc = words(texts)
            at, term = vocabulary.find(h)
            pair, tf = np.unique(doc[at] * max(1, len(vocabulary)) + term, return_counts=True)
            for p, x in zip(parts, (pair % max(1, len(vocabulary)), pair // max(1, len(vocabulary)) + rows, tf, np.bincount(doc, minlength=len(texts))), strict=True):
                p.append(x)
            ids.append(names)
            rows += len(texts)
            postings += len(pair)
            if postings >= SHARD_POSTINGS:
                flush()
        if rows:
            flush()
        at = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        if len(at):
            score, held, null = (np.concatenate([getattr(b, x) for b in best]) for x in ("score", "held", "null"))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held, mask=null), pa.array(score)], ["query", "doc_id", "score"])

    return search


def _group(docs: DataFrame, texts: list[str | None], k: int) -> DataFrame:
    """``query`` (position in ``texts``), ``doc_id``, ``score`` and ``rank``."""
    context = docs.sparkSession.sparkContext
    hashes = [np.array(sorted({word_hash(w) for w in words_of(t)}), np.uint64) for t in texts]
    vocabulary = Vocabulary(np.concatenate([np.zeros(0, np.uint64), *hashes]))
    queries = [vocabulary.find(h)[1] for h in hashes]
    counts = docs.mapInArrow(_statistics(context.broadcast((vocabulary,))), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r.term: r.n for r in counts.collect()}  # a row per query term at most
    n, length = counts.pop(-2, 0), counts.pop(-1, 0)
    df = np.zeros(len(vocabulary))
    for t, c in counts.items():
        df[t] = c
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shared = context.broadcast((vocabulary, queries, idf, length / n if n else 0.0))
    found = docs.mapInArrow(_searcher(shared, k), "query long, doc_id long, score double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``queries(item_id, text, …)`` its k best of ``docs(doc_id, text, …)``.

    Scores are BM25 over the query's distinct words, rounded to six decimals; of equal scores the
    smaller ``doc_id`` comes first, a null one last. Documents that share no word with the query
    aren't results, so null, empty and unmatched queries have none. Very long texts count whole.
    Repeated rows, of either table, each count; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = renamed(docs, {"doc_id": "long", "text": "string"})
    asked = renamed(queries, {"item_id": "long", "text": "string"}).orderBy("item_id", "text")
    out: DataFrame | None = None
    group: list = []

    def add(out: DataFrame | None) -> DataFrame:
        found = _group(rows, [r.text for r in group], k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(group)], "query long, item_id long")
        found = found.join(names, "query").select("item_id", "rank", "doc_id", "score")
        return found if out is None else out.unionByName(found)

    for row in asked.toLocalIterator():
        group.append(row)
        if len(group) == QUERIES_A_GROUP:
            out = add(out)
            group = []
    if group or out is None:
        out = add(out) if group else spark.createDataFrame([], "item_id long, rank long, doc_id long, score double")
    return out


SQL = f"""
WITH words AS (
  SELECT doc_id, n AS row_n, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')) AS w
  FROM (SELECT doc_id, text, row_number() OVER () AS n FROM documents)
), lengths AS (SELECT row_n, count(*) AS dl FROM words GROUP BY row_n),
tf AS (SELECT row_n, doc_id, w, count(*) AS tf FROM words GROUP BY row_n, doc_id, w),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
total AS (SELECT count(*) AS n, (SELECT count(*) FROM words)::DOUBLE / count(*) AS average FROM documents),
asked AS (
  SELECT q, item_id, w FROM (
    SELECT q, item_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'))) AS w
    FROM (SELECT item_id, text, row_number() OVER () AS q FROM benchmark))
), scored AS (
  SELECT q, item_id, tf.row_n, doc_id,
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / average)))), {DECIMALS}) AS score
  FROM asked JOIN tf USING (w) JOIN df USING (w) JOIN lengths USING (row_n) CROSS JOIN total
  GROUP BY q, item_id, tf.row_n, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP_K}
"""
