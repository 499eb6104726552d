"""Benchmark decontamination by latent semantic retrieval.

Documents are read as blocks of ``BLOCK`` words. A first pass counts in how many passages each word of
the benchmark stands. A second one draws the range of the passages' TF-IDF matrix A: every partition
adds up A'(A X) for a random X, and the driver makes the leading right singular vectors of the sum
(a randomised SVD with its power step; the counts of all documents are in it). A third pass projects
all blocks, adds neighbouring ones up to windows of about a benchmark item's length, and compares
window and item by cosine. Candidates are confirmed on the words themselves: the longest common
subsequence, and for paraphrases the presence of the item's answer. Items of a few words, which say
too little for a cosine, are looked for as they are: all their words in a row.

The benchmark is the set of queries, compared with all windows in blocks; a window whose words can't
make up the least weight of any item is left out before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Vocabulary, mix, renamed, slices, strings, tidied, words

#: Words in a block, and blocks in a passage of the counts and the matrix.
BLOCK = 16
PASSAGE_BLOCKS = 4
#: Latent dimensions, and further columns drawn for accuracy.
RANK = 64
EXTRA = 8
#: Words of a lower share of the highest possible inverse document frequency aren't in the matrix, but for
#: the few rarest words of each item.
LEAST_IDF_SHARE = 0.35
RAREST = 4
#: Cosine from which a window is a candidate, and share of the item's weight that its words must have.
LEAST_COSINE = 0.42
LEAST_WEIGHT = 0.3
#: Share of the item's words, in order, that a copy has; that a paraphrase has, the answer found too.
COPY = 0.8
PARAPHRASE = 0.6
#: Words in one run that do for the answer, where as much of the item is there as of a paraphrase; shorter parts are in one run whole.
LEAST_RUN = 13
#: Words of the answer: the last so many of the item, where the benchmark has no column ``answer``.
ANSWER_WORDS = 6
#: Share of the answer's words, in order, that must be found.
ANSWER_FOUND = 0.7
#: Items of fewer words are found where all their words stand in a row.
LEAST_WORDS = 6
#: Items held at once; further ones are searched in groups of as many.
ITEMS_A_GROUP = 20_000
#: Pairs of windows and items compared at once.
COMPARED = 8_000_000
TERMS_A_ROW = 512
#: Partitions whose shares one task adds up.
FAN_IN = 32
SEED = 11

PAIRS = "doc_id long, item_id long, cosine double, lcs_ratio double, answer_found boolean, kind string"


class Items:
    """The benchmark's items: words, answers, and the vocabulary they make."""

    def __init__(self, rows: list[tuple[int | None, str | None, str | None]]):
        self.ids = [i for i, _, _ in rows]
        self.words = _word_lists([t for _, t, _ in rows])
        own = _word_lists([a for *_, a in rows])
        self.answers = [a if len(a) else w[-ANSWER_WORDS:] for a, w in zip(own, self.words, strict=True)]
        self.own_answer = [len(a) > 0 for a in own]
        self.vocabulary = Vocabulary(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        by: dict[int, dict[int, list[int]]] = {}
        for i, w in enumerate(self.words):
            if 0 < len(w) < LEAST_WORDS:
                by.setdefault(len(w), {}).setdefault(int(sequences(w, len(w))[0]), []).append(i)
        #: Of the short items, by number of words: the hashes of their sequences in order, and the items of each.
        self.short = {n: (np.array(sorted(found), np.uint64), [found[k] for k in sorted(found)]) for n, found in by.items()}


def _word_lists(texts: list[str | None]) -> list[np.ndarray]:
    """The word hashes of each text."""
    column, out = pa.array([t or "" for t in texts], pa.string()), []
    for a, b in slices(column):
        h, doc = words(column.slice(a, b - a))
        out += np.split(h, np.searchsorted(doc, np.arange(1, b - a)))
    return out


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` words in a row."""
    last = max(0, len(h) - n + 1)
    out = mix(h[:last], n)
    with np.errstate(over="ignore"):
        for j in range(1, n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + last])
    return out


def passages(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a slice, first word of each text, blocks before each text; positions and numbers of known words."""
    h, doc = words(texts)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    blocks = np.concatenate([[0], np.cumsum(-(-np.diff(first) // BLOCK))])
    at, term = vocabulary.find(h)
    return h, first, blocks, at, term


def _block_of(at: np.ndarray, first: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    doc = np.searchsorted(first, at, "right") - 1
    return blocks[doc] + (at - first[doc]) // BLOCK


def _passage_of(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    size = BLOCK * PASSAGE_BLOCKS
    before = np.concatenate([[0], np.cumsum(-(-np.diff(first) // size))])
    doc = np.searchsorted(first, at, "right") - 1
    return before[doc] + (at - first[doc]) // size


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in tidied(batches):
        texts = strings(batch.column(column))
        for a, b in slices(texts):
            yield batch.slice(a, b - a), texts.slice(a, b - a)


def _counter(shared) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value
        size = max(1, len(vocabulary))
        df, n = np.zeros(size, np.int64), 0
        for _, texts in _slices(batches, 0):
            _, first, _, at, term = passages(texts, vocabulary)
            df += np.bincount(np.unique(_passage_of(at, first) * size + term) % size, minlength=size)
            n += int((-(-np.diff(first) // (BLOCK * PASSAGE_BLOCKS))).sum())
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(df[there], n))], ["term", "n"])

    return count


def _ranger(shared) -> Callable:
    """Each partition's share of A'(A X), as rows of TERMS_A_ROW terms."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf, draw = shared.value
        size = max(1, len(vocabulary))
        total = np.zeros(draw.shape, np.float64)
        used = idf > 0
        for _, texts in _slices(batches, 0):
            _, first, _, at, term = passages(texts, vocabulary)
            there = used[term]
            pair, tf = np.unique(_passage_of(at[there], first) * size + term[there], return_counts=True)
            if not len(pair):
                continue
            term, passage = pair % size, pair // size
            weight = (tf * idf[term]).astype(np.float32)
            starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
            lengths = np.diff(np.append(starts, len(pair)))
            weight /= np.repeat(np.sqrt(np.add.reduceat(weight**2, starts)), lengths)
            product = np.add.reduceat(draw[term] * weight[:, None], starts, axis=0)
            order = np.argsort(term, kind="stable")
            back = np.repeat(np.arange(len(starts)), lengths)[order]
            term = term[order]
            heads = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            total[term[heads]] += np.add.reduceat(product[back] * weight[order][:, None], heads, axis=0)
        part = TaskContext.get().partitionId()
        there = np.flatnonzero(total.any(1)).astype(np.int32)  # only terms that occur
        for a in range(0, len(there), TERMS_A_ROW):
            for k in np.unique(there[a : a + TERMS_A_ROW] // TERMS_A_ROW).tolist():
                some = there[a : a + TERMS_A_ROW][there[a : a + TERMS_A_ROW] // TERMS_A_ROW == k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([part], pa.int64()), pa.array([some.tobytes()]), pa.array([total[some].tobytes()])], ["k", "part", "terms", "sums"]
                )

    return add


def _summed(table: pa.Table) -> pa.Table:
    rows = sorted(zip(*(table[c].to_pylist() for c in ("part", "terms", "sums")), strict=True))
    k = table["k"][0].as_py()
    total = np.zeros((TERMS_A_ROW, len(rows[0][2]) // 2 // len(rows[0][1])))
    for _, terms, sums in rows:  # in the order of the partitions, so that the sum is the same each time
        terms = np.frombuffer(terms, np.int32) - k * TERMS_A_ROW
        total[terms] += np.frombuffer(sums).reshape(len(terms), -1)
    there = np.flatnonzero(total.any(1)).astype(np.int32)
    return pa.table({"k": [k], "part": [rows[0][0] // FAN_IN], "terms": [(there + np.int32(k * TERMS_A_ROW)).tobytes()], "sums": [total[there].tobytes()]})


class Space:
    """The latent space, and the items in it."""

    def __init__(self, items: Items, idf: np.ndarray, sums: np.ndarray, draw: np.ndarray, rank: int):
        self.items = items
        core = draw.astype(np.float64).T @ sums  # X'A'AX
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        good = values > max(values.max(initial=0.0), 1e-12) * 1e-9
        half = sums @ (vectors[:, good] / np.sqrt(values[good]))
        u, s, _ = np.linalg.svd(half, full_matrices=False)
        basis = u[:, s > s.max(initial=0.0) * 1e-6][:, :rank] if s.size else np.zeros((len(idf), 0))
        self.idf, self.project = idf, (basis * idf[:, None]).astype(np.float32)
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, w in enumerate(items.words):
            term = np.unique(items.vocabulary.find(w)[1])
            term = term[idf[term] > 0]
            keys.append(i * len(idf) + term)
            values.append(idf[term] / idf[term].sum())
        self.keys, self.values = np.concatenate(keys), np.concatenate(values)  # each item's words, and their shares of its weight
        #: The largest share of each word in any item.
        self.share = np.zeros(len(idf))
        np.maximum.at(self.share, self.keys % max(1, len(idf)), self.values)
        self.scales: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for i, w in enumerate(items.words):
            if len(w) >= LEAST_WORDS:
                by.setdefault(max(2, -(-len(w) // BLOCK)), []).append(i)
        for m, who in by.items():
            rows = np.array([self.project[items.vocabulary.find(items.words[i])[1]].sum(0) for i in who])
            norm = np.sqrt((rows**2).sum(1))
            seen = norm > 0
            self.scales[m] = (np.array(who)[seen], (rows[seen] / norm[seen, None]).astype(np.float32))

    def candidates(self, at: np.ndarray, term: np.ndarray, first: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, ...]:
        """Texts, first blocks within the text, items and cosines of the windows near an item."""
        there = self.idf[term] > 0
        at, term = at[there], term[there]
        out: list[tuple[np.ndarray, ...]] = []
        if len(at):
            block = _block_of(at, first, blocks)
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            run = np.zeros((blocks[-1] + 1, self.project.shape[1]), np.float64)
            run[block[starts] + 1] = np.add.reduceat(self.project[term], starts, axis=0)
            np.cumsum(run, axis=0, out=run)
            most = np.zeros(blocks[-1] + 1)
            most[block[starts] + 1] = np.add.reduceat(self.share[term], starts)
            np.cumsum(most, out=most)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(blocks))
            begin = np.arange(blocks[-1])
            for m, (who, vectors) in self.scales.items():
                past = np.minimum(begin + m, blocks[doc + 1])
                able = np.flatnonzero(most[past] - most[begin] >= LEAST_WEIGHT - 1e-9)  # no item is met without
                window = (run[past[able]] - run[able]).astype(np.float32)
                norm = np.sqrt((window**2).sum(1))
                full = np.flatnonzero(norm > 1e-6)
                step = max(1, COMPARED // len(who))
                for a in range(0, len(full), step):
                    some = full[a : a + step]
                    near = window[some] @ vectors.T
                    near /= norm[some, None]
                    i, j = np.nonzero(near >= LEAST_COSINE)
                    at_block, item, cosine = able[some[i]], who[j], near[i, j]
                    known = self.shared_weight(np.searchsorted(block, at_block), np.searchsorted(block, np.minimum(at_block + m, blocks[doc[at_block] + 1])), item, term)
                    good = known >= LEAST_WEIGHT
                    at_block, item, cosine = at_block[good], item[good], cosine[good]
                    out.append((doc[at_block], at_block - blocks[doc[at_block]], item, cosine))
        if not out:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        return tuple(np.concatenate([o[c] for o in out]) for c in range(4))

    def shared_weight(self, begin: np.ndarray, end: np.ndarray, item: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Share of each item's weight that the words of its window have, repetitions counted."""
        n = end - begin
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(begin - total[:-1], n) + np.arange(total[-1])
        key = np.repeat(item, n) * len(self.idf) + term[at]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        run = np.concatenate([[0.0], np.cumsum(np.where(self.keys[place] == key, self.values[place], 0.0))])
        return run[total[1:]] - run[total[:-1]]


def lcs(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming over the item's words."""
    where: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    row = full
    for w in text.tolist():
        hit = row & where.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def shares_run(item: np.ndarray, text: np.ndarray, n: int) -> bool:
    """Whether ``n`` words in a row of the item stand in the text in a row."""
    runs = {item[i : i + n].tobytes() for i in range(len(item) - n + 1)}
    return any(text[i : i + n].tobytes() in runs for i in range(len(text) - n + 1))


def confirm(items: Items, i: int, text: np.ndarray) -> tuple[float, bool, str | None]:
    """Share of the item's words found in order, whether its answer is there, and what that makes of the text."""
    item, answer = items.words[i], items.answers[i]
    share = lcs(item, text) / len(item)
    found = len(answer) > 0 and lcs(answer, text) >= ANSWER_FOUND * len(answer)
    if share >= COPY or share < PARAPHRASE:
        return share, found, "copy" if share >= COPY else None
    return share, found, "paraphrase" if found else "part" if shares_run(item, text, int(np.ceil(min(LEAST_RUN, PARAPHRASE * len(item))))) else None


def short_found(items: Items, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """Text, short item and whether its answer is there, where all its words stand in a row; an answer of its own must be near."""
    for n, (known, who) in items.short.items():
        run = sequences(h, n)
        place = np.minimum(np.searchsorted(known, run), len(known) - 1)
        at = np.flatnonzero(known[place] == run) if len(run) else np.zeros(0, np.int64)
        doc = np.searchsorted(first, at, "right") - 1
        inside = at + n <= first[doc + 1]
        for p, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
            for i in who[place[p]]:
                answer = items.answers[i]
                around = h[max(first[d], p - 2 * BLOCK - len(answer)) : min(first[d + 1], p + n + 2 * BLOCK + len(answer))]
                found = len(answer) > 0 and lcs(answer, around) >= ANSWER_FOUND * len(answer)
                if (h[p : p + n] == items.words[i]).all() and (found or not items.own_answer[i]):
                    yield d, i, found


def contaminated(space: Space, texts: pa.Array) -> Iterator[tuple[int, int, float, float, bool, str]]:
    """Text number, item number, cosine, share in order, answer found and kind, for each pair confirmed."""
    items = space.items
    h, first, blocks, at, term = passages(texts, items.vocabulary)
    doc, block, item, near = space.candidates(at, term, first, blocks)
    done: set[tuple[int, int]] = set()
    for d, i, found in short_found(items, h, first):
        if (d, i) not in done:
            done.add((d, i))
            yield d, i, 1.0, 1.0, found, "copy"
    for c in np.lexsort((block, -near, item, doc)).tolist():
        d, i = int(doc[c]), int(item[c])
        if (d, i) in done:
            continue
        middle, n = first[d] + block[c] * BLOCK, len(items.words[i])
        share, found, kind = confirm(items, i, h[max(first[d], middle - n) : min(first[d + 1], middle + 2 * n + 2 * BLOCK)])
        if kind:
            done.add((d, i))
            yield d, i, float(near[c]), share, found, kind


def build(docs: DataFrame, rows: list[tuple], rank: int = RANK) -> Space:
    """The latent space of ``docs(text)`` for these items."""
    context = docs.sparkSession.sparkContext
    items = Items(rows)
    texts = docs.select(docs["text"].cast("string").alias("text"))
    counted = texts.mapInArrow(_counter(context.broadcast(items.vocabulary)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r.term: r.n for r in counted.collect()}  # a row per benchmark word at most
    n = counts.pop(-1, 0)
    df = np.zeros(max(1, len(items.vocabulary)))
    for t, c in counts.items():
        df[t] = c
    idf = np.log((1 + n) / (1 + df))
    used = idf >= LEAST_IDF_SHARE * np.log((1 + n) / 2)
    for w in items.words:
        term = items.vocabulary.find(np.unique(w))[1]
        used[term[np.argsort(-idf[term], kind="stable")[:RAREST]]] = True
    idf = np.where(used, np.maximum(idf, 1e-3), 0.0)
    draw = np.random.default_rng(SEED).standard_normal((len(idf), rank + EXTRA)).astype(np.float32)
    shared = context.broadcast((items.vocabulary, idf, draw))
    kind = "k long, part long, terms binary, sums binary"
    sums = texts.mapInArrow(_ranger(shared), kind)
    for _ in range(2):  # no task reads the shares of all partitions
        sums = sums.groupBy("k", F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(_summed, kind)
    sums = sums.groupBy("k").applyInArrow(_summed, kind)
    total = np.zeros(draw.shape)
    for r in sums.toLocalIterator():  # rank + EXTRA numbers a benchmark word
        total[np.frombuffer(r.terms, np.int32)] = np.frombuffer(r.sums).reshape(-1, draw.shape[1])
    return Space(items, idf, total, draw, rank)


def _spaces(docs: DataFrame, benchmark: DataFrame, rank: int) -> list[Space]:
    kinds = {"item_id": "long", "text": "string"} | ({"answer": "string"} if "answer" in benchmark.columns else {})
    rows, spaces = [], []
    for r in renamed(benchmark, kinds).orderBy("item_id", "text").toLocalIterator():
        rows.append((r.item_id, r.text, r["answer"] if "answer" in kinds else None))
        if len(rows) == ITEMS_A_GROUP:
            spaces.append(build(docs, rows, rank))
            rows = []
    return [*spaces, build(docs, rows, rank)] if rows else spaces


def find_contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_ratio, answer_found, kind`` of each document that holds a benchmark item.

    ``kind`` is ``copy`` (``COPY`` of the item's words in order), ``paraphrase`` (``PARAPHRASE`` of them,
    and the answer) or ``part`` (as many, and ``LEAST_RUN`` of them, or all of a shorter part, in one
    run). An item of under ``LEAST_WORDS`` words is found as a ``copy`` of cosine 1 where all its words
    stand in a row, near an answer if it has one of its own. Null, empty and wordless texts and items
    match nothing; very long texts are read whole; of a text that holds an item many times one pair is
    given. Repeated rows, of either table, each count; null ids stay null; other columns are ignored;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = renamed(docs, {"doc_id": "long", "text": "string"})
    found = spark.createDataFrame([], PAIRS)
    for space in _spaces(docs, benchmark, rank):
        shared = spark.sparkContext.broadcast(space)
        found = found.unionByName(rows.mapInArrow(_pair_finder(shared), PAIRS))
    return found


def _pair_finder(shared) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space: Space = shared.value
        for batch, texts in _slices(batches, 1):
            rows = list(contaminated(space, texts))
            if rows:
                d, i, near, share, there, kind = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(d)), pa.array([space.items.ids[x] for x in i], pa.int64()), pa.array(near), pa.array(share), pa.array(there), pa.array(kind)],
                    ["doc_id", "item_id", "cosine", "lcs_ratio", "answer_found", "kind"],
                )

    return find


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """The rows of ``docs`` in which ``find_contaminated`` finds no item, with their own columns, whatever these are called.

    Null and empty texts stay, whatever their id; repeated rows each stay or go; very long texts are read
    whole; without items every row stays; an empty table stays empty.
    """
    out = docs
    for space in _spaces(docs, benchmark, rank):
        out = out.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(space), docs.columns.index("text")), docs.schema)
    return out


def _clean(shared, at: int) -> Callable:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches, at):
            good = np.ones(batch.num_rows, bool)
            good[[row[0] for row in contaminated(shared.value, texts)]] = False
            yield batch.filter(pa.array(good))

    return clean
