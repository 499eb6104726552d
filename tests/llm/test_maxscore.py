import math

import numpy as np
import pyarrow as pa
import pytest

from corpuscule.llm import maxscore
from corpuscule.llm.common import words_of


def brute(docs, queries, k):
    tokens = [(i, words_of(t)) for i, t in docs]
    average = sum(len(w) for _, w in tokens) / len(tokens)
    out = []
    for item, text in queries:
        scored = []
        for i, w in tokens:
            score = 0.0
            for q in set(words_of(text)):
                tf, df = w.count(q), sum(q in v for _, v in tokens)
                if tf:
                    score += math.log(1 + (len(tokens) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
            if score:
                scored.append((-round(score, 6), i is None, i or 0))
        out += [(item, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_results_equal_brute_force(spark, written, clashing):
    docs = [(r.doc_id, r.text) for r in clashing.collect()] + [(100 + i, written(200 + i, 50)) for i in range(60)]
    queries = [(1, written(1, 12)), (2, written(203, 50)), (2, written(203, 50)), (3, None), (4, "no such words"), (None, "the and of")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in maxscore.search(table, asked, 7).collect()), key=repr)
    assert got == brute(docs, queries, 7)


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("first,longest", [(128, 8_192), (3, 50)])
def test_pruning_loses_nothing(seed, first, longest, monkeypatch):
    """Against all documents scored in full, over three shards with ties and thresholds handed on."""
    monkeypatch.setattr(maxscore, "FIRST_RANGE", first)
    monkeypatch.setattr(maxscore, "LONGEST_RANGE", longest)
    rng = np.random.default_rng(seed)
    n, vocabulary, shards = 400, 30, []
    idf = rng.uniform(0.1, 6, vocabulary)
    for _ in range(3):
        pair = np.unique(rng.integers(0, n * vocabulary, 4_000))
        shards.append((pair % vocabulary, pair // vocabulary, rng.integers(1, 3, len(pair)), rng.integers(2, 4, n) * 20))
    made = [maxscore.Shard(*s, idf, 50.0, np.arange(n) + n * i, rng.random(n) < 0.02) for i, s in enumerate(shards)]
    for _ in range(20):
        terms, best, rows = rng.choice(vocabulary, 8, replace=False), maxscore.Best(10), []
        for shard, (term, doc, tf, lengths) in zip(made, shards, strict=True):
            shard.search(terms, best)
            full = np.zeros(n)
            for t, d, f in zip(term, doc, tf, strict=True):
                if t in terms:
                    full[d] += idf[t] * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[d] / 50)))
            rows += [(-round(x, 6), bool(z), int(i)) for x, z, i in zip(full.tolist(), shard.null, shard.ids, strict=True) if x > 0]
        assert [(-s, z, i) for s, z, i in zip(best.score.tolist(), best.null.tolist(), best.held.tolist(), strict=True)] == sorted(rows)[:10]
    assert all(0 <= s.skipped <= s.postings for s in made)


def test_prose_is_pruned_within_one_shard(written):
    """Most postings of a query's terms are spared, in the first shard already."""
    texts = pa.array([written(i, 60) for i in range(3_000)])
    h, doc = maxscore.words(texts)
    queries = [np.array(sorted({maxscore.word_hash(w) for w in words_of(written(q, 60))}), np.uint64) for q in range(0, 3_000, 100)]
    vocabulary = maxscore.Vocabulary(np.concatenate(queries))
    at, term = vocabulary.find(h)
    pair, tf = np.unique(doc[at] * len(vocabulary) + term, return_counts=True)
    df = np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
    shard = maxscore.Shard(pair % len(vocabulary), pair // len(vocabulary), tf, np.bincount(doc, minlength=3_000), np.log(1 + (3_000 - df + 0.5) / (df + 0.5)), len(h) / 3_000)
    for q, words in enumerate(queries):
        best = maxscore.Best(10)
        shard.search(vocabulary.find(words)[1], best)
        assert best.held[0] == 100 * q
    assert shard.skipped > 0.3 * shard.postings


def test_groups_of_queries_and_empty_tables(spark, odd, nothing, monkeypatch):
    asked = spark.createDataFrame([(i, "the of and he") for i in range(5)], "item_id long, text string")
    whole = sorted(map(tuple, maxscore.search(odd, asked, 3).collect()), key=repr)
    monkeypatch.setattr(maxscore, "QUERIES_A_GROUP", 2)
    assert sorted(map(tuple, maxscore.search(odd, asked, 3).collect()), key=repr) == whole
    assert maxscore.search(nothing, asked).count() == 0 and maxscore.search(odd, asked.limit(0)).count() == 0
