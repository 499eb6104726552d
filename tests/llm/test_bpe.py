import random

import numpy as np
import pytest
import regex
import tiktoken

from corpuscule.llm import bpe, token_count

RANKS = bpe.read_ranks()
WHOLE = tiktoken.Encoding("whole", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(RANKS)}, special_tokens={})


def expected(rows):
    return sorted(((i, None if t is None else WHOLE.encode_ordinary(t)) for i, t, *_ in rows), key=repr)


@pytest.mark.parametrize("chunk,overlap", [(65_536, 1_024), (512, 64), (64, 32)])
def test_ids_equal_those_of_the_whole_text(odd, chunk, overlap):
    got = bpe.encode_documents(odd, chunk_chars=chunk, overlap_chars=overlap).collect()
    assert sorted(((r.doc_id, r.token_ids) for r in got), key=repr) == expected(odd.collect())
    assert all(r.round_trip for r in got if r.token_ids is not None)
    assert all(r.n_tokens == len(r.token_ids or ()) for r in got)


def test_round_trip(odd):
    texts = sorted(((r.doc_id, r.text) for r in odd.collect()), key=repr)
    assert sorted(((r.doc_id, r.text) for r in bpe.decode_documents(bpe.encode_documents(odd)).collect()), key=repr) == texts


def test_extra_columns_and_empty_tables(clashing, nothing):
    assert bpe.encode_documents(clashing, chunk_chars=512, overlap_chars=64).count() == clashing.count()
    assert bpe.encode_documents(nothing).count() == 0
    assert token_count.count_tokens(nothing).count() == 0
    assert token_count.count_tokens(clashing).count() == clashing.count()


def test_ids_outside_the_vocabulary_decode_to_null(spark):
    rows = spark.createDataFrame([(1, [10**6]), (2, [-1]), (3, []), (4, None), (5, [None])], "doc_id long, token_ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_documents(rows).collect()} == {1: None, 2: None, 3: "", 4: None, 5: None}


def test_stitching_random_texts():
    rng, split = random.Random(5), regex.compile(bpe.PATTERN)
    for trial in range(300):
        text = "".join(rng.choice(["a", "é", " ", "  ", "\n", "1", "22", "'s", "'", "!", "x" * 40, " " * 40]) for _ in range(rng.randint(1, 200)))
        chunk, overlap = 64, 32
        ends = lambda s: [m.end() for m in split.finditer(s)]
        zones = []
        for k in range(0, len(text), chunk):
            part = text[k : k + chunk + overlap]
            last = k + chunk + overlap >= len(text)
            zones.append(([p for p in ends(part) if p < overlap], [p - chunk for p in ends(part) if chunk <= p and (last or p < len(part) - bpe.LOOKAHEAD)]))
        cuts, _ = bpe.stitch(zones, chunk)
        assert set(cuts) <= {0, *ends(text)}, (trial, text, cuts)


def test_counts_equal_encoded_lengths(odd):
    got = sorted(((r.doc_id, r.n_tokens) for r in token_count.count_tokens(odd).collect()), key=repr)
    assert got == sorted(((i, len(t or ())) for i, t in expected(odd.collect())), key=repr)


def test_whole_tokens_are_proven():
    proven = token_count.whole_tokens(RANKS)
    assert len(proven) > 40_000
    sample = random.Random(1).sample(sorted(proven), 2_000)
    assert all(len(WHOLE.encode_ordinary(t)) == 1 for t in sample)


def test_memo_stays_bounded():
    memo = bpe.Memo({"a": 1}, len, most=10)
    assert [memo[f"t{i}"] for i in range(100)] == [len(f"t{i}") for i in range(100)]
    assert len(memo) <= 11 and memo["a"] == 1


def test_decoding_is_concatenation():
    codec = bpe.Codec(RANKS)
    ids = np.random.default_rng(1).integers(0, len(RANKS), 500)
    assert codec.decode(ids).tobytes() == b"".join(RANKS[i] for i in ids)


def test_texts_around_a_long_run_are_cut_on_both_sides(spark):
    """A run longer than several chunks ends neither the result nor the pieces before and after it."""
    words = "some words and 12 numbers, "
    rows = [(1, words * 40 + "x" * 3_000 + words * 400), (2, "y" * 5_000), (3, words * 300), (4, " " * 4_000 + "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe.encode_documents(docs, chunk_chars=512, overlap_chars=64).collect()
    assert sorted((r.doc_id, r.token_ids) for r in got) == expected(rows) and all(r.round_trip for r in got)
    texts = docs.selectExpr("cast(doc_id as string) as key", "text")
    shared = spark.sparkContext.broadcast(RANKS)
    cuts = {r.key: r.cuts for r in bpe._cuts(texts, shared, bpe.PATTERN, 512, 64, bpe.Scratch(spark)).collect()}
    run = len(words) * 40 + 3_000
    assert sum(c > run for c in cuts["1"]) >= 2 and cuts["2"][0] == 0 and len(cuts["3"]) > 10
