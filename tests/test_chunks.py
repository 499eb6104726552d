import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscule.functions import text as tx
from corpuscule.operators import chunk


def walk(text, most, overlap):
    """The rule, step by step."""
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while True:
        end = start + most
        if end >= len(text):
            out.append(text[start:])
            break
        double = max((i for i in range(start, end - 1) if text[i : i + 2] == "\n\n"), default=-1)
        space = max((i for i in range(start, end) if text[i] == " "), default=-1)
        cut = double if double > start + most // 2 else space
        cut = cut if cut > start else end
        out.append(text[start:cut])
        following = cut - overlap
        start = following if overlap > 0 and following > start else cut
    return [p.strip() for p in out if p.strip()]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab  \n\n"), max_size=120), st.integers(2, 40), st.integers(0, 39))
def test_splitting(text, most, overlap):
    assert chunk.split_text(text, most, min(overlap, most - 1)) == walk(text, most, min(overlap, most - 1))


def test_splitting_in_a_plan(spark):
    texts = ["x" * 3000, "x" * 3001, "word " * 2000, "", None, "é😀 " * 1500]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in rows.select("i", chunk.split_large_text(F.col("t")).alias("p")).collect()}
    assert all(got[i] == (None if t is None else walk(t, 3000, 200)) for i, t in enumerate(texts))


def block(i, kind, text, level=None):
    return dict(index=i, type=kind, text=text, markdown=text, level=level)


def test_headings_make_sections():
    blocks = [block(0, "heading", "A", 1), block(1, "heading", "B", 2), block(2, "paragraph", "one"), block(3, "heading", "C", 3), block(4, "paragraph", "two"), block(5, "heading", "D", 3), block(6, "paragraph", "x" * 50)]
    got = chunk.heading_chunks(blocks, "T", 60, 10)
    assert [(c["section_path"], c["blocks"]) for c in got] == [(["A", "B"], [0, 1, 2]), (["A", "B", "C"], [3, 4]), (["A", "B", "D"], [5, 6])]
    assert got[0]["text"] == "A\n\nB\n\none" and got[0]["score"] == 0.8 and got[0]["labels"] == ["short_chunk"]
    skipped = [block(0, "heading", "A", 1), block(1, "paragraph", "p"), block(2, "heading", "B", 3), block(3, "paragraph", "q"), block(4, "heading", "C", 3), block(5, "paragraph", "r")]
    assert [c["section_path"] for c in chunk.heading_chunks(skipped, None, 100, 0)] == [["A"], ["A", "B"], ["A", "B", "C"]]


def test_packing_fills_up_and_cites_all():
    rng = random.Random(1)
    blocks = [block(i, rng.choice(["paragraph", "code"]), "w" * rng.randint(1, 90)) for i in range(60)]
    got = chunk.fixed_chunks(blocks, None, 80, 10)
    assert all(len(c["text"]) <= 80 for c in got)
    assert sorted({i for c in got for i in c["blocks"]}) == list(range(60))


def test_chunks_of_documents(spark):
    schema = "document_id string, uri string, title string, blocks array<struct<index:int,type:string,text:string,markdown:string,level:int,page:int,line_start:int,line_end:int,confidence:double>>"
    docs = spark.createDataFrame([("doc_ab", "u", "T", [(0, "paragraph", "alpha " * 200, None, None, 2, 3, 9, 0.5)]), ("doc_cd", "v", None, [])], schema)
    rows = chunk.chunked(docs, "fixed", 80, 10).collect()
    assert all(r.char_count == len(r.text) <= 80 and r.id.startswith("chk_ab_fixed_") for r in rows)
    ref = rows[0].source_refs[0]
    assert ref.block_ids == ["blk_ab_000000"] and (ref.page_start, ref.line_start, ref.line_end) == (2, 3, 9) and rows[0].extraction_confidence == 0.5
    with pytest.raises(NotImplementedError):
        chunk.chunked(docs, "semantic")
    with pytest.raises(ValueError):
        chunk.chunked(docs, "fixed", 10, 10)


def test_chunks_show_what_their_blocks_say(spark):
    """Tokens, pages, lines and mean confidence against the blocks themselves; a row carries nothing else of its document."""
    kind = "index:int,type:string,text:string,markdown:string,level:int,page:int,line_start:int,line_end:int,confidence:double"
    rnd = random.Random(5)
    pick = lambda *x: rnd.choice(x)
    word = lambda: pick("a", "bb", "c\u00a0d", "\u2003e", "f\x1cg", "\u00e9")
    docs = {
        f"doc_{d}": [(i, pick("paragraph", "code"), " ".join(word() for _ in range(rnd.randint(0, 40))), None, None, pick(None, 0, 3, 7), pick(None, 0, 5, 9), pick(None, 0, 6, 8), pick(None, 0.1, 0.2, 0.7)) for i in range(rnd.randint(0, 30))]
        for d in range(12)
    }
    made = chunk.chunked(spark.createDataFrame([(k, "u", "T", v) for k, v in docs.items()], f"document_id string, uri string, title string, blocks array<struct<{kind}>>"), "fixed", 90, 10)
    rows = made.withColumn("estimate", tx.token_estimate(F.col("text"))).collect()
    assert len(rows) > 100
    for r in rows:
        ref = r.source_refs[0]
        cited = [b for b in docs[r.document_id] if f"blk_{r.document_id[4:]}_{b[0]:06d}" in ref.block_ids]
        of = lambda n, zero=True: [b[n] for b in cited if b[n] or zero and b[n] == 0]  # noqa: E731, B023
        assert (ref.page_start, ref.page_end) == (min(of(5), default=None), max(of(5), default=None))
        assert (ref.line_start, ref.line_end) == (min(of(6, False), default=None), max(of(7, False), default=None))
        n = 0.0
        for x in of(8):
            n += x
        assert r.extraction_confidence == (n / len(of(8)) if of(8) else None)
        words = len(r.text.split())
        assert r.token_count_estimate == r.estimate == (max(1, round(words * 1.3)) if words else 0)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "split(" not in plan and "array_contains" not in plan


def test_an_empty_line_just_within_the_latter_half_is_a_cut():
    text = "a" * 201 + "\n\n" + "b " * 200
    assert chunk.split_text(text, 400, 40)[0] == "a" * 201
    assert chunk.split_text(text[1:], 400, 40)[0] != "a" * 200  # at the half itself it isn't
