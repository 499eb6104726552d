import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscule.functions import ids, text as tx

ODD = ["", " ", "a\r\nb\rc", "x\t\v\f  y", "é", "\u0085a\u0085", "\x1ca\x1c b", "a\n\n\n\n\nb", "  x  ", "a\0b", "  a \n  b  \n\n \n c ", "﻿x", "😀 é", "a b"]


def model(text, keep=True):
    text = unicodedata.normalize("NFC", text).replace("\0", "").replace("\r\n", "\n").replace("\r", "\n")
    lines = [re.sub("[\t\r\f\v ]+", " ", x).strip() for x in text.split("\n")]
    return re.sub("\n{3,}", "\n\n", ("\n" if keep else " ").join(lines)).strip()


def check(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    got = {r.i: r for r in rows.select("i", tx.normalize(t).alias("n"), tx.normalize(t, False).alias("l"), tx.paragraphs(t).alias("p"), tx.n_words(t).alias("w"), tx.token_estimate(t).alias("k")).collect()}
    for i, x in enumerate(texts):
        assert got[i].n == model(x) == tx.normalized(x), repr(x)
        assert got[i].l == model(x, False) == tx.normalized(x, False), repr(x)
        assert got[i].p == [p.strip() for p in re.split(r"\n\s*\n", model(x)) if p.strip()] == tx.split_paragraphs(x), repr(x)
        assert got[i].w == len(x.split()), repr(x)
        assert got[i].k == (max(1, round(len(x.split()) * 1.3)) if x.strip() else 0), repr(x)


def test_odd_texts(spark):
    check(spark, ODD)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("ab \t\n\r\v\f\0\x1c\u0085  é́😀"), max_size=25), min_size=60, max_size=60))
def test_any_text(spark, texts):
    check(spark, texts)


def test_half_even_tokens(spark):
    n = list(range(1, 400))
    rows = spark.createDataFrame([(" ".join(["w"] * k), k) for k in n], "t string, k int")
    assert {r.k: r.e for r in rows.select("k", tx.token_estimate(F.col("t")).alias("e")).collect()} == {k: max(1, round(k * 1.3)) for k in n}


@pytest.mark.parametrize("uri,slug", [("file:///A Path/Doc.md", "file_a_path_doc_md"), ("__x__", "x"), ("", "")])
def test_slugs(spark, uri, slug):
    assert spark.range(1).select(ids.slug(F.lit(uri))).first()[0] == slug == ids.slug_of(uri)


def test_ids(spark):
    row = spark.range(1).select(
        ids.document_id(F.lit("0" * 64), F.lit("a b.md")).alias("d"), ids.block_id(F.lit("doc_1234"), F.lit(7)).alias("b"), ids.chunk_id(F.lit("doc_1234"), F.lit("fixed"), F.lit(12)).alias("c"),
        ids.finding_id(F.lit("doc_1234"), F.lit("pii:email"), F.lit(0)).alias("f"), ids.checksum(F.lit(b"x")).alias("s"),
    ).first()
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert row.d == "doc_" + sha("0" * 64 + ":a_b_md")[:16] and row.b == "blk_1234_000007" and row.c == "chk_1234_fixed_000012"
    assert row.f == "fnd_" + sha("doc_1234:pii_email:0")[:16] and row.s == "sha256:" + sha("x")
    assert ids.json_hash({"b": 1, "a": "é"}) == sha('{"a":"é","b":1}')
