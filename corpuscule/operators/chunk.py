"""Chunkers: blocks of a document in, retrieval-ready chunks with their provenance out.

Packing and splitting depend on what came before, so both run as one Arrow UDF per document row over
its ordered block array; nothing is shuffled beyond gathering a document's blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text as tx
from ..functions.arrow import sliced
from ..functions.text import normalized

MAX_CHARS = 3000
OVERLAP_CHARS = 200

_CHUNK = pa.struct(
    [("text", pa.string()), ("title", pa.string()), ("section_path", pa.list_(pa.string())), ("blocks", pa.list_(pa.int32())), ("score", pa.float64()), ("labels", pa.list_(pa.string())), ("words", pa.int32()),
     ("page_start", pa.int32()), ("page_end", pa.int32()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("confidence", pa.float64())]
)
CHUNK = "struct<text:string,title:string,section_path:array<string>,blocks:array<int>,score:double,labels:array<string>,words:int,page_start:int,page_end:int,line_start:int,line_end:int,confidence:double>"


def split_text(text: str, most: int, overlap: int) -> list[str]:
    """Parts of ``most`` characters at most, cut at an empty line in the latter half, else at a space, else hard.

    Each part begins ``overlap`` characters before the last one's cut, where that goes forward.
    """
    if len(text) <= most:
        return [text]
    parts, at, n = [], 0, len(text)
    while n - at > most:
        window = at + most
        cut = text.rfind("\n\n", at, window)
        if cut <= at + most // 2:
            cut = text.rfind(" ", at, window)
        cut = window if cut <= at else cut
        parts.append(text[at:cut].strip())
        back = cut - max(0, overlap)
        at = back if back > at else cut
    if at < n:
        parts.append(text[at:].strip())
    return [p for p in parts if p]


def split_large_text(text: Column, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """``split_text`` as a column of arrays; a text that is short enough isn't handed to Python."""

    def split(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else split_text(t, most, overlap) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.when(F.length(text) <= most, F.array(text)).otherwise(sliced(split, "array<string>")(F.when(F.length(text) > most, text)))


def _of_block(block: dict[str, Any]) -> str:
    text = block["markdown"] if block["type"] in ("code", "table") and block["markdown"] else block["text"]
    return normalized(text or "")


def _pieces(text: str, most: int, overlap: int, blocks: list[int], title: str | None, path: list[str], score: float = 1.0, labels: tuple[str, ...] = ()) -> list[dict[str, Any]]:
    return [dict(text=normalized(p), title=title, section_path=path, blocks=blocks, score=score, labels=list(labels)) for p in split_text(text, most, overlap)]


def fixed_chunks(blocks: list[dict[str, Any]], title: str | None, most: int, overlap: int) -> list[dict[str, Any]]:
    """Blocks packed greedily; a longer code or table block is split by itself."""
    out, held, size = [], [], 0

    def flush() -> None:
        text = "\n\n".join(t for _, t in held).strip()
        if text:
            out.extend(_pieces(text, most, overlap, [i for i, _ in held], title, []))
        held.clear()

    for b in blocks:
        text = _of_block(b)
        if not text:
            continue
        if b["type"] in ("code", "table") and len(text) > most:
            flush()
            out += _pieces(text, most, overlap, [b["index"]], title, [])
            continue
        size = sum(len(t) + 2 for _, t in held) + len(text)
        if held and size > most:
            flush()
        held.append((b["index"], text))
    flush()
    return out


def heading_chunks(blocks: list[dict[str, Any]], title: str | None, most: int, overlap: int) -> list[dict[str, Any]]:
    """Sections by heading: a heading opens one, a full one is closed, and headings that follow each other stay together."""
    out: list[dict[str, Any]] = []
    path: list[str] = []
    here: list[str] = []
    held: list[tuple[int, str, str]] = []

    def flush() -> None:
        text = "\n\n".join(t for *_, t in held).strip()
        if text:
            short, large = len(text) < 100, len(text) > most * 0.9
            labels = ("short_chunk",) * short + ("large_chunk",) * large
            out.extend(_pieces(text, most, overlap, [i for i, *_ in held], here[-1] if here else title, list(here), 0.8 if short else 1.0, labels))
            held.clear()

    for b in blocks:
        text = _of_block(b)
        if not text:
            continue
        if b["type"] == "heading":
            if held and not (len(held) == 1 and held[0][1] == "heading"):
                flush()
            path = [*path[: max(0, (b["level"] or 1) - 1)], text]
            here = list(path)
        else:
            here = here or list(path)
            if held and sum(len(t) + 2 for *_, t in held) + len(text) > most:
                flush()
                here = list(path)
        held.append((b["index"], b["type"], text))
    flush()
    return out


def semantic_chunks(*_: Any) -> list[dict[str, Any]]:
    raise NotImplementedError("semantic chunking requires a plugin")


CHUNKERS: dict[str, Callable[..., list[dict[str, Any]]]] = {"heading": heading_chunks, "fixed": fixed_chunks, "semantic": semantic_chunks}


def _placed(made: list[dict[str, Any]], blocks: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """The chunks with their number of words and, of the blocks they cite, the pages, the lines and the mean confidence."""
    at = {b["index"]: n for n, b in enumerate(blocks)}
    out = []
    for c in made:
        cited = [blocks[n] for n in sorted({at[i] for i in c["blocks"] or () if i in at})]
        of = lambda name: [b[name] for b in cited if b[name] is not None]  # noqa: E731, B023
        pages, starts, ends, sure, total = of("page"), [x for x in of("line_start") if x], [x for x in of("line_end") if x], of("confidence"), 0.0
        for x in sure:  # one after the other: sum() would round in another way
            total += x
        out.append(
            dict(c, words=None if c["text"] is None else len(c["text"].split()), page_start=min(pages, default=None), page_end=max(pages, default=None), line_start=min(starts, default=None), line_end=max(ends, default=None), confidence=total / len(sure) if sure else None)
        )
    return out


def cut(blocks: Column, title: Column, strategy: str = "heading", most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS, chunkers: dict[str, Callable] | None = None) -> Column:
    """The chunks of a document, an array; none where there are no blocks. The whole block array is worked on at once."""
    if strategy not in (known := CHUNKERS | (chunkers or {})):
        raise ValueError(f"unknown chunking strategy: {strategy}")
    if most <= 0 or not 0 <= overlap < most:
        raise ValueError("max_chars must be positive and overlap_chars smaller")
    run = known[strategy]
    if run is semantic_chunks:
        run()

    def make(blocks: pa.Array, titles: pa.Array) -> pa.Array:
        return pa.array([_placed(run(b or [], t, most, overlap), b or []) for b, t in zip(blocks.to_pylist(), titles.to_pylist(), strict=True)], pa.list_(_CHUNK))

    slim = F.transform(blocks, lambda b: F.struct(*[b[x].alias(x) for x in ("index", "type", "text", "markdown", "level", "page", "line_start", "line_end", "confidence")]))
    return sliced(make, f"array<{CHUNK}>")(slim, title)


def chunked(documents: DataFrame, strategy: str = "heading", most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS, chunkers: dict[str, Callable] | None = None) -> DataFrame:
    """Chunks of ``documents(document_id, uri, title, blocks)``, a row each, with ids, citation and quality."""
    return listed(documents.withColumn("cut", cut(F.col("blocks"), F.col("title"), strategy, most, overlap, chunkers)), strategy)


def listed(documents: DataFrame, strategy: str) -> DataFrame:
    """The chunks in ``documents(document_id, uri, title, cut)``, a row each.

    Beside its chunk a row holds nothing of the document but ids and title, so a long document isn't
    copied for each of its chunks.
    """
    rows = documents.select("document_id", "uri", "title", F.posexplode("cut").alias("chunk_index", "c"))
    ref = F.struct(
        F.col("document_id"),
        F.transform("c.blocks", lambda i: ids.block_id(F.col("document_id"), i)).alias("block_ids"),
        F.col("uri").alias("source_uri"),
        *[F.col(f"c.{x}").alias(x) for x in ("page_start", "page_end", "line_start", "line_end")],
    )
    return rows.select(
        ids.chunk_id(F.col("document_id"), F.lit(strategy), F.col("chunk_index")).alias("id"),
        "document_id",
        "chunk_index",
        F.col("c.text").alias("text"),
        F.coalesce(F.nullif("c.title", F.lit("")), "title").alias("title"),
        F.col("c.section_path").alias("section_path"),
        F.array(ref).alias("source_refs"),
        tx.tokens(F.col("c.words")).alias("token_count_estimate"),
        F.length("c.text").cast("long").alias("char_count"),
        F.create_map(F.lit("chunker"), F.lit(strategy)).alias("metadata"),
        F.col("c.score").alias("score"),
        F.col("c.labels").alias("labels"),
        F.col("c.confidence").alias("extraction_confidence"),
        F.lit(True).alias("has_citation"),
    )
