"""Rows for other tools: JSON lines, Markdown, and the document shapes of two retrieval frameworks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import scan


def jsonl_rows(chunks: DataFrame, redact: bool = False, findings: DataFrame | None = None) -> DataFrame:
    """``id, text, metadata`` of each chunk; the chunk's own metadata come last and override.

    Redaction takes the chunks' ``findings`` where they are given, and scans the texts else.
    """
    if redact:
        known = None if findings is None else findings.where("chunk_id is not null").drop("id").withColumnRenamed("chunk_id", "id")
        chunks = scan.redact(chunks, "text") if known is None else scan.redact_found(chunks, "id", "text", known)
    ref = F.col("source_refs")[0]
    named = [("document_id", F.col("document_id")), ("source_uri", ref["source_uri"]), ("title", F.col("title")), ("section_path", F.to_json("section_path"))]
    named += [(k, ref[k].cast("string")) for k in ("page_start", "page_end", "line_start", "line_end")] + [("redacted", F.lit(str(redact).lower()))]
    base = F.create_map(*[x for k, v in named for x in (F.lit(k), v)])
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys("metadata"), k))
    return chunks.select("id", "text", F.map_concat(kept, "metadata").alias("metadata"))


def full_text(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(F.nullif(b["text"], F.lit("")), b["markdown"], F.lit(""))), "\n\n")


def langchain_rows(documents: DataFrame, pack_id: str, redact: bool = False) -> DataFrame:
    """``page_content`` and ``metadata`` of each document."""
    rows = documents.withColumn("page_content", full_text(F.col("blocks")))
    rows = scan.redact(rows, "page_content") if redact else rows
    base = F.create_map(
        F.lit("source"), "uri", F.lit("title"), F.coalesce(F.nullif("title", F.lit("")), "document_id"), F.lit("document_id"), "document_id", F.lit("corpus_id"), "document_id", F.lit("pack_id"), F.lit(pack_id)
    )
    return rows.select("page_content", F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key("metadata", k)), "metadata").alias("metadata"))


def llamaindex_rows(documents: DataFrame, pack_id: str, redact: bool = False) -> DataFrame:
    """``text``, ``id_``, ``metadata`` and the keys kept from embedding and model."""
    rows = documents.withColumn("text", full_text(F.col("blocks")))
    rows = scan.redact(rows, "text") if redact else rows
    base = F.create_map(F.lit("file_name"), "uri", F.lit("document_title"), F.coalesce(F.nullif("title", F.lit("")), "document_id"), F.lit("pack_id"), F.lit(pack_id))
    hidden = F.array(F.lit("pack_id"))
    meta = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key("metadata", k)), "metadata")
    return rows.select("text", F.col("document_id").alias("id_"), meta.alias("metadata"), hidden.alias("excluded_embed_metadata_keys"), hidden.alias("excluded_llm_metadata_keys"))


def _filled() -> Column:
    return F.filter("blocks", lambda b: F.trim(F.coalesce(F.nullif(b["markdown"], F.lit("")), b["text"], F.lit(""))) != "")


def _shown(b: Column) -> Column:
    """A block as Markdown; a heading with its marks."""
    text = F.coalesce(F.nullif(b["markdown"], F.lit("")), b["text"])
    level = F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce(b["level"], F.lit(1))))
    return F.when(b["type"] == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.coalesce(F.nullif(b["text"], F.lit("")), text))).otherwise(text)


def normalized_rows(documents: DataFrame) -> DataFrame:
    """``document_id`` and the whole document as a pack keeps it: Markdown after a front matter in JSON."""
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v"))), '(?s)^\\{"v":(.*)\\}$', 1)
    fields = {"document_id": F.col("document_id"), "source_uri": F.col("uri"), "title": F.coalesce(F.nullif("title", F.lit("")), "document_id")}
    front = F.concat_ws(",\n", *[F.concat(F.lit(f'  "{k}": '), quoted(v)) for k, v in fields.items()])
    body = tx.stripped(F.array_join(F.transform(_filled(), _shown), "\n\n"))
    return documents.select("document_id", F.concat(F.lit("---\n{\n"), front, F.lit("\n}\n---\n\n"), body, F.lit("\n")).alias("markdown"))


def markdown_rows(documents: DataFrame, redact: bool = False) -> DataFrame:
    """``document_id`` and the whole document as Markdown with a front matter."""
    head = ["---", "document_id: ", "source_uri: ", "title: ", "redacted: true", "---"]
    front = F.concat_ws(
        "\n", F.lit(head[0]), F.concat(F.lit(head[1]), "document_id"), F.concat(F.lit(head[2]), tx.yaml_quoted(F.col("uri"))),
        F.concat(F.lit(head[3]), tx.yaml_quoted(F.coalesce(F.nullif("title", F.lit("")), "document_id"))), *([F.lit(head[4])] if redact else []), F.lit(head[5]),
    )
    filled, shown = _filled(), _shown
    if redact:
        lines = documents.select("document_id", F.posexplode(F.transform(filled, shown)).alias("n", "line"))
        lines = scan.redact(lines, "line").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
        rows = documents.join(lines, "document_id", "left").withColumn("body", F.coalesce(F.transform("l", lambda x: x["line"]), F.array().cast("array<string>")))
    else:
        rows = documents.withColumn("body", F.transform(filled, shown))
    whole = F.concat(front, F.lit("\n\n"), F.array_join("body", "\n\n"))
    return rows.select("document_id", F.concat(F.regexp_replace(whole, "(?U)\\s+$", ""), F.lit("\n")).alias("markdown"))
