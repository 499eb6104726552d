"""Look-ups over chunks: term search, point look-ups and prompt assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUNDED = "Answer from the given sources only, name the source of each statement, and say so where they hold no answer."

#: What a serving adapter may offer; nothing of it writes.
READ_ONLY_TOOLS = ("search_context", "get_chunk", "get_source_metadata", "get_manifest", "explain_provenance")


def available_tools() -> list[str]:
    return list(READ_ONLY_TOOLS)


def query_terms(query: str) -> list[str]:
    return sorted({t.lower() for t in query.split()})


def search_context(chunks: DataFrame, query: str, limit: int = 10, order: tuple[str, ...] = ("document_id", "chunk_index")) -> DataFrame:
    """The chunks that contain most of the query's distinct terms, in lower case, as substrings.

    A scan, a filter and a top-k; equal scores keep the corpus's order.
    """
    low, score = F.lower("text"), F.lit(0.0)
    for term in query_terms(query):
        score = score + F.when(F.contains(low, F.lit(term)), 1.0).otherwise(0.0)
    return chunks.withColumn("score", score).where("score > 0").orderBy(F.col("score").desc(), *order).limit(limit)


def get_by_key(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.where(F.col(key) == value).limit(1)


def source_metadata(documents: DataFrame, document_id: str) -> DataFrame:
    """One document's title, source, metadata, and how many blocks and errors it has."""
    return get_by_key(documents, "document_id", document_id).select("document_id", "title", "uri", "metadata", F.size("blocks").alias("block_count"), F.size("errors").alias("error_count"))


def prompt_context(results: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The chunks of a search as one numbered text for a prompt; the search bounds their number."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col("source_uri"), F.col("text"))))
    parts = F.transform(rows, lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(r["source_uri"], F.lit("unknown")), F.lit("\n"), r["text"]))
    return results.agg(F.array_join(parts, "\n\n").alias("context"))


def rag_prompt(context: str, question: str) -> str:
    return f"{GROUNDED}\n\nSources:\n{context}\n\nQuestion: {question}\n"
