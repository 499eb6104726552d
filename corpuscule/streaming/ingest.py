"""Files that arrive over time, through the same projections as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..build import decode_files, document_text
from ..config import Config
from ..operators import chunk, scan
from ..sources import files


def stream_documents(spark: SparkSession, root: str, config: Config | None = None, late: str = "1 day") -> DataFrame:
    """Decoded documents of new files; a file of the same content and path within ``late`` counts once."""
    config = config or Config()
    found = files.discover(spark, root, config.input.include, config.input.exclude, stream=True)
    read = decode_files(found, config).where("decoder is not null")
    return read.withWatermark("modified_at", late).dropDuplicatesWithinWatermark(["document_id"])


def stream_chunks(documents: DataFrame, config: Config | None = None) -> DataFrame:
    c = (config or Config()).chunking
    return chunk.chunked(documents, c.strategy, c.max_chars, c.overlap_chars)


def stream_findings(documents: DataFrame) -> DataFrame:
    return scan.findings(documents.withColumn("text", document_text(F.col("blocks"))), "document_id", "text")
