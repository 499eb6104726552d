"""Files as a DataFrame: discovery by recursive globs, probing, hashes and media types."""

from __future__ import annotations

import mimetypes
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from .decoders import BUILT_IN, Decoder, decoder_name

DEFAULT_EXCLUDE = ("**/.git/**", "**/node_modules/**", "**/__pycache__/**", "**/.venv/**", "**/.DS_Store")

#: The standard table of extensions, whatever a machine's own says, and what it lacks.
MEDIA_TYPES = mimetypes.MimeTypes((), True).types_map[True] | {
    ".md": "text/markdown", ".markdown": "text/markdown", ".text": "text/plain", ".log": "text/plain", ".srt": "text/plain", ".csv": "text/csv", ".json": "application/json",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".gz": "application/gzip",
}


def glob_pattern(glob: str) -> str:
    """A regular expression for the whole relative path: ``**`` spans folders (none too), ``*`` and ``?`` don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"^{out}$"


def matches(path: Column, globs: Sequence[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_pattern(g))
    return found


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)(\.[^.]+)$", 1))


def media_type(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return table[ext]


def discover(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = DEFAULT_EXCLUDE, stream: bool = False) -> DataFrame:
    """``path, rel_path, filename, ext, media_type, length, modified_at, content`` of the files under ``root``.

    A file is taken that matches any of ``include`` (all, if there are none) and none of ``exclude``.
    ``content`` is read only where a later step asks for it; a missing root is an error.
    """
    if stream:
        reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    else:
        reader = spark.read.format("binaryFile")
    files = reader.option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z]+:/+", "/", root).rstrip("/")
    bare = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^[a-z]+:/+", "/")
    inside = F.when(bare == base, F.regexp_extract(bare, "([^/]*)$", 1)).otherwise(F.expr("substring(_bare, length(_base) + 2)"))
    files = files.withColumn("_bare", bare).withColumn("_base", F.lit(base)).withColumn("rel_path", inside).drop("_bare", "_base")
    if include:
        files = files.where(matches(F.col("rel_path"), include))
    if exclude:
        files = files.where(~matches(F.col("rel_path"), exclude))
    ext = extension(F.col("rel_path"))
    return files.select(
        "path", "rel_path", F.regexp_extract("rel_path", "([^/]*)$", 1).alias("filename"), ext.alias("ext"), media_type(ext).alias("media_type"), "length", F.col("modificationTime").alias("modified_at"), "content"
    )


def with_identity(files: DataFrame, decoders: tuple[Decoder, ...] = BUILT_IN) -> DataFrame:
    """Adds the content's hash, the document id and the decoder."""
    return files.withColumn("sha256", F.sha2("content", 256)).withColumns(
        {"document_id": ids.document_id(F.col("sha256"), F.col("rel_path")), "decoder": decoder_name(F.col("ext"), F.col("media_type"), decoders)}
    )


def extension_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy(F.when(F.col("ext") == "", "<none>").otherwise(F.col("ext")).alias("ext")).agg(F.count(F.lit(1)).alias("files"))


def probe(files: DataFrame, decoders: tuple[Decoder, ...] = BUILT_IN) -> DataFrame:
    """One row: how many files there are, how large, which types, how many are supported, and warnings.

    It doesn't grow with the files; ``supported_files`` has these one by one.
    """
    known = F.col("ext").isin(*[e for d in decoders for e in d.extensions])
    histogram = extension_histogram(files).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "files")))).alias("file_types"))
    totals = files.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_size_bytes"),
        F.count_if(known).alias("supported_count"),
        F.count_if(~known).alias("unsupported_count"),
    )
    warned = F.when(F.col("unsupported_count") > 0, F.array(F.lit("unsupported_files_detected"))).otherwise(F.array().cast("array<string>"))
    return totals.crossJoin(histogram).withColumn("warnings", warned)


def supported_files(files: DataFrame, decoders: tuple[Decoder, ...] = BUILT_IN) -> DataFrame:
    """``rel_path, supported``, a row each."""
    return files.select("rel_path", F.col("ext").isin(*[e for d in decoders for e in d.extensions]).alias("supported"))


def explain_support(files: DataFrame, decoders: tuple[Decoder, ...] = BUILT_IN) -> DataFrame:
    """Per file, which decoder would read it."""
    name = decoder_name(F.col("ext"), F.col("media_type"), decoders)
    return files.select("rel_path", F.coalesce(F.concat(F.lit("supported by "), name), F.concat(F.lit("no decoder for "), F.col("ext"))).alias("explanation"))
