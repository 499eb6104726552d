"""From a folder of files to documents, chunks, findings and a report, all DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import ids
from .operators import chunk, quality, scan
from .plugins import Registry
from .sources import decoders, files

VERSION = "0.1.0"


@dataclass
class Corpus:
    """A built corpus."""

    config: Config
    root: str
    files: DataFrame
    documents: DataFrame
    chunks: DataFrame
    findings: DataFrame
    warnings: DataFrame
    report: DataFrame
    counts: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Frees what the build keeps in memory or on disk; what is read from it later is computed anew."""
        for df in self.kept:
            df.unpersist()


def blocks_of(documents: DataFrame) -> DataFrame:
    """A row per block, with its id."""
    rows = documents.select("document_id", F.inline("blocks"))
    return rows.withColumnRenamed("index", "block_index").withColumn("block_id", ids.block_id(F.col("document_id"), F.col("block_index")))


def decode_files(found: DataFrame, config: Config, registry: Registry | None = None) -> DataFrame:
    """``found`` with what its decoder read; a projection per row, in a batch or a stream alike."""
    registry = registry or Registry()
    known = registry.all_decoders()
    rows = files.with_identity(found, known)
    rows = rows.withColumn("d", decoders.decoded(F.col("content"), F.col("rel_path"), F.col("decoder"), known))
    stamp = F.lit(config.as_of).cast("timestamp") if config.as_of else F.current_timestamp()
    return rows.select(
        "document_id", F.col("rel_path").alias("uri"), "sha256", F.col("length").alias("size_bytes"), "media_type", "modified_at", stamp.alias("extracted_at"), "decoder",
        F.col("d.title").alias("title"), F.col("d.blocks").alias("blocks"), F.col("d.errors").alias("errors"),
        F.map_concat(
            F.create_map(F.lit("filename"), "filename", F.lit("extension"), "ext", F.lit("relative_path"), "rel_path"), F.coalesce("d.metadata", F.create_map().cast("map<string,string>")),
            F.create_map(*[F.lit(x) for pair in sorted(registry.metadata.items()) for x in pair]).cast("map<string,string>"),
        ).alias("metadata"),
        F.lit(VERSION).alias("schema_version"), F.lit(ids.json_hash(config.as_dict())).alias("config_hash"),
    )


def document_text(blocks) -> F.Column:
    """The blocks' texts, or Markdown where there is no text, with empty lines between."""
    return F.array_join(F.filter(F.transform(blocks, lambda b: F.coalesce(F.nullif(b["text"], F.lit("")), b["markdown"])), lambda t: t.isNotNull()), "\n\n")


def build(spark: SparkSession, root: str, config: Config | None = None, registry: Registry | None = None) -> Corpus:
    """A corpus of the files under ``root``."""
    config = (config or Config()).check()
    return build_from(files.discover(spark, root, config.input.include, config.input.exclude), root, config, registry)


def counted(cut: DataFrame, supported: Column, empty: Column, failed: Column) -> DataFrame:
    """One row: how many files there are of each kind, and the lengths of what they were ``cut`` to, in one pass over them."""
    rows = cut.select(supported.alias("supported"), empty.alias("empty"), failed.alias("failed"), F.posexplode_outer(F.transform("cut", lambda c: F.length(c["text"]).cast("long"))).alias("i", "char_count"))
    supported, empty, failed = F.col("supported"), F.col("empty"), F.col("failed")
    first, many = F.coalesce(F.col("i"), F.lit(0)) == 0, lambda of: F.count_if(F.col("first") & of)
    return rows.withColumn("first", first).agg(
        many(F.lit(True)).alias("discovered"),
        many(supported).alias("supported"),
        many(~supported).alias("unsupported"),
        many(supported & (empty | failed)).alias("failed"),
        many(supported & empty).alias("empty"),
        many(supported & ~empty & ~failed).alias("document_count"),
        *quality.length_stats(F.col("i").isNotNull()),
    )


def build_from(found: DataFrame, root: str, config: Config, registry: Registry | None = None, keep: bool = True) -> Corpus:
    """A corpus of files wherever they were found, rows as ``files.discover`` gives them.

    Everything up to the chunks' findings is narrow; shuffled are duplicates and counts only. What was decoded
    and cut is kept, since most tables come from it; ``keep=False`` is for who reads ``counts`` only, which need one pass.
    """
    registry = registry or Registry()
    kept = lambda df: df.persist() if keep else df
    supported = F.col("decoder").isNotNull()
    failed = F.exists("errors", lambda e: e["severity"].isin("error", "critical"))
    empty = F.size("blocks") <= 0
    usable = supported & ~empty & ~failed
    c = config.chunking
    cut = decode_files(found, config, registry)
    cut = kept(cut.withColumn("cut", chunk.cut(F.when(usable, F.col("blocks")), F.col("title"), c.strategy, c.max_chars, c.overlap_chars, registry.chunkers)))
    read = cut.drop("cut")
    documents = read.where(usable)

    families = dict(pii=config.security.pii, secrets=config.security.secrets, injection=config.security.prompt_injection, allowed=config.security.allowed)
    chunks = chunk.listed(cut.where(usable), c.strategy)
    by_document = scan.findings(documents.withColumn("text", document_text(F.col("blocks"))), "document_id", "text", **families)
    by_chunk = scan.findings(chunks, "document_id", "text", "id", **families)
    findings = kept(by_document.unionByName(by_chunk))

    secured = scan.summary(by_document, "document_id").select("document_id", F.struct("pii_count", "secret_count", "prompt_injection_score", "labels").alias("security"))
    documents = documents.join(secured, "document_id", "left")
    per_chunk = scan.summary(by_chunk, "chunk_id").select(F.col("chunk_id").alias("id"), F.struct("pii_count", "secret_count", "prompt_injection_score", "labels").alias("security"))
    annotated = quality.annotate_duplicates(chunks).join(per_chunk, "id", "left")

    repeated = quality.duplicate_sources(read, F.col("sha256"), F.col("uri"))
    row = lambda df, code, detail: df.select(F.lit(code).alias("code"), F.col("uri").alias("path"), detail.alias("detail"))
    warnings = repeated.select(F.lit("exact_duplicate_source").alias("code"), F.col("path"), F.col("first_path").alias("detail"))
    warnings = warnings.unionByName(row(read.where(~supported), "unsupported_file", F.col("media_type")))
    errors = read.where(supported).select("uri", F.explode("errors").alias("e"))
    warnings = warnings.unionByName(errors.select(F.col("e.code").alias("code"), F.col("uri").alias("path"), F.concat(F.col("e.severity"), F.lit(": "), F.col("e.message")).alias("detail")))
    warnings = warnings.unionByName(row(read.where(supported & empty), "empty_document", F.lit(None).cast("string")))
    warnings = warnings.unionByName(row(documents.join(chunks, "document_id", "left_anti"), "no_chunks", F.lit(None).cast("string")))
    ratio = quality.duplicate_ratios(chunks).where("dup_member_ratio > 0")
    warnings = warnings.unionByName(ratio.select(F.lit("duplicate_chunk_ratio").alias("code"), F.lit(None).cast("string").alias("path"), F.format_string("%.3f", "dup_member_ratio").alias("detail")))

    counts = counted(cut, supported, empty, failed)
    stamp = config.as_of or datetime.now(tz=UTC).isoformat()
    report = counts.crossJoin(quality.duplicate_ratios(chunks)).withColumn("created_at", F.lit(stamp))
    return Corpus(config, root, read, documents, annotated, findings, warnings, report, counts, (cut, findings) if keep else ())


def evaluate(corpus: Corpus, reference: DataFrame | None = None, metrics: dict | None = None) -> DataFrame:
    """One row: counts, readiness score and its explanation; of the plugins' metrics too, or their errors."""
    counts = quality.evaluation_counts(corpus.documents, corpus.chunks, corpus.findings, corpus.report)
    if reference is not None:
        counts = counts.crossJoin(quality.reference_recall(reference, corpus.documents, "document_id"))
    out = quality.readiness(counts)
    failed = []
    for name, metric in (metrics or {}).items():
        try:
            out = out.crossJoin(metric(corpus.documents, corpus.chunks).select(F.struct("*").alias(f"metric_{name}")))
        except Exception as e:
            failed.append(f"plugin_metric_error:{name}:{e}")
    codes = corpus.warnings.agg(F.array_sort(F.collect_set("code")).alias("warnings"))
    return out.crossJoin(codes).withColumn("warnings", F.concat("warnings", F.array(*map(F.lit, failed)).cast("array<string>")))
