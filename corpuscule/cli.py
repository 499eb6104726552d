"""``python -m corpuscule``: the library's operations as commands, each printing JSON or writing a file."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import build as b
from . import config as cfg
from . import plugins, report
from .errors import CorpusError, PackError
from .operators import export, quality
from .sources import decoders, files, pack, signing


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("corpuscule").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _show(value) -> None:
    print(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, default=str))


def _row(df: DataFrame) -> dict:
    return json.loads(df.toJSON().first())


def _config(a: argparse.Namespace) -> cfg.Config:
    base = cfg.load(a.config) if a.config else cfg.Config()
    return cfg.merged(base, include=tuple(a.include or ()), exclude=tuple(a.exclude or ()), strategy=a.strategy, max_chars=a.max_chars, overlap_chars=a.overlap_chars)


def probe(a) -> int:
    _show(_row(files.probe(files.discover(_session(), a.path), plugins.installed().all_decoders())))
    return 0


def build(a) -> int:
    made = b.build(_session(), a.path, _config(a), plugins.installed())
    key = Path(a.private_key).read_bytes() if a.private_key else None
    try:
        name = pack.write(made, a.output, a.force, key)["pack_id"]
        if a.tables:
            pack.write_tables(made, a.tables, a.force)
        if a.report:
            report.write_build_report(a.report, made.report, made.warnings, made.findings)
        _show({"pack_id": name, **_row(made.report)})
    finally:
        made.release()
    return 0


def inspect(a) -> int:
    opened, labels, findings = pack.Pack(a.pack), set(), 0
    for row in opened.lines("security_findings.jsonl"):
        findings, labels = findings + 1, labels | {row["label"]}
    manifest, made = opened.manifest(), opened.build_report()
    summary = manifest["source_summary"]
    _show({
        "path": a.pack, "manifest": manifest, "documents": summary["document_count"], "chunks": summary["chunk_count"], "avg_chunk_chars": made.get("avg_chars"), "max_chunk_chars": made.get("max_chars"),
        "finding_count": findings, "labels": sorted(labels), "build_warnings": len(made.get("warnings", [])), "has_eval": manifest["features"]["has_eval"], "signed": pack.SIGNATURE in opened.names,
    })
    return 0


def validate(a) -> int:
    opened = pack.Pack(a.pack)
    errors = opened.validate(checksums=not a.skip_checksums)
    warnings = [w["code"] for w in opened.build_report().get("warnings", [])] if not errors else []
    _show({"valid": not errors, "errors": errors, "warnings": warnings})
    return int(bool(errors) or a.strict and bool(warnings))


def _summary(spark: SparkSession, opened: pack.Pack) -> DataFrame:
    found = opened.rows("security_findings.jsonl")
    chunks = opened.table(spark, "chunks.jsonl")
    counts = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.avg("char_count"), F.lit(0.0)).alias("avg_chunk_chars"))
    return counts.withColumns({"documents": F.lit(len(opened.rows("documents.jsonl"))), "findings": F.lit(len(found))})


def diff(a) -> int:
    spark = _session()
    rows = quality.diff(_summary(spark, pack.Pack(a.before)), _summary(spark, pack.Pack(a.after)))
    _show([r.asDict() for r in rows.collect()])
    return 0


def _evaluated(a) -> DataFrame:
    spark, opened = _session(), pack.Pack(a.pack)
    documents, chunks = opened.table(spark, "documents.jsonl"), opened.table(spark, "chunks.jsonl")
    found = opened.table(spark, "security_findings.jsonl") if opened.rows("security_findings.jsonl") else spark.createDataFrame([], "type string")
    r = opened.build_report()
    counts = spark.createDataFrame([(r["discovered"], r["failed"], r["unsupported"], r["empty"])], "discovered long, failed long, unsupported long, empty long")
    out = quality.evaluation_counts(documents, chunks, found, counts)
    if a.reference:
        out = out.crossJoin(quality.reference_recall(pack.Pack(a.reference).table(spark, "documents.jsonl"), documents, "document_id"))
    return quality.readiness(out)


def evaluate(a) -> int:
    if a.suite != "basic" and a.suite not in plugins.installed().suites:
        raise CorpusError(f"unknown suite: {a.suite}")
    made = _evaluated(a) if a.suite == "basic" else plugins.installed().suites[a.suite](a.pack)
    if a.output:
        report.write_report(a.output, "Evaluation", made)
    _show(_row(made))
    return 0


def export_rows(a) -> int:
    spark, opened = _session(), pack.Pack(a.pack)
    name = opened.manifest()["pack_id"]
    text_map = "map<string,string>"
    if a.format == "jsonl":
        ref = "array<struct<document_id:string,block_ids:array<string>,source_uri:string,page_start:int,page_end:int,line_start:int,line_end:int>>"
        rows = export.jsonl_rows(opened.typed(spark, "chunks.jsonl", metadata=text_map, source_refs=ref), a.redact)
    else:
        documents = opened.typed(spark, "documents.jsonl", metadata=text_map, blocks=f"array<{decoders.BLOCK}>")
        made = plugins.installed().exporters | {
            "langchain": lambda d: export.langchain_rows(d, name, a.redact), "llamaindex": lambda d: export.llamaindex_rows(d, name, a.redact), "markdown": lambda d: export.markdown_rows(d, a.redact)
        }
        if a.format not in made:
            raise CorpusError(f"unknown format: {a.format}")
        rows = made[a.format](documents)
    rows.write.mode("overwrite" if a.force else "error").json(a.output)
    return 0


def schemas(a) -> int:
    _show(report.schemas(a.model))
    return 0


def serve(a) -> int:
    raise CorpusError("serving needs an adapter, which isn't part of this library")


def sign(a) -> int:
    opened = pack.Pack(a.pack)
    if a.new_key:
        private, public = signing.key_pair(_session())
        Path(a.key).write_bytes(private)
        Path(a.key + ".pub").write_bytes(public)
    _show({"signature": opened.sign(_session(), Path(a.key).read_bytes())})
    return 0


def verify(a) -> int:
    errors = pack.Pack(a.pack).validate(_session(), Path(a.key).read_bytes())
    _show({"valid": not errors, "errors": errors})
    return int(bool(errors))


def list_plugins(a) -> int:
    r = plugins.installed()
    _show({"decoders": [d.name for d in r.all_decoders()], "chunkers": r.chunker_names(), "exporters": sorted(r.exporters), "metrics": sorted(r.metrics), "suites": sorted({"basic", *r.suites}), "skipped": r.skipped})
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("corpuscule", description=__doc__)
    commands = p.add_subparsers(required=True)

    def command(name: str, run, *places: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        for place in places:
            c.add_argument(place)
        return c

    command("probe", probe, "path")
    c = command("build", build, "path", "output")
    c.add_argument("--config")
    c.add_argument("--include", action="append")
    c.add_argument("--exclude", action="append")
    c.add_argument("--strategy")
    c.add_argument("--max-chars", type=int)
    c.add_argument("--overlap-chars", type=int)
    c.add_argument("--private-key")
    c.add_argument("--report")
    c.add_argument("--tables")
    c.add_argument("--force", action="store_true")
    command("inspect", inspect, "pack")
    c = command("validate", validate, "pack")
    c.add_argument("--strict", action="store_true")
    c.add_argument("--skip-checksums", action="store_true")
    command("diff", diff, "before", "after")
    for name in ("eval", "report"):
        c = command(name, evaluate, "pack")
        c.add_argument("--suite", default="basic")
        c.add_argument("--reference")
        c.add_argument("--output")
    c = command("export", export_rows, "pack", "output")
    c.add_argument("--format", default="jsonl")
    c.add_argument("--redact", action="store_true")
    c.add_argument("--force", action="store_true")
    command("schemas", schemas).add_argument("--model", default="all")
    command("serve", serve)
    command("sign", sign, "pack", "key").add_argument("--new-key", action="store_true")
    command("verify", verify, "pack", "key")
    command("plugins", list_plugins)
    return p


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        return a.run(a)
    except (CorpusError, PackError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
