"""Reports of one row, as JSON or HTML."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .errors import CorpusError
from .sources.decoders import BLOCK

MOST_WARNINGS, MOST_FINDINGS = 50, 20


def render_html(title: str, row: dict, warnings: list[str] = (), findings: list[dict] = ()) -> str:
    cell = lambda v: html.escape(str(v))
    table = "".join(f"<tr><th>{cell(k)}</th><td>{cell(v)}</td></tr>" for k, v in row.items())
    lists = "".join(f"<h2>{name}</h2><ul>{''.join(f'<li>{cell(x)}</li>' for x in items)}</ul>" for name, items in (("Warnings", list(warnings)[:MOST_WARNINGS]), ("Findings", list(findings)[:MOST_FINDINGS])) if items)
    return f"<!doctype html><meta charset='utf-8'><title>{cell(title)}</title><h1>{cell(title)}</h1><table>{table}</table>{lists}\n"


def write_report(path: str, title: str, report: DataFrame, findings: DataFrame | None = None) -> None:
    """A one-row report to a ``.json`` or ``.html`` file; at most 50 warnings and 20 findings in the latter."""
    row = json.loads(report.toJSON().first())
    if path.endswith(".json"):
        text = json.dumps(row, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    else:
        some = [r.asDict() for r in findings.orderBy("id").limit(MOST_FINDINGS).collect()] if findings is not None else []
        text = render_html(title, {k: v for k, v in row.items() if k != "warnings"}, row.get("warnings", []), some)
    Path(path).write_text(text, encoding="utf-8")


_FINDING = "id string, document_id string, chunk_id string, scope string, type string, label string, severity string, text_preview string, start int, end int, explanation string, recommendation string"
_SECURITY = "struct<pii_count:bigint,secret_count:bigint,prompt_injection_score:double,labels:array<string>>"
_REF = "struct<document_id:string,block_ids:array<string>,source_uri:string,page_start:int,page_end:int,line_start:int,line_end:int>"
_ERROR = "struct<code:string,message:string,severity:string>"

#: The rows of a pack's members: fields in Spark's notation, and those that are always there.
MODELS: dict[str, tuple[str, tuple[str, ...]]] = {
    "document": (
        f"document_id string, uri string, sha256 string, size_bytes bigint, media_type string, modified_at timestamp, extracted_at timestamp, decoder string, title string, blocks array<{BLOCK}>, "
        f"errors array<{_ERROR}>, metadata map<string,string>, schema_version string, config_hash string, security {_SECURITY}", ("document_id", "uri", "sha256", "size_bytes", "decoder", "blocks", "schema_version"),
    ),
    "chunk": (
        f"id string, document_id string, chunk_index int, text string, title string, section_path array<string>, source_refs array<{_REF}>, token_count_estimate bigint, char_count bigint, metadata map<string,string>, "
        f"score double, labels array<string>, extraction_confidence double, has_citation boolean, duplicate_count bigint, duplicate_score double, duplicate_warning string, security {_SECURITY}",
        ("id", "document_id", "text", "source_refs", "char_count"),
    ),
    "finding": (_FINDING, ("id", "document_id", "type", "label", "severity")),
    "manifest": (
        "pack_id string, schema_version string, created_at string, source_summary struct<source_root:string,document_count:bigint,chunk_count:bigint>, "
        "features struct<has_documents:boolean,has_chunks:boolean,has_security_findings:boolean,has_eval:boolean,has_embeddings:boolean>, checksums map<string,string>, metadata map<string,string>",
        ("pack_id", "schema_version", "created_at", "source_summary", "features", "checksums"),
    ),
}

_JSON_TYPES = {"string": "string", "timestamp": "string", "double": "number", "integer": "integer", "int": "integer", "long": "integer", "bigint": "integer", "boolean": "boolean"}


def _json_schema(kind: DataType) -> dict:
    if isinstance(kind, StructType):
        return {"type": "object", "properties": {f.name: _json_schema(f.dataType) for f in kind.fields}}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": _json_schema(kind.elementType)}
    if isinstance(kind, MapType):
        return {"type": "object", "additionalProperties": _json_schema(kind.valueType)}
    return {"type": _JSON_TYPES[kind.typeName()]} | ({"format": "date-time"} if kind.typeName() == "timestamp" else {})


def schemas(model: str = "all") -> dict[str, dict]:
    """The JSON schema of a pack's documents, chunks, findings and manifest, or of one of these."""
    if model != "all" and model not in MODELS:
        raise CorpusError(f"unknown model: {model}; there are {', '.join(MODELS)}")
    made = {
        name: {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": name, **_json_schema(StructType.fromDDL(ddl)), "required": list(needed), "additionalProperties": False} for name, (ddl, needed) in MODELS.items()
    }
    return made if model == "all" else made[model]


def write_build_report(path: str, report: DataFrame, warnings: DataFrame, findings: DataFrame) -> None:
    """What a build found, to a ``.json`` or ``.html`` file: its counts, and 50 warnings and 20 findings at most in the latter."""
    lines = F.concat_ws(": ", "code", "path", "detail").alias("w")
    if path.endswith(".json"):
        some = [r.w for r in warnings.orderBy("code", "path").select(lines).toLocalIterator()]
    else:
        some = [r.w for r in warnings.orderBy("code", "path").select(lines).limit(MOST_WARNINGS).collect()]
    write_report(path, "Build", report.withColumn("warnings", F.array(*map(F.lit, some)).cast("array<string>")), findings)


def differences(expected, actual, ignored: tuple[str, ...] = ("created_at",), at: str = "") -> list[str]:
    """Where two JSON values differ, keys of these names aside."""
    if isinstance(expected, dict) and isinstance(actual, dict):
        keys = sorted((expected.keys() | actual.keys()) - set(ignored))
        return [d for k in keys for d in (differences(expected[k], actual[k], ignored, f"{at}/{k}") if k in expected and k in actual else [f"{at}/{k}: only in one"])]
    if isinstance(expected, list) and isinstance(actual, list) and len(expected) == len(actual):
        return [d for i, (x, y) in enumerate(zip(expected, actual, strict=True)) for d in differences(x, y, ignored, f"{at}/{i}")]
    return [] if expected == actual else [f"{at}: {expected!r} is {actual!r}"]
