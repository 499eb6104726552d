"""Content-addressed keys, as Column expressions and for single values."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(uri: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(uri, "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", ""))


def _short(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16))


def document_id(sha256: Column, path: Column) -> Column:
    """From the content's hash and the relative path."""
    return _short("doc_", sha256, slug(path))


def block_id(document: Column, index: Column) -> Column:
    return F.format_string("blk_%s_%06d", F.regexp_replace(document, "^doc_", ""), index)


def chunk_id(document: Column, strategy: Column, index: Column) -> Column:
    return F.format_string("chk_%s_%s_%06d", F.regexp_replace(document, "^doc_", ""), strategy, index)


def finding_id(owner: Column, label: Column, index: Column) -> Column:
    """``owner`` is the chunk, or the document where there is none."""
    return _short("fnd_", owner, slug(label), index.cast("string"))


def checksum(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def json_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def pack_id(source_root: str, documents: list[str]) -> str:
    return "ctxpack_" + json_hash({"source_root": source_root, "docs": documents})[:16]


def slug_of(uri: str) -> str:
    return re.sub("[^a-zA-Z0-9_-]+", "_", uri).strip("_").lower()
