"""Scanning and redaction as DataFrame transformations.

One Arrow UDF finds the spans of all families in a single pass over the text; ids, previews,
summaries and counts are Column expressions and partial aggregations around it.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text as tx
from ..functions.arrow import sliced
from . import patterns

_FIELDS = [("type", pa.string()), ("label", pa.string()), ("severity", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("match", pa.string()), ("confidence", pa.float64())]
_SPANS = pa.list_(pa.struct(_FIELDS))
SPANS = "array<struct<type:string,label:string,severity:string,start:int,end:int,match:string,confidence:double>>"
SPAN_ARRAY = "array<struct<start:int,end:int,label:string>>"

_EXPLAINED = {
    "pii": "Possible {} found by pattern; it may identify a person.",
    "secret": "Possible {} found by pattern; it may grant access.",
    "prompt_injection": "Wording that tries to change the instructions of a language model.",
}
_ADVICE = {
    "pii": "Check whether this personal data is needed here.",
    "secret": "Rotate this secret and remove it from the source.",
    "prompt_injection": "Keep this text apart from the instructions of a model.",
}


def spans(text: Column, pii: bool = True, secrets: bool = True, injection: bool = True, allowed: Iterable[str] = ()) -> Column:
    """Array of matches: personal data, then secrets, then injection phrases, each in order of place."""
    allowed = tuple(allowed)

    def found(texts: pa.Array) -> pa.Array:
        rows = [
            [dict(type=m.type, label=m.label, severity=m.severity, start=m.start, end=m.end, match=m.text, confidence=m.confidence) for m in patterns.find_all(t or "", pii, secrets, injection, allowed)]
            for t in texts.to_pylist()
        ]
        return pa.array(rows, _SPANS)

    return sliced(found, SPANS)(text)


def findings(df: DataFrame, document: str, text: str, chunk: str | None = None, **families) -> DataFrame:
    """A row per match: id, owner, label, span, masked preview, explanation and advice."""
    owner = F.col(chunk) if chunk else F.col(document)
    rows = df.select(F.col(document).alias("document_id"), (F.col(chunk) if chunk else F.lit(None).cast("string")).alias("chunk_id"), owner.alias("_owner"), F.col(text).alias("_text"))
    rows = rows.where(F.col("_text").isNotNull()).select("*", F.posexplode(spans(F.col("_text"), **families)).alias("_i", "m"))
    by_type = lambda table: F.coalesce(*[F.when(F.col("m.type") == k, F.replace(F.lit(v), F.lit("{}"), F.col("m.label"))) for k, v in table.items()])
    return rows.select(
        ids.finding_id(F.col("_owner"), F.col("m.label"), F.col("_i")).alias("id"),
        "document_id",
        "chunk_id",
        F.lit("chunk" if chunk else "document").alias("scope"),
        F.col("m.type").alias("type"),
        F.col("m.label").alias("label"),
        F.col("m.severity").alias("severity"),
        tx.preview(F.col("_text"), F.col("m.start"), F.col("m.end"), F.col("m.type") == "secret").alias("text_preview"),
        F.col("m.start").alias("start"),
        F.col("m.end").alias("end"),
        by_type(_EXPLAINED).alias("explanation"),
        by_type(_ADVICE).alias("recommendation"),
    )


def injection_score(n: Column) -> Column:
    return F.least(F.lit(1.0), n / F.lit(3.0))


def summary(found: DataFrame, key: str) -> DataFrame:
    """Per owner: counts by family, the injection score and the distinct labels in order."""
    of = lambda kind: F.count_if(F.col("type") == kind)
    return found.groupBy(key).agg(
        of("pii").alias("pii_count"),
        of("secret").alias("secret_count"),
        of("prompt_injection").alias("injection_count"),
        injection_score(of("prompt_injection")).alias("prompt_injection_score"),
        F.array_sort(F.collect_set("label")).alias("labels"),
    )


def blocking(severities: Iterable[str] = ()) -> Column:
    """Whether a group of findings keeps what it is about from being used: one of these severities does. By default none does."""
    return F.coalesce(F.bool_or(F.col("severity").isin(*severities)), F.lit(False)) if (severities := tuple(severities)) else F.lit(False)


def redacted(text: Column, found: Column) -> Column:
    """``found`` (array of start, end, label) replaced by placeholders, the latest start first.

    Of equal starts the shorter span goes first; one that reaches into a replaced span is skipped.
    """
    ordered = F.array_sort(F.transform(found, lambda m: F.struct((-m["start"]).alias("a"), (m["end"] - m["start"]).alias("n"), m["label"].alias("label"), m["start"].alias("s"), m["end"].alias("e"))))
    begin = F.struct(text.alias("t"), F.lit(2147483647).alias("last"))

    def splice(state: Column, m: Column) -> Column:
        new = F.concat(F.substring(state["t"], F.lit(1), m["s"]), F.lit("[REDACTED:"), m["label"], F.lit("]"), F.substring(state["t"], m["e"] + 1, F.length(state["t"])))
        fits = (m["e"] <= state["last"]) & (m["e"] <= F.length(state["t"])) & (m["s"] >= 0) & (m["s"] < m["e"])
        return F.struct(F.when(fits, new).otherwise(state["t"]).alias("t"), F.when(fits, m["s"]).otherwise(state["last"]).alias("last"))

    return F.when(F.size(found) > 0, F.aggregate(ordered, begin, splice, lambda s: s["t"])).otherwise(text)


def redact(df: DataFrame, text: str, types: Iterable[str] = ("pii", "secret")) -> DataFrame:
    """``df`` with the matches of these families in ``text`` replaced."""
    types = set(types)
    found = spans(F.col(text), "pii" in types, "secret" in types, "prompt_injection" in types)
    df = df.withColumn("_found", F.when(F.col(text).isNotNull(), found))
    slim = F.transform("_found", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["label"].alias("label")))
    return df.withColumn(text, F.when(F.col("_found").isNotNull(), redacted(F.col(text), slim))).drop("_found")


def redact_found(df: DataFrame, key: str, text: str, found: DataFrame, types: Iterable[str] = ("pii", "secret")) -> DataFrame:
    """``df`` with what was found before, ``found(key, type, label, start, end)``, replaced in ``text``; nothing is scanned again."""
    own = found.where(F.col("type").isin(*types)).groupBy(key).agg(F.collect_list(F.struct("start", "end", "label")).alias("_found"))
    df = df.join(own, key, "left")
    return df.withColumn(text, F.when(F.col("_found").isNotNull(), redacted(F.col(text), F.col("_found").cast(SPAN_ARRAY))).otherwise(F.col(text))).drop("_found")


def rule_matches(text: Column, rule: patterns.Rule) -> Column:
    """All that one rule finds, whatever others find there."""

    def found(texts: pa.Array) -> pa.Array:
        rows = [[m[0] for m in rule.pattern.finditer(t or "") if not rule.check or rule.check(m[0])] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.string()))

    return sliced(found, "array<string>")(text)
