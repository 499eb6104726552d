"""Duplicates, statistics, readiness score, validation, provenance and comparison of corpora.

All are joins and partial aggregations; each report is one row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text as tx
from ..functions.arrow import sliced


def annotate_duplicates(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Adds how many chunks have the same text, the share that is in excess, and a warning.

    Counted are hashes, so that no text is shuffled for it and a boilerplate's are added up where they
    stand; only texts that occur more than once are joined back.
    """
    h = F.xxhash64(F.coalesce(text, F.lit(""))), F.sha2(text, 256)
    counts = chunks.select(h[0].alias("_x"), h[1].alias("_h")).groupBy("_x", "_h").agg(F.count(F.lit(1)).alias("duplicate_count")).where("duplicate_count > 1")
    rows = chunks.withColumns({"_x": h[0], "_h": h[1]}).join(counts, ["_x", "_h"], "left").drop("_x", "_h")
    n = F.coalesce("duplicate_count", F.lit(1).cast("long"))
    return rows.withColumn("duplicate_count", n).withColumns(
        {
            "duplicate_score": (F.col("duplicate_count") - 1) / F.col("duplicate_count"),
            "duplicate_warning": F.when(F.col("duplicate_count") > 1, "duplicate_chunk_exact"),
        }
    )


def duplicate_ratios(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: the share of chunks in a duplicate group, and the share in excess of one per text."""
    groups = chunks.groupBy(F.sha2(text, 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    ratio = lambda x: F.coalesce(x / F.nullif(total, F.lit(0)), F.lit(0.0))
    return groups.agg(ratio(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))).alias("dup_member_ratio"), ratio(total - F.count(F.lit(1))).alias("dup_excess_ratio"))


def duplicate_sources(files: DataFrame, content_hash: Column, path: Column) -> DataFrame:
    """Files whose content stands at an earlier path already, and that path.

    A path that stands twice with the same content is a duplicate of itself once less often than it stands.
    """
    rows = files.select(path.alias("path"), content_hash.alias("h"))
    paths = rows.groupBy("h", "path").agg(F.count(F.lit(1)).alias("n"))
    firsts = paths.groupBy("h").agg(F.min("path").alias("first_path"), F.sum("n").alias("all")).where(F.col("all") > 1).drop("all")
    found = paths.join(firsts, "h").withColumn("n", F.col("n") - (F.col("path") == F.col("first_path")).cast("long"))
    return found.where("n > 0").select(F.explode(F.array_repeat("path", F.col("n").cast("int"))).alias("path"), "first_path")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: least, most, mean, upper median, interpolated median and sum of the chunks' lengths."""
    return chunks.agg(*length_stats(F.lit(True)))


def length_stats(there: Column) -> list[Column]:
    """Aggregates of ``char_count``; ``there`` says which rows are chunks, the others have a null."""
    n = F.col("char_count")
    return [
        F.count_if(there).alias("chunk_count"),
        F.coalesce(F.min(n), F.lit(0)).cast("long").alias("min_chars"),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_chars"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_chars"),
        F.coalesce(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY char_count DESC)"), F.lit(0)).cast("long").alias("median_chars"),
        F.coalesce(F.median(n), F.lit(0.0)).alias("median_interpolated"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_chars"),
    ]


def _percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def readiness(counts: DataFrame) -> DataFrame:
    """Adds the readiness score and its explanation to a row of counts.

    Needs ``document_count, discovered, failed, unsupported, empty_documents, uncited_ratio,
    duplicate_ratio, pii, secrets, avg_chars``; ``recall`` where there is a reference to compare with.
    The score starts at 100, is rounded half to even and stays within 0 and 100.
    """
    c = F.col
    files = F.greatest(F.lit(1), c("discovered"))
    failed, unsupported = c("failed") / files, c("unsupported") / files
    empty = c("empty_documents") / F.greatest(F.lit(1), c("document_count") + c("empty_documents"))
    recall = F.coalesce(c("recall"), F.lit(1.0)) if "recall" in counts.columns else F.lit(1.0)
    graded = [
        (20 * failed, F.concat(F.lit("files that failed "), _percent(failed))),
        (15 * empty, F.concat(F.lit("empty documents "), _percent(empty))),
        (15 * c("uncited_ratio"), F.concat(F.lit("chunks without citation "), _percent(c("uncited_ratio")))),
        (10 * c("duplicate_ratio"), F.concat(F.lit("duplicate chunks "), _percent(c("duplicate_ratio")))),
        (30 * (1 - recall), F.concat(F.lit("documents missing against the reference "), _percent(1 - recall))),
    ]
    flat = [
        (c("pii") > 0, "personal data to review"),
        (c("secrets") > 0, "secrets to review"),
        (unsupported > 0.2, "many unsupported files"),
        ((c("avg_chars") != 0) & ~c("avg_chars").between(300, 5000), "mean chunk length outside 300 to 5000"),
    ]
    score, lines = F.lit(100.0), []
    for loss, why in graded:
        score = score - loss
        lines.append(F.when(loss > 0, F.concat(F.format_string("-%.1f: ", loss), why)))
    for bad, why in flat:
        score = score - F.when(bad, 10.0).otherwise(0.0)
        lines.append(F.when(bad, f"-10.0: {why}"))
    whole = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(score)))
    return counts.withColumns({"readiness_score": whole.cast("long"), "score_explanation": F.array_compact(F.array(*lines))})


def evaluation_counts(documents: DataFrame, chunks: DataFrame, findings: DataFrame, report: DataFrame) -> DataFrame:
    """One row with all that the readiness score and the evaluation report need.

    Each table is read once: chunks are counted by text first, which gives the duplicates, and the
    groups' counts added up.
    """
    n = [F.count_if(F.col("type") == k).alias(x) for k, x in (("pii", "pii"), ("secret", "secrets"), ("prompt_injection", "injections"))]
    return _evaluated(documents, chunks.withColumns({x: F.lit(0) for x in ("pii", "secrets", "injections")}), report).drop("pii", "secrets", "injections").crossJoin(findings.agg(*n))


def scanned_counts(documents: DataFrame, chunks: DataFrame, found: Column, report: DataFrame) -> DataFrame:
    """The same, of chunks that are scanned on the way; ``found`` are their matches."""
    of = lambda kind: F.size(F.filter("_found", lambda m: m["type"] == kind))
    rows = chunks.withColumn("_found", found).withColumns({"pii": of("pii"), "secrets": of("secret"), "injections": of("prompt_injection")}).drop("_found")
    return _evaluated(documents, rows, report)


def _evaluated(documents: DataFrame, chunks: DataFrame, report: DataFrame) -> DataFrame:
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    filled = F.exists("blocks", lambda b: F.trim(F.coalesce(F.nullif(b["text"], F.lit("")), b["markdown"], F.lit(""))) != "")
    d = documents.agg(F.count(F.lit(1)).alias("document_count"), F.count_if(~F.coalesce(filled, F.lit(False))).alias("blank_documents"))
    groups = chunks.groupBy(F.sha2("text", 256).alias("h"), "char_count").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(blank).alias("blank"),
        F.count_if(F.size("source_refs") < 1).alias("uncited"),
        *[F.sum(x).cast("long").alias(x) for x in ("pii", "secrets", "injections")],
    )
    n, total = F.sum("n"), lambda x: F.coalesce(F.sum(x), F.lit(0).cast("long"))
    ratio = lambda x: F.coalesce(x / F.nullif(n, F.lit(0)), F.lit(0.0))
    c = groups.agg(
        total("n").alias("chunk_count"),
        total("blank").alias("empty_chunk_count"),
        total("uncited").alias("chunks_without_source_refs"),
        ratio(F.sum("uncited")).alias("uncited_ratio"),
        ratio(F.sum(F.col("char_count") * F.col("n"))).alias("avg_chars"),
        F.coalesce(F.expr("percentile(char_count, 0.5, n)"), F.lit(0.0)).alias("median_chars"),
        F.coalesce(F.max("char_count"), F.lit(0)).alias("max_chars"),
        ratio(n - F.count_if(F.col("h").isNotNull())).alias("duplicate_ratio"),
        *[total(x).alias(x) for x in ("pii", "secrets", "injections")],
    )
    out = d.crossJoin(c).crossJoin(report.select("discovered", "failed", "unsupported", "empty"))
    return out.withColumn("empty_documents", F.col("blank_documents") + F.col("empty")).drop("blank_documents", "empty")


def reference_recall(reference: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """One row: how many reference keys there are, how many are missing now, the share found."""
    ref = reference.select(key).distinct()
    known = current.select(key).distinct().withColumn("_there", F.lit(1))
    joined = ref.join(known, key, "left")
    n, missing = F.count(F.lit(1)), F.count_if(F.col("_there").isNull())
    return joined.agg(n.alias("reference_count"), missing.alias("missing_count"), F.coalesce((n - missing) / F.nullif(n, F.lit(0)), F.lit(1.0)).alias("recall"))


def missing_keys(reference: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return reference.select(key).distinct().join(current.select(key), key, "left_anti")


def orphan_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document isn't there."""
    return chunks.join(documents.select("document_id"), "document_id", "left_anti")


def validate_documents(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row ``(document_id, rule)`` per violation.

    ``documents(document_id, uri)`` and ``blocks(document_id, block_id, parent_id, children_ids)``.
    """
    of = lambda df, rule: df.select("document_id", F.lit(rule).alias("rule"))
    out = of(documents.where(~F.coalesce(F.col("document_id").startswith("doc_"), F.lit(False))), "id_prefix")
    out = out.unionByName(of(documents.where(F.coalesce(F.col("uri"), F.lit("")) == ""), "uri_empty"))
    out = out.unionByName(of(documents.join(blocks, "document_id", "left_anti"), "no_blocks"))
    out = out.unionByName(of(blocks.groupBy("document_id", "block_id").count().where("count > 1"), "duplicate_block_id"))
    known = blocks.select("document_id", F.col("block_id").alias("other")).distinct()
    parents = blocks.where("parent_id is not null").select("document_id", F.col("parent_id").alias("other"))
    children = blocks.select("document_id", F.explode("children_ids").alias("other"))
    out = out.unionByName(of(parents.join(known, ["document_id", "other"], "left_anti"), "parent_missing"))
    return out.unionByName(of(children.join(known, ["document_id", "other"], "left_anti"), "child_missing"))


def validate_chunks(chunks: DataFrame) -> DataFrame:
    """A row ``(id, rule)`` per violation of ``chunks(id, document_id, text, char_count, n_refs)``, in one pass."""
    c = F.col
    rules = [
        (~F.coalesce(c("id").startswith("chk_"), F.lit(False)), "id_prefix"),
        (~F.coalesce(c("document_id").startswith("doc_"), F.lit(False)), "document_id_prefix"),
        (tx.stripped(F.coalesce(c("text"), F.lit(""))) == "", "text_empty"),
        (~F.coalesce(c("char_count") == F.length("text"), F.lit(False)), "char_count_mismatch"),
        (F.coalesce(c("n_refs"), F.lit(0)) == 0, "no_source_refs"),
    ]
    return chunks.select("id", F.explode(F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))).alias("rule"))


def validate_integrity(manifest: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row ``(key, rule)`` per disagreement of a manifest's counts, and per chunk of a missing document.

    Documents and chunks are read once each: the chunks whose document is missing and the number of all come from one grouping.
    A manifest that was itself counted from the chunks reads them once more.
    """
    known = documents.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"))
    there = F.coalesce(F.col("_n") > 0, F.lit(False))
    rows = chunks.select("id", "document_id").join(known, "document_id", "left").select(F.when(~there, F.struct("id")).alias("_o"), F.lit(1).cast("long").alias("_c"))
    none = chunks.sparkSession.range(1).select(F.lit(None).cast(rows.schema["_o"].dataType).alias("_o"), F.lit(0).cast("long").alias("_c"))  # so that there is a total where there is no chunk
    found = rows.unionByName(none).groupingSets([["_o"], []], "_o").agg(F.sum("_c").alias("n"), F.grouping("_o").alias("_all"))
    pair = lambda key, rule: F.struct(key.cast("string").alias("key"), F.lit(rule).alias("rule"))
    head = manifest.agg(F.collect_list(F.struct("document_count", "chunk_count")).alias("_m")).crossJoin(documents.agg(F.count(F.lit(1)).alias("_d")))
    wrong = F.concat(
        F.transform(F.filter("_m", lambda m: m["document_count"] != F.col("_d")), lambda m: pair(m["document_count"], "document_count_mismatch")),
        F.transform(F.filter("_m", lambda m: m["chunk_count"] != F.col("n")), lambda m: pair(m["chunk_count"], "chunk_count_mismatch")),
    )
    missing = F.array_repeat(pair(F.col("_o.id"), "document_missing"), F.when(F.col("_o").isNotNull(), F.col("n")).otherwise(0).cast("int"))
    return found.crossJoin(F.broadcast(head)).select(F.inline(F.when(F.col("_all") == 1, wrong).otherwise(missing)))


def provenance(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """A row per citation of a chunk whose document is known: chunk, section, document, title, source."""
    refs = chunks.select(F.col("id").alias("chunk_id"), "section_path", F.explode("source_refs").alias("ref"))
    refs = refs.select("chunk_id", "section_path", F.col("ref.document_id").alias("document_id"), F.col("ref.block_ids").alias("block_ids"))
    return refs.join(documents.select("document_id", F.col("title").alias("document_title"), F.col("uri").alias("source_uri")), "document_id")


def _within(cited: pa.Array, blocks: pa.Array) -> pa.Array:
    out = []
    for chunks, own in zip(cited.to_pylist(), blocks.to_pylist(), strict=True):
        bare = lambda x: "".join((x or "").split())
        texts = {b["block_id"]: (bare(b["text"] or b["markdown"]), bare(b["shown"])) for b in own or ()}
        pools: dict[tuple, list] = {}
        found = []
        for c in sorted(chunks, key=lambda c: c["id"]):
            names = tuple(c["block_ids"] or ())
            if names not in pools:
                both = ["".join(texts[n][side] for n in names if n in texts) for side in (0, 1)]
                pools[names] = [[both[0], 0], [both[1], 0]]
            text, there = bare(c["text"]), False
            for pool in pools[names]:
                # a document's chunks follow each other: the search goes on where the last one was found
                at = pool[0].find(text, pool[1])
                at = pool[0].find(text) if at < 0 and pool[1] else at
                if at >= 0:
                    pool[1], there = at, True
                    break
            found.append({"id": c["id"], "faithful": there})
        out.append(found)
    return pa.array(out, pa.list_(pa.struct([("id", pa.string()), ("faithful", pa.bool_())])))


def faithfulness(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per chunk, whether its text stands, white space aside, in the blocks of one document that it cites.

    ``chunks(id, document_id, text, source_refs)``, ``blocks(document_id, block_id, type, text, markdown)``; of a
    block either its text counts or what a chunk shows of it, which is the Markdown of code and tables.
    A document's blocks and chunks meet in one row, each shuffled once however many chunks cite a block.
    """
    text = F.coalesce(F.nullif("text", F.lit("")), "markdown", F.lit(""))
    shown = F.when(F.col("type").isin("code", "table"), F.coalesce(F.nullif("markdown", F.lit("")), text)).otherwise(text)
    return faithful_rows(chunks, blocks.groupBy("document_id").agg(F.collect_list(F.struct("block_id", "text", "markdown", shown.alias("shown"))).alias("_b")))


def faithful_rows(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The same of ``documents(document_id, _b)``, a row each with an array of ``block_id, text, markdown, shown``."""
    refs = chunks.select("id", "text", F.explode("source_refs").alias("r")).select("id", "text", F.col("r.document_id").alias("document_id"), F.col("r.block_ids").alias("block_ids"))
    refs = refs.groupBy("document_id", "id").agg(F.any_value("text").alias("text"), F.flatten(F.collect_list("block_ids")).alias("block_ids"))
    cited = refs.groupBy("document_id").agg(F.collect_list(F.struct("id", "text", "block_ids")).alias("_c"))
    joined = cited.join(documents.select("document_id", "_b"), "document_id", "left")
    within = sliced(_within, "array<struct<id:string,faithful:boolean>>")
    return joined.select(F.inline(within("_c", "_b"))).groupBy("id").agg(F.bool_or("faithful").alias("faithful"))


def cited_blocks(documents: DataFrame) -> DataFrame:
    """``document_id, _b`` for ``faithful_rows``, of documents that have their blocks in an array."""
    text = lambda b: F.coalesce(F.nullif(b["text"], F.lit("")), b["markdown"], F.lit(""))
    shown = lambda b: F.when(b["type"].isin("code", "table"), F.coalesce(F.nullif(b["markdown"], F.lit("")), text(b))).otherwise(text(b))
    named = lambda b: F.struct(ids.block_id(F.col("document_id"), b["index"]).alias("block_id"), b["text"].alias("text"), b["markdown"].alias("markdown"), shown(b).alias("shown"))
    return documents.select("document_id", F.transform("blocks", named).alias("_b"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """A row per measure of two one-row summaries: before, after, change."""
    names = before.columns
    both = before.select(*[F.col(n).alias(f"_b_{n}") for n in names]).crossJoin(after.select(*[F.col(n).alias(f"_a_{n}") for n in names]))
    rows = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"_b_{n}").cast("double").alias("before"), F.col(f"_a_{n}").cast("double").alias("after")) for n in names])
    return both.select(F.inline(rows)).withColumn("change", F.col("after") - F.col("before"))
