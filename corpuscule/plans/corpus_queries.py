"""Queries over chunks and whole corpora: chunkers, duplicates, scores, joins, search and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import build, config
from ..functions import ids
from ..operators import chunk, export, quality, scan, search
from ..sources import decoders, files
from . import sql_scan
from .tables import SQL_DOCS, SQL_SLUG, chunks, corpus, sql_chunk_id, table, texts, with_chunks, with_docs
from .text_queries import SQL_MARKDOWN, _markdown

Q: dict = {}
SQL: dict[str, str] = {}

PACK = "ctxpack_0000000000000000"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(with_chunks("SELECT doc_id, n AS part_index, part FROM (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS n FROM pieces WHERE part <> '')"))
def split_large_text(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import text as tx

    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(chunk.split_large_text(tx.normalize(F.col("text")))).alias("part_index", "part"))
    return rows.select("doc_id", F.col("part_index").cast("long").alias("part_index"), "part").where("part <> ''")


@query(with_chunks(f"SELECT {sql_chunk_id()} AS id, document_id, text, length(text) AS char_count FROM chunks"))
def fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("id", "document_id", "text", "char_count")


@query(with_chunks(f"SELECT {sql_chunk_id()} AS id, 'fixed' AS chunker, 'Document ' || doc_id AS title, CASE WHEN n = 0 THEN 0 ELSE greatest(1, round_even(n * 1.3::DOUBLE, 0)) END::BIGINT AS tokens FROM (SELECT *, len(regexp_extract_all(text, '\\S+')) AS n FROM chunks)"))
def chunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("id", F.col("metadata")["chunker"].alias("chunker"), "title", F.col("token_count_estimate").alias("tokens"))


def _heading(spark: SparkSession, sf: str) -> DataFrame:
    rows = _markdown(spark, sf).select("conv_id", F.encode("markdown", "UTF-8").alias("content"))
    rows = rows.withColumn("uri", F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".md"))).withColumn("document_id", ids.document_id(F.sha2("content", 256), F.col("uri")))
    return rows.select("conv_id", "document_id", "uri", F.inline(F.array(decoders.decoded(F.col("content"), F.col("uri"), F.lit("markdown")))))


#: Sections of the Markdown files: a turn each, the first with the file's heading, and their place.
_SECTIONS = f"""WITH {SQL_MARKDOWN}, named AS (
    SELECT conv_id, 'doc_' || substr(sha256(sha256(markdown) || ':chat_' || conv_id || '_md'), 1, 16) AS document_id FROM markdown
  ), sections AS (
    SELECT conv_id, k, n, role, CASE WHEN k = 1 THEN 'Conversation' || chr(10) || chr(10) ELSE '' END || role || chr(10) || chr(10) || CASE WHEN text = '' THEN '' ELSE text || chr(10) || chr(10) END
      || 'turn *' || turn || '*' || chr(10) || chr(10) || 'of ' || role || chr(10) || chr(10) || code AS text,
      4 + length(raw) - length(replace(raw, chr(10), '')) + 4 - CASE WHEN k = n THEN 1 ELSE 0 END + 0 AS height, text = '' AS bare FROM codes
  ), placed AS (
    SELECT *, 2 + sum(height) OVER (PARTITION BY conv_id ORDER BY k) AS line_end, CASE WHEN k = 1 THEN 1 ELSE 3 + sum(height) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS line_start
    FROM sections JOIN named USING (conv_id)
  )"""


@query(_SECTIONS + """ SELECT 'chk_' || substr(document_id, 5) || '_heading_' || lpad((k - 1)::VARCHAR, 6, '0') AS id, document_id, text, role AS title, 'Conversation / ' || role AS section,
  CASE WHEN length(text) < 100 THEN 0.8 ELSE 1.0 END::DOUBLE AS score, concat_ws(',', CASE WHEN length(text) < 100 THEN 'short_chunk' END, CASE WHEN length(text) > 2700 THEN 'large_chunk' END) AS labels, length(text) AS char_count FROM placed""")
def heading_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of conversations written as Markdown."""
    rows = chunk.chunked(_heading(spark, sf))
    return rows.select("id", "document_id", "text", "title", F.array_join("section_path", " / ").alias("section"), "score", F.array_join("labels", ",").alias("labels"), "char_count")


@query(_SECTIONS + """ SELECT document_id, k - 1 AS chunk_index, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end,
  round((4 + CASE WHEN k = 1 THEN 1 ELSE 0 END - CASE WHEN bare THEN 1 ELSE 0 END + CASE WHEN k = n THEN 0.8 ELSE 1.0 END) / (5 + CASE WHEN k = 1 THEN 1 ELSE 0 END - CASE WHEN bare THEN 1 ELSE 0 END), 6)::DOUBLE AS confidence FROM placed""")
def chunk_places(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that a section's blocks span, and how sure they are on average."""
    ref = F.col("source_refs")[0]
    rows = chunk.chunked(_heading(spark, sf))
    long = lambda x: x.cast("long")
    return rows.select("document_id", long(F.col("chunk_index")).alias("chunk_index"), long(ref["line_start"]).alias("line_start"), long(ref["line_end"]).alias("line_end"), F.round("extraction_confidence", 6).alias("confidence"))


#: Turns with an empty line between, cut at such a line in the latter half of 400 characters, else at a space, with 40 shared.
_CUT = """CASE WHEN size - P <= 400 THEN size ELSE
    CASE WHEN strpos(reverse(substr(text, P + 1, 400)), chr(10) || chr(10)) BETWEEN 1 AND 197 THEN P + 399 - strpos(reverse(substr(text, P + 1, 400)), chr(10) || chr(10))
      WHEN strpos(reverse(substr(text, P + 1, 400)), ' ') BETWEEN 1 AND 399 THEN P + 400 - strpos(reverse(substr(text, P + 1, 400)), ' ') ELSE P + 400 END END::BIGINT"""


@query(f"""WITH RECURSIVE joined AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
  walk AS (SELECT conv_id, text, 0::BIGINT AS n, 0::BIGINT AS pos, size, {_CUT.replace('P', '0')} AS cut FROM (SELECT conv_id, text, length(text)::BIGINT AS size FROM joined)
    UNION ALL SELECT conv_id, text, n + 1, pos2, size, {_CUT.replace('P', 'pos2')} FROM (SELECT *, CASE WHEN cut - 40 > pos THEN cut - 40 ELSE cut END AS pos2 FROM walk WHERE cut < size))
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1 AS part_index, part FROM (
    SELECT conv_id, n, CASE WHEN n = 0 AND size <= 400 THEN text ELSE trim(substr(text, pos + 1, cut - pos), ' ' || chr(10)) END AS part FROM walk) WHERE part <> ''""")
def split_blank_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Whole conversations in small parts."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    whole = F.array_join(F.transform("t", lambda t: t["text"]), "\n\n")
    rows = rows.select("conv_id", F.posexplode(chunk.split_large_text(whole, 400, 40)).alias("part_index", "part"))
    return rows.select("conv_id", F.col("part_index").cast("long").alias("part_index"), "part")


@query("SELECT conv_id, 1 + count(*) AS headings, count(*) FILTER (WHERE turn_text <> '') AS paragraphs FROM (SELECT conv_id, trim(text, ' ' || chr(10)) AS turn_text FROM conversations) GROUP BY conv_id")
def markdown_block_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _heading(spark, sf)
    of = lambda kind: F.size(F.filter("blocks", lambda b: b["type"] == kind)).cast("long")
    return rows.select("conv_id", of("heading").alias("headings"), of("paragraph").alias("paragraphs"))


_STATS = """SELECT count(*) AS chunk_count, min(n) AS min_chars, max(n) AS max_chars, avg(n) AS avg_chars,
  percentile_disc(0.5) WITHIN GROUP (ORDER BY n DESC) AS median_chars, median(n)::DOUBLE AS median_interpolated, sum(n)::BIGINT AS total_chars FROM (SELECT length(text) AS n FROM chunks)"""


def _built(spark: SparkSession, sf: str, keep: bool = True) -> build.Corpus:
    """A build from files made of documents: half of them texts, the others blank, no JSON, or of no known kind."""
    kind = F.col("doc_id") % 6
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    rows = table(spark, sf, "documents").select(
        F.concat(name, F.when(kind == 4, ".json").when(kind == 5, ".xyz").otherwise(".txt")).alias("rel_path"), F.encode(F.when(kind == 3, " \n").otherwise(F.col("text")), "UTF-8").alias("content")
    )
    ext = files.extension(F.col("rel_path"))
    found = rows.select(
        F.col("rel_path").alias("path"), "rel_path", F.regexp_extract("rel_path", "([^/]*)$", 1).alias("filename"), ext.alias("ext"), files.media_type(ext).alias("media_type"), F.length("content").cast("long").alias("length"),
        F.lit(None).cast("timestamp").alias("modified_at"), "content",
    )
    return build.build_from(found, "documents", config.Config(chunking=config.ChunkingConfig(strategy="fixed"), as_of="2026-01-01T00:00:00"), keep=keep)


#: Those files, and the chunks of the texts among them.
_FILES = """, files AS (SELECT doc_id, doc_id % 6 AS kind, source || '/' || doc_id || CASE doc_id % 6 WHEN 4 THEN '.json' WHEN 5 THEN '.xyz' ELSE '.txt' END AS path, CASE WHEN doc_id % 6 = 3 THEN ' ' || chr(10) ELSE raw END AS content, text FROM docs),
  kept AS (SELECT text FROM chunks WHERE doc_id % 6 < 3)"""


@query(with_chunks(_FILES + """ SELECT count(*) AS discovered, count(*) FILTER (WHERE kind < 5) AS supported, count(*) FILTER (WHERE kind = 5) AS unsupported,
    count(*) FILTER (WHERE kind IN (3, 4) OR kind < 3 AND text = '') AS failed, count(*) FILTER (WHERE kind IN (3, 4) OR kind < 3 AND text = '') AS empty, count(*) FILTER (WHERE kind < 3 AND text <> '') AS document_count,
    (SELECT count(*) FROM kept) AS chunk_count, (SELECT max(length(text)) FROM kept) AS max_chars FROM files"""))
def build_counters(spark: SparkSession, sf: str) -> DataFrame:
    """What a build reports; the files are read, decoded and cut once, and none of it is kept."""
    names = ("discovered", "supported", "unsupported", "failed", "empty", "document_count", "chunk_count", "max_chars")
    return _built(spark, sf, keep=False).counts.select(*[F.col(n).cast("long").alias(n) for n in names])


@query(with_chunks(_FILES + """, codes AS (
    SELECT path, unnest(CASE kind WHEN 3 THEN ['empty_text', 'empty_document'] WHEN 4 THEN ['json_decode_failed', 'json_empty', 'empty_document'] WHEN 5 THEN ['unsupported_file'] END) AS code FROM files WHERE kind > 2
    UNION ALL SELECT path, unnest(['empty_text', 'empty_document']) FROM files WHERE kind < 3 AND text = ''
    UNION ALL SELECT path, 'exact_duplicate_source' FROM (SELECT path, row_number() OVER (PARTITION BY content ORDER BY path) AS n FROM files) WHERE n > 1)
  SELECT code, path FROM codes UNION ALL SELECT 'duplicate_chunk_ratio', NULL FROM (SELECT count(*) AS n, count(DISTINCT text) AS d FROM kept) WHERE n > d"""))
def build_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """What a build warns of, file by file."""
    return _built(spark, sf).warnings.select("code", "path")


@query(with_chunks(f"""{_FILES}, {sql_scan.findings("SELECT doc_id::VARCHAR AS k, text AS t FROM docs WHERE doc_id % 6 < 3 UNION ALL SELECT doc_id || '#' || chunk_index, text FROM chunks WHERE doc_id % 6 < 3")}
  SELECT CASE WHEN contains(k, '#') THEN 'chunk' ELSE 'document' END AS scope, label, count(*) AS n FROM found GROUP BY ALL"""))
def build_findings(spark: SparkSession, sf: str) -> DataFrame:
    """A build's findings in documents and in chunks, together."""
    return _built(spark, sf).findings.groupBy("scope", "label").agg(F.count(F.lit(1)).alias("n"))


@query(with_chunks(_STATS))
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return quality.chunk_stats(chunks(spark, sf))


@query(with_docs("SELECT uri AS path, first_path FROM (SELECT uri, first_value(uri) OVER w AS first_path, row_number() OVER w AS k FROM docs WINDOW w AS (PARTITION BY sha ORDER BY uri)) WHERE k > 1"))
def dup_sources(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_sources(texts(spark, sf), F.col("sha256"), F.col("uri"))


@query(with_chunks(f"SELECT {sql_chunk_id()} AS id, c AS duplicate_count, (c - 1) / c::DOUBLE AS duplicate_score, CASE WHEN c > 1 THEN 'duplicate_chunk_exact' END AS duplicate_warning FROM (SELECT *, count(*) OVER (PARTITION BY text) AS c FROM chunks)"))
def dup_annotation(spark: SparkSession, sf: str) -> DataFrame:
    return quality.annotate_duplicates(chunks(spark, sf)).select("id", "duplicate_count", "duplicate_score", "duplicate_warning")


@query(with_chunks("SELECT sum(CASE WHEN n > 1 THEN n ELSE 0 END)::DOUBLE / sum(n) AS dup_member_ratio, (sum(n) - count(*))::DOUBLE / sum(n) AS dup_excess_ratio FROM (SELECT text, count(*) AS n FROM chunks GROUP BY text)"))
def dup_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_ratios(chunks(spark, sf))


def _report(spark: SparkSession, sf: str) -> DataFrame:
    """A build's counts, from tables that have such numbers: labels of bad and toxic rows, pages, and short texts."""
    docs, labels, pages = (table(spark, sf, x) for x in ("documents", "labels", "pages"))
    failed = labels.agg(F.count_if(F.col("quality") == 0).alias("failed"), F.count_if(F.col("toxic") == 1).alias("unsupported"))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") < 40).alias("empty")).crossJoin(failed).crossJoin(pages.agg(F.count(F.lit(1)).alias("m"))).select(
        (F.col("n") + F.col("m")).alias("discovered"), "failed", "unsupported", "empty"
    )


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    recall = quality.reference_recall(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")
    made = quality.scanned_counts(corpus(spark, sf), chunks(spark, sf), scan.spans(F.col("text")), _report(spark, sf))
    return made.crossJoin(recall.select("recall"))


#: What the score is made of, and each loss.
_LOSSES = f"""{sql_scan.findings(f"SELECT {sql_chunk_id()} AS k, text AS t FROM chunks")},
  counts AS (SELECT (SELECT count(*) FROM docs) AS document_count, count(*) AS chunk_count, avg(length(text)) AS avg_chars, median(length(text))::DOUBLE AS median_chars, (count(*) - count(DISTINCT text))::DOUBLE / count(*) AS duplicate_ratio,
    (SELECT count(*) FROM found WHERE type = 'pii') AS pii, (SELECT count(*) FROM found WHERE type = 'secret') AS secrets, (SELECT count(*) FROM docs) + (SELECT count(*) FROM pages) AS discovered,
    (SELECT count(*) FROM labels WHERE quality = 0) AS failed, (SELECT count(*) FROM labels WHERE toxic = 1) AS unsupported,
    (SELECT count(*) FROM documents WHERE length(text) < 40) + (SELECT count(*) FROM docs WHERE text = '') AS empty_documents,
    (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents))::DOUBLE / (SELECT count(DISTINCT doc_id) FROM documents) AS recall FROM chunks),
  losses AS (SELECT *, failed / discovered::DOUBLE AS f, empty_documents / (document_count + empty_documents)::DOUBLE AS e, unsupported / discovered::DOUBLE AS u FROM counts)"""


@query(with_chunks(f""", {_LOSSES} SELECT document_count, chunk_count, avg_chars, median_chars, pii, secrets, duplicate_ratio, failed, empty_documents, greatest(0, least(100, round_even(
    100 - 20 * f - 15 * e - 10 * duplicate_ratio - 30 * (1 - recall) - CASE WHEN pii > 0 THEN 10 ELSE 0 END - CASE WHEN secrets > 0 THEN 10 ELSE 0 END - CASE WHEN u > 0.2 THEN 10 ELSE 0 END
    - CASE WHEN avg_chars <> 0 AND avg_chars NOT BETWEEN 300 AND 5000 THEN 10 ELSE 0 END, 0)))::BIGINT AS readiness_score FROM losses"""))
def rag_readiness(spark: SparkSession, sf: str) -> DataFrame:
    return quality.readiness(_counts(spark, sf)).select("document_count", "chunk_count", "avg_chars", "median_chars", "pii", "secrets", "duplicate_ratio", "failed", "empty_documents", "readiness_score")


@query(with_chunks(f""", {_LOSSES} SELECT concat_ws('; ', CASE WHEN f > 0 THEN printf('-%.1f: files that failed %.1f%%', 20 * f, 100 * f) END, CASE WHEN e > 0 THEN printf('-%.1f: empty documents %.1f%%', 15 * e, 100 * e) END,
    CASE WHEN duplicate_ratio > 0 THEN printf('-%.1f: duplicate chunks %.1f%%', 10 * duplicate_ratio, 100 * duplicate_ratio) END,
    CASE WHEN recall < 1 THEN printf('-%.1f: documents missing against the reference %.1f%%', 30 * (1 - recall), 100 * (1 - recall)) END, CASE WHEN pii > 0 THEN '-10.0: personal data to review' END,
    CASE WHEN secrets > 0 THEN '-10.0: secrets to review' END, CASE WHEN u > 0.2 THEN '-10.0: many unsupported files' END,
    CASE WHEN avg_chars NOT BETWEEN 300 AND 5000 THEN '-10.0: mean chunk length outside 300 to 5000' END) AS explanation FROM losses"""))
def rag_explanation(spark: SparkSession, sf: str) -> DataFrame:
    return quality.readiness(_counts(spark, sf)).select(F.array_join("score_explanation", "; ").alias("explanation"))


@query(with_chunks(f""", {sql_scan.findings(f"SELECT {sql_chunk_id()} AS k, text AS t FROM chunks")}
  SELECT 'fnd_' || substr(sha256(k || ':' || {SQL_SLUG.format('label')} || ':' || i), 1, 16) AS id, k AS chunk_id, label, s AS start, e AS "end" FROM found"""))
def chunk_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The findings within chunks."""
    rows = scan.findings(chunks(spark, sf), "document_id", "text", "id")
    return rows.select("id", "chunk_id", "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("SELECT count(*) AS reference_count, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing_count, count(l.doc_id)::DOUBLE / count(*) AS recall FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def reference_recall(spark: SparkSession, sf: str) -> DataFrame:
    return quality.reference_recall(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_reference_ids(spark: SparkSession, sf: str) -> DataFrame:
    return quality.missing_keys(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("""WITH b AS (SELECT count(*) AS n, sum(n_chars)::BIGINT AS c, max(n_chars) AS m FROM documents), a AS (SELECT count(*) AS n, sum(n_chars)::BIGINT AS c, max(n_chars) AS m FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
  SELECT measure, before, after, after - before AS change FROM (
    SELECT 'documents' AS measure, b.n::DOUBLE AS before, a.n::DOUBLE AS after FROM a, b UNION ALL SELECT 'chars', b.c, a.c FROM a, b UNION ALL SELECT 'longest', b.m, a.m FROM a, b)""")
def pack_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus against its rows of good quality."""
    docs = table(spark, sf, "documents")
    one = lambda df: df.agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))
    return quality.diff(one(docs), one(docs.join(table(spark, sf, "labels").where("quality = 1"), "doc_id")))


@query(with_chunks(f"SELECT {sql_chunk_id()} AS chunk_id, document_id, 'Document ' || doc_id AS document_title, uri AS source_uri FROM chunks"))
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    return quality.provenance(chunks(spark, sf), corpus(spark, sf)).select("chunk_id", "document_id", "document_title", "source_uri")


@query(with_chunks(f"SELECT {sql_chunk_id()} AS id, document_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels)"))
def orphan_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks against the labelled documents only."""
    known = corpus(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_semi")
    return quality.orphan_chunks(chunks(spark, sf), known).select("id", "document_id")


@query(with_chunks(f"SELECT {sql_chunk_id()} AS id, contains(regexp_replace(document_text, '\\s+', '', 'g'), regexp_replace(text, '\\s+', '', 'g')) AS faithful FROM chunks"))
def faithfulness(spark: SparkSession, sf: str) -> DataFrame:
    return quality.faithful_rows(chunks(spark, sf), quality.cited_blocks(corpus(spark, sf)))


_TERMS = "The of thshing Licensed"


@query(with_chunks(f"""SELECT {sql_chunk_id()} AS id, score::DOUBLE AS score FROM (
  SELECT *, contains(lower(text), 'the')::INT + contains(lower(text), 'of')::INT + contains(lower(text), 'thshing')::INT + contains(lower(text), 'licensed')::INT AS score FROM chunks)
  WHERE score > 0 ORDER BY score DESC, document_id, chunk_index LIMIT 10"""))
def search_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_context(chunks(spark, sf), _TERMS).select("id", "score")


def _some_id(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).where("doc_id = 3")


@query(with_chunks(f"SELECT {sql_chunk_id()} AS id, text FROM chunks WHERE doc_id = 3 AND chunk_index = 0"))
def get_chunk(spark: SparkSession, sf: str) -> DataFrame:
    name = _some_id(spark, sf).select(ids.chunk_id(F.col("document_id"), F.lit("fixed"), F.lit(0))).first()[0]
    return search.get_by_key(chunks(spark, sf), "id", name).select("id", "text")


@query(with_docs("SELECT document_id, 'Document ' || doc_id AS title, uri, lang, 1::BIGINT AS block_count FROM docs WHERE doc_id = 3"))
def get_source_metadata(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf).withColumn("errors", F.array())
    found = search.source_metadata(docs, _some_id(spark, sf).first().document_id)
    return found.select("document_id", "title", "uri", F.col("metadata")["lang"].alias("lang"), F.col("block_count").cast("long").alias("block_count"))


@query(with_chunks("""SELECT string_agg('[' || k || '] ' || uri || chr(10) || text, chr(10) || chr(10) ORDER BY k) AS context FROM (
  SELECT *, row_number() OVER (ORDER BY document_id, chunk_index) AS k FROM chunks WHERE contains(lower(text), 'licensed') ORDER BY document_id, chunk_index LIMIT 5)"""))
def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    found = search.search_context(chunks(spark, sf), "licensed", 5).withColumn("source_uri", F.col("source_refs")[0]["source_uri"])
    return search.prompt_context(found, ("document_id", "chunk_index"))


@query(with_chunks(f"SELECT {sql_chunk_id()} AS id, text, document_id, uri AS source_uri, 'Document ' || doc_id AS title, 'false' AS redacted, 'fixed' AS chunker FROM chunks"))
def export_jsonl_rows(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("metadata")
    return export.jsonl_rows(chunks(spark, sf)).select("id", "text", *[m[k].alias(k) for k in ("document_id", "source_uri", "title", "redacted", "chunker")])


@query(with_chunks(f""", {sql_scan.findings(f"SELECT {sql_chunk_id()} AS k, text AS t FROM chunks")}, {sql_scan.redacted()}
  SELECT clean.k AS id, clean.t AS text, document_id, uri AS source_uri, 'true' AS redacted FROM clean JOIN (SELECT {sql_chunk_id()} AS k, document_id, uri FROM chunks) USING (k)"""))
def export_jsonl_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks without what was found in them; the findings are joined, not looked for again."""
    made = chunks(spark, sf)
    m = F.col("metadata")
    rows = export.jsonl_rows(made, redact=True, findings=scan.findings(made, "document_id", "text", "id"))
    return rows.select("id", "text", *[m[k].alias(k) for k in ("document_id", "source_uri", "redacted")])


@query(with_docs(f"SELECT text AS page_content, uri AS source, 'Document ' || doc_id AS title, document_id, '{PACK}' AS pack_id, lang FROM docs"))
def export_langchain_rows(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("metadata")
    return export.langchain_rows(corpus(spark, sf), PACK).select("page_content", *[m[k].alias(k) for k in ("source", "title", "document_id", "pack_id", "lang")])


@query(with_docs(f"SELECT text, document_id AS id_, uri AS file_name, 'Document ' || doc_id AS document_title, '{PACK}' AS pack_id, 'pack_id' AS hidden FROM docs"))
def export_llamaindex_rows(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("metadata")
    rows = export.llamaindex_rows(corpus(spark, sf), PACK)
    return rows.select("text", "id_", *[m[k].alias(k) for k in ("file_name", "document_title", "pack_id")], F.array_join("excluded_embed_metadata_keys", ",").alias("hidden"))


@query(with_docs("""SELECT document_id, rtrim('---' || chr(10) || 'document_id: ' || document_id || chr(10) || 'source_uri: "' || uri || '"' || chr(10) || 'title: "Document ' || doc_id || '"' || chr(10)
  || '---' || chr(10) || chr(10) || text, chr(10)) || chr(10) AS markdown FROM docs"""))
def export_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return export.markdown_rows(corpus(spark, sf))


@query(with_docs(f""", {sql_scan.findings("SELECT document_id AS k, text AS t FROM docs")}, {sql_scan.redacted()}
  SELECT document_id, rtrim('---' || chr(10) || 'document_id: ' || document_id || chr(10) || 'source_uri: "' || uri || '"' || chr(10) || 'title: "Document ' || doc_id || '"' || chr(10)
  || 'redacted: true' || chr(10) || '---' || chr(10) || chr(10) || t, chr(10)) || chr(10) AS markdown FROM docs JOIN clean ON k = document_id"""))
def export_markdown_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return export.markdown_rows(corpus(spark, sf), redact=True)


@query(f"""WITH {SQL_DOCS}, d AS (SELECT doc_id, CASE WHEN lang = 'de' THEN replace(document_id, 'doc_', 'bad_') ELSE document_id END AS document_id, CASE WHEN lang = 'es' THEN '' ELSE uri END AS uri, lang, source FROM docs),
  kept AS (SELECT * FROM d WHERE source <> 'src1')
  SELECT document_id, 'id_prefix' AS rule FROM d WHERE NOT starts_with(document_id, 'doc_')
  UNION ALL SELECT document_id, 'uri_empty' FROM d WHERE uri = ''
  UNION ALL SELECT document_id, 'no_blocks' FROM d WHERE source = 'src1'
  UNION ALL SELECT document_id, 'duplicate_block_id' FROM kept WHERE source = 'src2'
  UNION ALL SELECT document_id, 'parent_missing' FROM kept WHERE source = 'src3'
  UNION ALL SELECT document_id, 'child_missing' FROM kept WHERE source = 'src4'""")
def validate_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with defects put in, by language and source."""
    rows = texts(spark, sf).withColumn("document_id", F.when(F.col("lang") == "de", F.regexp_replace("document_id", "doc_", "bad_")).otherwise(F.col("document_id")))
    rows = rows.withColumn("uri", F.when(F.col("lang") == "es", "").otherwise(F.col("uri")))
    n = F.when(F.col("source") == "src1", 0).when(F.col("source") == "src2", 2).otherwise(1)
    blocks = rows.select(
        "document_id", F.explode(F.array_repeat(F.lit("blk_0"), n)).alias("block_id"), F.when(F.col("source") == "src3", "blk_9").alias("parent_id"),
        F.when(F.col("source") == "src4", F.array(F.lit("blk_0"), F.lit("blk_8"))).otherwise(F.array().cast("array<string>")).alias("children_ids"),
    )
    return quality.validate_documents(rows.select("document_id", "uri"), blocks)


@query("""WITH c AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'x_' ELSE 'chk_' END || doc_id AS id, CASE WHEN source = 'src1' THEN 'x' ELSE 'doc_x' END AS document_id,
    CASE WHEN source = 'src2' THEN ' ' ELSE text END AS text, length(text) + CASE WHEN source = 'src3' THEN 1 ELSE 0 END AS char_count, CASE WHEN source = 'src4' THEN 0 ELSE 1 END AS n_refs FROM documents)
  SELECT id, 'id_prefix' AS rule FROM c WHERE NOT starts_with(id, 'chk_') UNION ALL SELECT id, 'document_id_prefix' FROM c WHERE document_id = 'x'
  UNION ALL SELECT id, 'text_empty' FROM c WHERE trim(text, ' ' || chr(10)) = '' UNION ALL SELECT id, 'char_count_mismatch' FROM c WHERE char_count <> length(text) UNION ALL SELECT id, 'no_source_refs' FROM c WHERE n_refs = 0""")
def validate_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with defects put in, by language and source."""
    src = F.col("source")
    rows = table(spark, sf, "documents").select(
        F.concat(F.when(F.col("lang") == "fr", "x_").otherwise("chk_"), F.col("doc_id").cast("string")).alias("id"),
        F.when(src == "src1", "x").otherwise("doc_x").alias("document_id"),
        F.when(src == "src2", " ").otherwise(F.col("text")).alias("text"),
        (F.length("text") + F.when(src == "src3", 1).otherwise(0)).alias("char_count"),
        F.when(src == "src4", 0).otherwise(1).alias("n_refs"),
    )
    return quality.validate_chunks(rows)


@query(with_chunks(f"""SELECT ((SELECT count(*) FROM docs) + 1)::VARCHAR AS key, 'document_count_mismatch' AS rule
  UNION ALL SELECT {sql_chunk_id()}, 'document_missing' FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""))
def validate_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest that counts one document too many, against the labelled documents only."""
    # the chunks' ids are exchanged once; the manifest's count, which looks at ids lest they be pruned, and the check both read that exchange
    docs, made = corpus(spark, sf), chunks(spark, sf).select("id", "document_id").repartition("document_id")
    number = F.count_if(F.length("id") >= 0) + F.count_if(F.col("id").isNull())
    manifest = docs.agg((F.count(F.lit(1)) + 1).alias("document_count")).crossJoin(made.agg(number.alias("chunk_count")))
    return quality.validate_integrity(manifest, docs.join(table(spark, sf, "labels"), "doc_id", "left_semi"), made)


__all__ = ["Q", "SQL"]
