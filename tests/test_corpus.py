import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from corpuscule import build as b
from corpuscule import config as cfg
from corpuscule import plugins, report
from corpuscule.errors import ConfigError, CorpusError, DecodeError, PackError
from corpuscule.operators import quality, search
from corpuscule.sources import decoders, files, pack, signing
from corpuscule.streaming import ingest

FILES = {
    "handbook.md": "# Handbook\n\nWelcome all.\n\n## Remote Work\n\nWork where you like.\n\n- one\n- two\n\n```python\nx = 1\n",
    "notes.txt": "First part.\n\nSecond part,\ntwo lines.",
    "sub/copy.txt": "First part.\n\nSecond part,\ntwo lines.",
    "page.html": "<html><head><title>A &amp; B</title><style>p{}</style></head><body><h1>Head</h1><p>Text <a href='/x'>link</a><ul><li><p>nested</p></li></ul><script>no()</script></body></html>",
    "table.csv": "name,role\n" + "\n".join(f"n{i},r{i}" for i in range(30)),
    "data.json": json.dumps({"title": "Data", "items": [1, 2]}),
    "list.json": json.dumps([{"b": i, "a": "é"} for i in range(45)]),
    "bad.json": "{",
    "mail.txt": "Mail someone@example.com please.",
    "empty.txt": "  \n ",
    "latin.txt": "caf\xe9".encode("latin-1"),
    "fake.docx": "not a zip",
    "plain.pdf": "%PDF-1.4 (Some words here) Tj (12)",
    "picture.png": b"\x89PNG",
    "node_modules/x.md": "# no",
    "a/node_modules/y/z.md": "# no",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus files")
    for name, content in FILES.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    w = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'
    p = "<w:p><w:pPr><w:pStyle w:val='{}'/></w:pPr><w:r><w:t>{}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{p.format('x', c)}</w:tc>" for c in ("h1", "h2")) + "</w:tr><w:tr><w:tc>" + p.format("x", "v") + "</w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(base / "real.docx", "w") as z:
        z.writestr("word/document.xml", w.format(p.format("Heading1", "Title") + table + p.format("Normal", "Body.")))
    return str(base)


@pytest.fixture(scope="module")
def corpus(spark, root):
    return b.build(spark, root, cfg.Config(as_of="2026-01-02T03:04:05"))


def test_decoders(corpus):
    rows = {r.uri: r for r in corpus.documents.collect()}
    kinds = lambda uri: [x.type for x in rows[uri].blocks]
    assert rows["handbook.md"].title == "Handbook" and kinds("handbook.md") == ["heading", "paragraph", "heading", "paragraph", "list_item", "list_item", "code"]
    code = rows["handbook.md"].blocks[-1]
    assert code.confidence == 0.8 and code.text.startswith("```python") and (code.line_start, code.line_end) == (12, 13)
    assert [(x.line_start, x.line_end) for x in rows["notes.txt"].blocks] == [(1, 1), (3, 4)]
    assert rows["page.html"].title == "A & B" and kinds("page.html") == ["heading", "paragraph", "list_item", "paragraph"]
    assert json.loads(rows["page.html"].blocks[1].metadata["links"]) == ["/x"]
    assert kinds("table.csv") == ["metadata", "table", "table"] and rows["table.csv"].blocks[0].text == "CSV table with 31 rows and 2 columns."
    assert (rows["table.csv"].blocks[2].line_start, rows["table.csv"].blocks[2].line_end) == (27, 31)
    assert rows["data.json"].title == "Data" and kinds("list.json") == ["metadata", "code", "code", "code"]
    assert rows["latin.txt"].blocks[0].text == "café" and rows["fake.docx"].blocks[0].confidence == 0.25
    assert kinds("real.docx") == ["heading", "paragraph", "table"] and rows["real.docx"].title == "Title"
    assert rows["real.docx"].blocks[2].markdown == "| h1 | h2 |\n| --- | --- |\n| v |  |"
    assert rows["plain.pdf"].blocks[0].text == "Some words here" and rows["plain.pdf"].blocks[0].confidence == 0.35
    assert "bad.json" not in rows and "empty.txt" not in rows and not any("node_modules" in u for u in rows)


def test_report_and_warnings(corpus):
    r = corpus.report.first()
    assert (r.discovered, r.unsupported, r.empty, r.failed) == (15, 1, 2, 2) and r.document_count == 12
    codes = {(w.code, w.path) for w in corpus.warnings.collect()}
    assert {("exact_duplicate_source", "sub/copy.txt"), ("unsupported_file", "picture.png"), ("empty_document", "empty.txt"), ("json_decode_failed", "bad.json"), ("docx_text_fallback", "fake.docx")} <= codes
    assert {x.scope for x in corpus.findings.where("label = 'pii:email'").collect()} == {"document", "chunk"}
    handbook = [c for c in corpus.chunks.collect() if "Remote Work" in (c.section_path or [])]
    assert handbook and handbook[0].has_citation


def test_counts_are_one_pass_that_keeps_nothing(corpus, spark, root):
    config = cfg.Config(as_of="2026-01-03T00:00:00")  # another plan than the fixture's, which is kept
    once = b.build_from(files.discover(spark, root, config.input.include, config.input.exclude), root, config, keep=False)
    plan = once.counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "InMemoryTableScan" not in plan and once.kept == ()
    counts, report, lengths = once.counts.first().asDict(), corpus.report.first().asDict(), quality.chunk_stats(corpus.chunks).first().asDict()
    assert counts == {k: report[k] for k in counts} and lengths == {k: counts[k] for k in lengths}
    nothing = b.build_from(files.discover(spark, root, ["nothing/*"]), root, config, keep=False).counts.first()
    assert (nothing.discovered, nothing.chunk_count, nothing.max_chars, nothing.avg_chars) == (0, 0, 0, 0.0)


def test_evaluation(corpus, spark):
    row = b.evaluate(corpus, metrics={"size": lambda d, c: c.agg(F.count("*").alias("n")), "broken": lambda d, c: 1 / 0}).first()
    assert row.metric_size.n == row.chunk_count and any(w.startswith("plugin_metric_error:broken") for w in row.warnings)
    assert 0 <= row.readiness_score <= 100 and row.pii >= 1
    reference = spark.createDataFrame([("doc_x",), (corpus.documents.first().document_id,)], "document_id string")
    half = b.evaluate(corpus, reference).first()
    assert half.recall == 0.5 and half.missing_count == 1 and half.readiness_score == row.readiness_score - 15


def test_faithfulness_and_provenance(corpus):
    blocks = b.blocks_of(corpus.documents)
    got = quality.faithfulness(corpus.chunks, blocks).collect()
    assert got and all(r.faithful for r in got)
    assert quality.provenance(corpus.chunks, corpus.documents).count() == corpus.chunks.count()
    assert quality.orphan_chunks(corpus.chunks, corpus.documents.limit(0)).count() == corpus.chunks.count()


def test_packs(corpus, spark, tmp_path):
    private, public = signing.key_pair(spark)
    path = str(tmp_path / "c.ctxpack")
    manifest = pack.write(corpus, path, private_key=private)
    opened = pack.Pack(path)
    assert opened.validate(spark, public) == [] and opened.manifest() == manifest
    assert opened.table(spark, "chunks.jsonl").count() == corpus.chunks.count()
    assert "checksum mismatch" not in " ".join(opened.validate())
    again = str(tmp_path / "d.ctxpack")
    pack.write(corpus, again, private_key=private)
    assert open(path, "rb").read() == open(again, "rb").read()
    with pytest.raises(PackError):
        pack.write(corpus, path)
    with pytest.raises(PackError):
        pack.write(corpus, str(tmp_path / "c.zip"))
    other = signing.key_pair(spark)[1]
    assert pack.Pack(path).validate(spark, other) == ["the signature doesn't fit"]
    forged = str(tmp_path / "f.ctxpack")
    with zipfile.ZipFile(path) as a, zipfile.ZipFile(forged, "w") as z:
        for m in a.infolist():
            z.writestr(m.filename, a.read(m) + (b" " if m.filename == "sources.jsonl" else b""))
    assert pack.Pack(forged).validate() == ["checksum mismatch: sources.jsonl"]


def test_unsafe_packs(tmp_path):
    for name in ("../x.txt", "/abs.txt", "a/../../b"):
        path = str(tmp_path / "u.ctxpack")
        with zipfile.ZipFile(path, "w") as z:
            z.writestr(name, "x")
        with pytest.raises(PackError):
            pack.Pack(path)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("documents.jsonl", '{"a": 1}\n\n[1]\n')
    with pytest.raises(PackError, match="line 3"):
        pack.Pack(path).rows("documents.jsonl")
    with pytest.raises(PackError):
        pack.Pack(str(tmp_path / "none"))


def test_probe_and_globs(spark, root):
    row = files.probe(files.discover(spark, root)).first()
    assert (row.file_count, row.unsupported_count) == (15, 1) and row.file_types[".json"] == 3 and row.warnings == ["unsupported_files_detected"]
    only = files.discover(spark, root, include=["**/*.txt"], exclude=["sub/**"])
    assert sorted(r.rel_path for r in only.select("rel_path").collect()) == ["empty.txt", "latin.txt", "mail.txt", "notes.txt"]
    one = files.discover(spark, os.path.join(root, "notes.txt"))
    assert [r.rel_path for r in one.select("rel_path").collect()] == ["notes.txt"]
    support = {r.rel_path: r.explanation for r in files.explain_support(files.discover(spark, root)).collect()}
    assert support["notes.txt"] == "supported by text" and support["picture.png"] == "no decoder for .png"


def test_plugins_take_effect(spark, root):
    def shout(content, path):
        out = decoders.Result("t")
        out.add("paragraph", content.decode().upper())
        return out

    registry = plugins.Registry()
    registry.register("decoders", "shout", decoders.Decoder("shout", (".txt",), (), shout))
    registry.register("chunkers", "whole", lambda blocks, title, most, overlap: [dict(text=x["text"], title=title, section_path=[], blocks=[x["index"]], score=1.0, labels=[]) for x in blocks])
    config = cfg.merged(cfg.Config(), include=("notes.txt",), strategy="whole")
    made = b.build(spark, root, config, registry)
    assert [r.text for r in made.chunks.collect()] == ["FIRST PART.\n\nSECOND PART,\nTWO LINES."]
    assert plugins.metadata_name_ok("ns:p:key") and not plugins.metadata_name_ok("key") and plugins.installed().skipped == []
    with pytest.raises(ConfigError):
        registry.register("nothing", "x", 1)


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"chunking": {"max_chars": 500}, "input": {"include": ["**/*.md"]}}')
    made = cfg.merged(cfg.load(path), exclude=("x/**",), overlap_chars=50)
    assert made.chunking.max_chars == 500 and made.chunking.overlap_chars == 50 and made.input.include == ("**/*.md",) and made.input.exclude[-1] == "x/**"
    for bad in ("[]", '{"chunking": {"no": 1}}', '{"zzz": {}}', '{"chunking": {"max_chars": 10}}'):
        path.write_text(bad)
        with pytest.raises(ConfigError):
            cfg.load(path)


def test_normalized_members_begin_with_json(corpus, tmp_path):
    path = str(tmp_path / "n.ctxpack")
    pack.write(corpus, path)
    opened, titles = pack.Pack(path), {r.document_id: (r.uri, r.title or r.document_id) for r in corpus.documents.collect()}
    for name, (uri, title) in titles.items():
        text = opened.read(f"normalized/{name}.md").decode()
        front, body = text[4:].split("\n---\n\n", 1)
        assert text.startswith("---\n{\n") and json.loads(front) == {"document_id": name, "source_uri": uri, "title": title}
        assert front == json.dumps(json.loads(front), indent=2, sort_keys=True, ensure_ascii=False) and body.endswith("\n")


def test_plugin_metadata_is_namespaced(spark, root):
    registry = plugins.Registry()
    registry.register("metadata", "ns:mine:team", "docs")
    for wrong in ("team", "ns:team", "x:mine:team", "ns::team"):
        with pytest.raises(ConfigError):
            registry.register("metadata", wrong, "docs")
    rows = b.decode_files(files.discover(spark, root, ("notes.txt",)), cfg.Config(), registry).collect()
    assert [r.metadata["ns:mine:team"] for r in rows] == ["docs"]


def test_decoders_may_raise_decode_errors(spark):
    def refuse(content, path):
        raise DecodeError("not mine")

    mine = decoders.Decoder("mine", (".x",), (), refuse)
    row = spark.range(1).select(decoders.decoded(F.lit(b"x"), F.lit("a.x"), F.lit("mine"), (mine,)).alias("d")).first()
    assert [(e.code, e.severity) for e in row.d.errors] == [("decode_error", "error")]


def test_redaction_by_findings_equals_scanning_again(corpus):
    from corpuscule.operators import export

    one = {r.id: r.text for r in export.jsonl_rows(corpus.chunks, redact=True).collect()}
    assert one == {r.id: r.text for r in export.jsonl_rows(corpus.chunks, redact=True, findings=corpus.findings).collect()}
    assert any("[REDACTED:pii:email]" in t for t in one.values()) and search.available_tools()[0] == "search_context"


def test_search_and_prompts(corpus):
    found = search.search_context(corpus.chunks, "Work remote WORK", 5).collect()
    assert found[0].score == 2.0 and "Remote Work" in found[0].text
    assert search.get_by_key(corpus.chunks, "id", found[0].id).count() == 1
    assert "Question: q" in search.rag_prompt("c", "q")


def test_streaming(spark, root, tmp_path):
    docs = ingest.stream_documents(spark, root, cfg.Config(as_of="2026-01-01"))
    q = ingest.stream_chunks(docs).select("id", "text").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = b.build(spark, root).chunks
    assert spark.read.parquet(str(tmp_path / "o")).count() == batch.count()


def test_reports(corpus, tmp_path):
    row = b.evaluate(corpus)
    report.write_report(str(tmp_path / "r.json"), "R", row)
    assert "readiness_score" in json.loads((tmp_path / "r.json").read_text())
    report.write_report(str(tmp_path / "r.html"), "<R>", row, corpus.findings)
    assert "&lt;R&gt;" in (tmp_path / "r.html").read_text()
    assert report.schemas("chunk")["properties"]["char_count"] == {"type": "integer"}
    with pytest.raises(CorpusError):
        report.schemas("nothing")


def test_tables_instead_of_a_pack(corpus, spark, tmp_path):
    pack.write_tables(corpus, str(tmp_path / "t"))
    back = pack.read_tables(spark, str(tmp_path / "t"))
    assert sorted(back) == sorted(pack.TABLES) and all(back[n].count() == getattr(corpus, n).count() for n in back)
    assert back["chunks"].schema.simpleString() == corpus.chunks.schema.simpleString()
    with pytest.raises(PackError):
        pack.write_tables(corpus, str(tmp_path / "t"))


def test_duplicates(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string")
    r = quality.duplicate_ratios(rows).first()
    assert (r.dup_member_ratio, r.dup_excess_ratio) == (0.5, 0.25)
    assert quality.duplicate_ratios(rows.limit(0)).first().dup_member_ratio == 0.0


def test_integrity_reads_the_chunks_once(spark):
    import re

    docs = spark.createDataFrame([("doc_1",), ("doc_2",)], "document_id string")
    chunks = spark.createDataFrame([("a", "doc_1"), ("b", "doc_3"), ("b", "doc_3"), ("c", None), (None, "doc_4")], "id string, document_id string")
    manifest = lambda d, c: spark.createDataFrame([(d, c)], "document_count long, chunk_count long")
    found = lambda m, d, c: sorted(((r.key, r.rule) for r in quality.validate_integrity(m, d, c).collect()), key=str)
    missing = [("b", "document_missing"), ("b", "document_missing"), ("c", "document_missing"), (None, "document_missing")]
    assert found(manifest(2, 5), docs, chunks) == missing
    assert found(manifest(3, 4), docs, chunks) == sorted([*missing, ("3", "document_count_mismatch"), ("4", "chunk_count_mismatch")], key=str)
    assert found(manifest(2, 5).limit(0), docs, chunks) == missing
    assert found(manifest(0, 1), docs.limit(0), chunks.limit(0)) == [("1", "chunk_count_mismatch")]
    marked = chunks.withColumn("id", F.concat("id", F.lit("_mark_")))
    plan = quality.validate_integrity(manifest(2, 5), docs, marked.withColumn("n", F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("_mark_", plan)) == 1
    assert len(re.findall(r"LogicalRDD|LocalRelation|ExistingRDD", plan)) == 4  # manifest, documents twice, chunks


def test_a_reference_without_its_semicolon_is_read_as_html_reads_it():
    row = decoders.decode_html(b"<title>a &amp;&amp</title><h1>a &amp;&amp</h1>", "p.html").row()
    assert row["title"] == row["blocks"][0]["text"] == "a &&"
