import json
import zipfile

import pytest

from corpuscule import cli, report
from corpuscule.sources import pack


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("cli")
    (base / "in").mkdir()
    (base / "in" / "a.md").write_text("# A\n\nMail a@b.com.\n\n```\ncode\n```\n")
    (base / "in" / "b.txt").write_text("plain text")
    assert cli.main(["build", str(base / "in"), str(base / "x.ctxpack"), "--max-chars", "500", "--overlap-chars", "20"]) == 0
    return base


def said(capsys, *arguments):
    capsys.readouterr()
    code = cli.main(list(map(str, arguments)))
    return code, json.loads(capsys.readouterr().out or "null")


def test_commands(made, spark, capsys):
    x = made / "x.ctxpack"
    assert said(capsys, "probe", made / "in")[1]["file_count"] == 2
    assert said(capsys, "inspect", x)[1]["labels"] == ["pii:email"]
    assert said(capsys, "validate", x) == (0, {"valid": True, "errors": [], "warnings": []})
    assert {r["measure"]: r["change"] for r in said(capsys, "diff", x, x)[1]} == {"chunks": 0, "avg_chunk_chars": 0, "documents": 0, "findings": 0}
    code, row = said(capsys, "eval", x, "--reference", x, "--output", made / "e.html")
    assert code == 0 and row["recall"] == 1.0 and (made / "e.html").exists()
    assert said(capsys, "inspect", x)[1]["documents"] == 2 and not said(capsys, "inspect", x)[1]["signed"]
    assert len(said(capsys, "plugins")[1]["decoders"]) == 7
    for how in ("jsonl", "langchain", "llamaindex", "markdown"):
        assert said(capsys, "export", x, made / how, "--format", how, "--redact")[0] == 0
        rows = spark.read.json(str(made / how))
        assert rows.count() == 2 and "a@b.com" not in " ".join(map(str, rows.collect())).replace("someone", "")
    assert cli.main(["serve"]) == 2
    assert cli.main(["build", str(made / "in"), str(x)]) == 2


def test_signing(made, spark, capsys, tmp_path):
    """A signed pack verifies, only with its key, and no longer once its manifest is changed; signing twice leaves one signature."""
    x, forged = tmp_path / "s.ctxpack", tmp_path / "f.ctxpack"
    x.write_bytes((made / "x.ctxpack").read_bytes())
    assert said(capsys, "sign", x, tmp_path / "k", "--new-key")[0] == 0
    assert said(capsys, "verify", x, tmp_path / "k.pub") == (0, {"valid": True, "errors": []})
    assert said(capsys, "inspect", x)[1]["signed"] and said(capsys, "validate", x)[0] == 0
    first = x.read_bytes()
    assert said(capsys, "sign", x, tmp_path / "k")[0] == 0 and x.read_bytes() == first
    unsigned = made / "x.ctxpack"
    assert said(capsys, "verify", unsigned, tmp_path / "k.pub") == (1, {"valid": False, "errors": ["the pack isn't signed"]})
    assert said(capsys, "sign", unsigned, tmp_path / "other", "--new-key")[0] == 0
    assert said(capsys, "verify", x, tmp_path / "other.pub") == (1, {"valid": False, "errors": ["the signature doesn't fit"]})
    with zipfile.ZipFile(x) as a, zipfile.ZipFile(forged, "w") as z:
        for m in a.infolist():
            z.writestr(m.filename, a.read(m).replace(b'"created_at": "2', b'"created_at": "1'))
    assert said(capsys, "verify", forged, tmp_path / "k.pub")[0] == 1
    assert not list(tmp_path.glob("*.partial"))


def rewritten(source, target, member, change):
    with zipfile.ZipFile(source) as a, zipfile.ZipFile(target, "w") as z:
        for m in a.infolist():
            z.writestr(m.filename, change(a.read(m)) if m.filename == member else a.read(m))


def test_validation_reads_every_row(made, capsys, tmp_path):
    """Tampered rows, a broken member and a missing one are reported, with checksums and without."""
    x, y = made / "x.ctxpack", tmp_path / "y.ctxpack"
    rewritten(x, y, "chunks.jsonl", lambda c: c.replace(b'"char_count":', b'"char_count":9', 1))
    code, found = said(capsys, "validate", y, "--skip-checksums")
    assert code == 1 and len(found["errors"]) == 1 and found["errors"][0].endswith("char_count_mismatch")
    assert "checksum mismatch: chunks.jsonl" in said(capsys, "validate", y)[1]["errors"]
    rewritten(x, y, "documents.jsonl", lambda c: c.replace(b'"uri":"a.md"', b'"uri":""'))
    assert [e.split(": ")[1] for e in said(capsys, "validate", y, "--skip-checksums")[1]["errors"]] == ["uri_empty"]
    rewritten(x, y, "documents.jsonl", lambda c: c.replace(b"doc_", b"dok_", 1))
    assert {"id_prefix"} <= {e.split(": ")[1] for e in said(capsys, "validate", y, "--skip-checksums")[1]["errors"]}
    rewritten(x, y, "chunks.jsonl", lambda c: c + b"{broken\n")
    assert any("chunks.jsonl, line" in e for e in said(capsys, "validate", y, "--skip-checksums")[1]["errors"])
    with zipfile.ZipFile(x) as a, zipfile.ZipFile(y, "w") as z:
        for m in a.infolist():
            if m.filename != "sources.jsonl":
                z.writestr(m.filename, a.read(m))
    assert said(capsys, "validate", y)[1]["errors"] == ["missing member: sources.jsonl"]


def test_schemas_hold_for_a_pack(made, capsys):
    code, all_models = said(capsys, "schemas")
    assert code == 0 and sorted(all_models) == ["chunk", "document", "finding", "manifest"]
    assert said(capsys, "schemas", "--model", "chunk") == (0, all_models["chunk"])
    assert cli.main(["schemas", "--model", "nothing"]) == 2
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}

    def fits(value, schema, at):
        assert isinstance(value, kinds[schema["type"]]), at
        if schema["type"] == "object" and "properties" in schema:
            assert set(value) <= set(schema["properties"]) and set(schema.get("required", [])) <= set(value), at
        for k, v in value.items() if isinstance(value, dict) else ():
            fits(v, schema["properties"][k] if "properties" in schema else schema["additionalProperties"], f"{at}/{k}")
        for v in value if isinstance(value, list) else ():
            fits(v, schema["items"], f"{at}[]")

    opened = pack.Pack(str(made / "x.ctxpack"))
    for name, member in (("document", "documents.jsonl"), ("chunk", "chunks.jsonl"), ("finding", "security_findings.jsonl")):
        rows = opened.rows(member)
        assert rows
        for row in rows:
            fits(row, all_models[name], name)
    fits(opened.manifest(), all_models["manifest"], "manifest")


GOLDEN = {
    "plain": ({"a.md": "# Leave\n\nTwenty days a year for everybody.\n"}, (1, 1, 0, 0)),
    "tables": ({"t.md": "# Prices\n\n| thing | price |\n| --- | --- |\n| pen | 2 |\n"}, (1, 1, 0, 0)),
    "twice": ({"one.txt": "The same words.\n", "two.txt": "The same words.\n"}, (2, 2, 0, 2)),
    "private": ({"p.md": "# Contacts\n\nMail jane@example.org.\n"}, (1, 1, 2, 0)),
}


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden_runs(name, tmp_path, capsys):
    """Documents, chunks, findings and warnings of small corpora; a second run of one differs in nothing but its time."""
    texts, expected = GOLDEN[name]
    (tmp_path / "in").mkdir()
    for k, v in texts.items():
        (tmp_path / "in" / k).write_text(v)
    manifests = []
    for n in range(2 if name == "private" else 1):
        x = tmp_path / f"{n}.ctxpack"
        assert said(capsys, "build", tmp_path / "in", x, "--report", tmp_path / "r.html")[0] == 0
        made = said(capsys, "inspect", x)[1]
        assert (made["documents"], made["chunks"], made["finding_count"], made["build_warnings"]) == expected
        assert said(capsys, "validate", x)[1]["errors"] == []
        manifests.append(made["manifest"])
    assert report.differences(manifests[0], manifests[-1], ignored=("created_at", "checksums")) == []
    page = (tmp_path / "r.html").read_text()
    assert page.count("<li>") == expected[3] + expected[2] and "document_count" in page
    assert report.differences({"a": [1, {"b": 2}]}, {"a": [1, {"b": 3}], "c": 0}) == ["/a/1/b: 2 is 3", "/c: only in one"]
