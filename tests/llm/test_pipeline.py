import ast
import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corpuscule.llm import bpe, decontaminate, lang_id, quality, queries, simhash

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, written):
    base = str(tmp_path_factory.mktemp("tables"))
    items = [(i, written(9_000 + i, 30)) for i in range(8)]
    rows = []
    for d in range(160):
        lang = "fr" if d % 4 == 0 else "en"
        text = written(d, 60, lang)
        if d % 10 == 3:
            text = text.replace(" ", "### ")
        if d % 10 == 5:
            text = written(d - 1, 60, "fr" if (d - 1) % 4 == 0 else "en") + (" more" if d % 20 == 5 else "")
        if d % 16 == 7:
            text = text[:150] + " " + items[d % 8][1] + " " + text[150:]
        if d % 40 == 9:
            text = "?? 12 !!"
        rows.append((d, text, lang, f"s{d % 3}", len(text)))
    labels = [(d, int(d % 10 != 3), 0) for d in range(160)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_run_equals_brute_force(spark, folder):
    """Each stage again on plain lists, from the same fitted models."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()))
    model = lang_id.fit(docs)
    rate, n, letters = lang_id.classify(model, pa.array([t for _, t in rows]))
    most = model.most(lang_id.STRANGE) + lang_id.SPARE * model.bits / np.maximum(n, 1)[:, None]
    rows = [r for i, r in enumerate(rows) if letters[i] and rate[i].min() <= most[i, rate[i].argmin()]]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    good = quality.fit(left, labels)
    q, t = quality._scores(good, pa.array([t for _, t in rows]))
    rows = [r for r, a, b in zip(rows, q, t, strict=True) if a >= quality.LEAST_QUALITY and b <= quality.MOST_TOXIC]
    assert all(d % 10 != 3 for d, _ in rows)
    a, b = simhash.signatures(pa.array([t for _, t in rows]))
    kept, seen = [], set()
    for i in range(len(rows)):
        if i in seen:
            continue
        kept.append(rows[i])
        stack = [i]
        while stack:
            k = stack.pop()
            near = [j for j in range(len(rows)) if j not in seen and (int(a[j] ^ a[k]).bit_count() <= simhash.RADIUS) and (int(b[j] ^ b[k]).bit_count() <= simhash.CONFIRM)]
            seen.update(near)
            stack += near
    items = decontaminate.Items([(r.item_id, r.text, None) for r in spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").collect()])
    hashes = {d: decontaminate.words(pa.array([t]))[0] for d, t in kept}
    clean = [(d, t) for d, t in kept if not any(decontaminate.confirm(items, i, hashes[d])[2] for i in range(8))]
    assert len(rows) > len(kept) > len(clean)
    codec = bpe.Codec(bpe.read_ranks())
    expected = {d: list(memoryview(codec.encode(t)).cast("i")) for d, t in clean}
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == expected


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "near_duplicates", "benchmark_decontamination", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "corpuscule")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, name), encoding="utf-8").read())
                for node in ast.walk(tree):
                    found = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any("llm" in x.split(".") for x in found), name


def test_the_entry_works_without_it(tmp_path):
    import shutil

    shutil.copytree(os.path.join(ROOT, "corpuscule"), tmp_path / "corpuscule", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'fixed_chunks' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
