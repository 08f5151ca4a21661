import os
import subprocess
import sys

import pytest

import corpus_pipeline

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture
def tables(spark, tmp_path):
    words = [f"word{i}" for i in range(400)]
    text = lambda i: "\n".join(" ".join(words[(i * 37 + j * 11 + j * j * i) % 400] for j in range(k * 12, k * 12 + 12)) for k in range(4))
    item = "which of the seven bridges over the river stands 12 metres above the flood mark of 1931"
    docs = [(i, text(i), "en", "hot" if i % 3 == 0 else f"s{i % 5}", len(text(i))) for i in range(120)]
    docs += [(200, docs[4][1], "en", "s1", 1), (201, text(500) + "\n" + item, "en", "s1", 1), (202, None, None, None, None), (203, "", "de", "s2", 0), (204, text(7).split("\n")[0] + "\nnew last line of five words here", "de", "s2", 0)]
    path = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 100, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    schema, seen = docs.dtypes, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.dtypes == schema
        docs.write.parquet(f"{tables}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{tables}/{name.replace(' ', '_')}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(seen[names[0]]) >= 120
    lines = seen[names[1]]
    assert set(lines) == set(seen[names[0]]) and lines[200]["text"] == "" and lines[204]["text"] == "new last line of five words here"
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in lines.values())
    assert 201 in seen[names[2]] and 201 not in seen[names[3]]
    assert set(seen[names[2]]) - set(seen[names[3]]) == {201}
    assert set(seen[names[4]]) <= set(seen[names[3]]) and len(seen[names[4]]) > 0.5 * len(seen[names[3]])


def test_run_and_empty(spark, tables):
    assert 0 < corpus_pipeline.run(spark, tables).count() <= 125
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0


def test_entry_without_this_part(tmp_path):
    code = "import sys, shutil; import __spark_entry__ as e; assert 'pass_levels' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run(["cp", "-r", ROOT, str(tmp_path / "r")], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "r/tidemark/llm"), str(tmp_path / "r/corpus_pipeline.py"), str(tmp_path / "r/.git")], check=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, check=True)
