"""The driver's contract: names agree, SQL stands for known queries, and the core stands without the corpus operators."""

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["query_id", "id", "score", "rank"] and found.count() > 0


def test_core_alone(tmp_path):
    """Without the corpus operators' folders the entry still imports."""
    for name in os.listdir(ROOT):
        if name not in (".git", "corpus_pipeline.py", "weftline", "tests"):
            os.symlink(os.path.join(ROOT, name), tmp_path / name)
    os.mkdir(tmp_path / "weftline")
    for name in os.listdir(os.path.join(ROOT, "weftline")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "weftline", name), tmp_path / "weftline" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
