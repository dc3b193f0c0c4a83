"""The registry: names, SQL, and life without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

from quern.plans import catalogue

HOME = Path(__file__).resolve().parents[1]


def test_sql_belongs_to_queries():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(HOME, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=copy, capture_output=True, text=True, timeout=120)
    names = said.stdout.split()
    assert said.returncode == 0, said.stderr
    assert set(names) == set(catalogue.QUERIES)


def test_nothing_else_imports_the_subpackage():
    inside = ("__spark_entry__.py", "corpus_pipeline.py")
    for path in HOME.rglob("*.py"):
        if "llm" not in path.parts and path.name not in inside and path.name != Path(__file__).name:
            assert "quern.llm" not in path.read_text(), path


def test_flagship(spark, small):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["vec_id", "score"] and rows.count() > 0
