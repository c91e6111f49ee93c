import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_its_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100 and all(callable(f) for f in queries.values())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_works_without_the_corpus_subpackage(tmp_path):
    """A copy without the corpus folders and the pipeline: the entry point imports, and queries run."""
    for folder in ("granary", "tests"):
        shutil.copytree(ROOT / folder, tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = """
import sys
sys.path.insert(0, ".")
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"] and set(e.oracle_sql()) <= set(e.queries())
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0 and e.queries()["k7_merge_upsert"](spark, "/root/testdata/sf0.001").count() > 0
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_nothing_else_imports_the_corpus_subpackage():
    for path in (ROOT / "granary").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "granary").parts:
            assert "granary.llm" not in path.read_text() and "from .llm" not in path.read_text()
