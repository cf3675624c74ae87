"""The entry module with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as E
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
queries = E.queries()
assert E.entry(spark).count() > 0 and queries["track_lengths"](spark, "/root/testdata/sf0.001").count() > 0
assert set(E.oracle_sql()) <= set(queries)
print("LLM", sorted(k for k in queries if k.startswith("op") or k == "pipeline"))
"""


def ran(folder):
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return next(line for line in done.stdout.splitlines() if line.startswith("LLM"))


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_entry_without_the_corpus_operators(tmp_path, pipeline_too):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", ".pytest_cache"))
    shutil.rmtree(copy / "cytoframe" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    if pipeline_too:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert ran(copy) == "LLM []"


def test_other_missing_modules_are_raised(monkeypatch):
    import __spark_entry__ as entry

    def missing(name):
        raise ModuleNotFoundError("no", name="numpy")

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    with pytest.raises(ModuleNotFoundError):
        entry._optional("corpus_pipeline")
