"""The entry works without the optional folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from checks.registry import QUERIES

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("without", [(), ("corpus_pipeline.py",)])
def test_import_without_optional_parts(tmp_path, without):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", *without)
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    env = {**os.environ, "PYTHONPATH": ""}
    said = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path / "copy", env=env, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(QUERIES))] * 2, said.stderr


RUN = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
found = e.queries()
for name in sys.argv[2:]:
    print(name, found[name](spark, "/root/testdata/sf0.001").count())
"""
IN_PYTHON = ["folder_stylesheets", "written_back", "reachable_within", "rule_table_rejects", "wide_range_rejects", "stream_missing_urls"]


def test_tasks_find_the_package_from_any_folder(tmp_path):
    """Python workers start in a folder that knows nothing of the package."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    command = [sys.executable, "-c", RUN, str(ROOT), *IN_PYTHON]
    said = subprocess.run(command, cwd=tmp_path, env=env, capture_output=True, text=True)
    lines = said.stdout.split("\n")
    assert [x.split()[0] for x in lines if x] == IN_PYTHON, said.stderr[-3000:]
    assert all(int(x.split()[1]) > 0 for x in lines if x)
