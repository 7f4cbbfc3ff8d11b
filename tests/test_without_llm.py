"""The library works, and answers, where the optional package, its tests and the pipeline are gone."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_without_the_optional_package(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py"))
    code = """
import __spark_entry__ as e, json
from pyspark.sql import SparkSession
assert not any(k.startswith("op") and k[2].isdigit() for k in e.queries()) and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", e.entry(spark).count(), e.queries()["merge_left"](spark, "/root/testdata/sf0.001").count())
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, check=False)
    assert run.returncode == 0, run.stderr[-2000:]
    entry, merged = map(int, run.stdout.split("rows ")[1].split()[:2])
    assert entry > 2000 and merged == 1500


def test_nothing_else_imports_the_package():
    for path in [*ROOT.glob("rowloom/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != Path(__file__).name:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", path.read_text()), path
