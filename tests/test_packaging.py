"""Queries run from any folder."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

CODE = """
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", {path!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
print("rows", entry.queries()["smote"](spark, {data!r}).count())
"""


def test_workers_get_the_package(sf_dir, tmp_path):
    code = CODE.format(path=str(Path(__file__).resolve().parents[1] / "__spark_entry__.py"), shared=str(tmp_path / "shared"), data=sf_dir)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert "rows" in done.stdout, done.stderr[-2000:]
