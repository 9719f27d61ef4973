"""Executors have no copy of the repository: all queries run where workers can't import the package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
try:
    spark.range(1).mapInArrow(lambda it: __import__("parlance") and it, "id long").count()
    sys.exit("the workers can import the package, so this shows nothing")
except Exception as e:
    assert "ModuleNotFoundError" in str(e), e
queries = entry.queries()
for name in sorted(n for n in queries if n.startswith("op") and n[2].isdigit() or n == "pipeline"):
    print(name, queries[name](spark, {sf!r}).count(), flush=True)
"""


def test_workers_without_the_package(sf_dir, tmp_path):
    repo = str(Path(__file__).parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, sf=sf_dir)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len([x for x in done.stdout.splitlines() if x.startswith(("op", "pipeline"))]) == 14
