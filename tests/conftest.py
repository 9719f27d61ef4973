"""One local session for all tests, and the tables where they are there."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    import __spark_entry__  # noqa: F401  registers the package with the pickler

    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false")
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not DATA.is_dir():
        pytest.skip(f"no tables at {DATA}")
    return str(DATA)
