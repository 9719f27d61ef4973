"""Rows at the edges, with columns named like those that operators make for themselves."""

from __future__ import annotations

import pytest

CLASHES = "row string, fp long, key string, doc_id long, text string, lang string, source string, n_chars long, c0 string, same boolean, c1 int, _words string, `a.b` string, part long"
LONG = "alpha beta " * 100_000


@pytest.fixture(scope="session")
def edges(spark):
    def docs(n: int = 99):
        texts = [(1, None), (2, ""), (3, " \t\n"), (4, "Hello big wide world again"), (5, "hello BIG wide world again"), (5, "hello BIG wide world again"), (None, "x y z"), (6, LONG), (7, "größe 😀 ñ\x0b..."), (8, LONG), (9, None), (10, "12 34")]
        rows = [(None, None, "k", i, t, "en" if i and i % 2 else None, None, None, "c", None, 1, "w", "dot", 7) for i, t in texts[:n]]
        return spark.createDataFrame(rows, CLASHES)

    return docs


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
