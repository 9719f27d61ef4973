"""Every query with SQL gives DuckDB's rows; the others run."""

from __future__ import annotations

import pytest
from oracle import connect, same

from parlance.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        same(df, con, ORACLE_SQL[name])
    else:
        assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
