"""Panel queries over tables in which all answers are the same, as they are once there are many events."""

from __future__ import annotations

import math

import pytest
from oracle import connect, same

from parlance.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def one_choice(spark, sf_dir, tmp_path_factory):
    """The events of the tables, all of them clicks, and again for two other raters."""
    folder = tmp_path_factory.mktemp("one_choice")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.crossJoin(spark.range(3).withColumnRenamed("id", "k"))
    e.selectExpr("event_id + 1500 * k AS event_id", "ts", "user_id + k AS user_id", "'click' AS event_type", "value", "props").write.parquet(f"{folder}/events.parquet")
    con = connect(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["krippendorff_alpha", "create_panel"])
def test_undisputed_panels_equal_sql(name, spark, one_choice):
    folder, con = one_choice
    df = QUERIES[name](spark, folder)
    same(df, con, ORACLE_SQL[name])
    assert all(math.isnan(r["alpha"]) for r in df.collect())
