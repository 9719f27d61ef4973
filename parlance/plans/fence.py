"""Columns that are worked out once, whatever is done with them afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with more columns, made by a generator of one row.

    A filter on a column of a projection is pushed below it as a copy of the column's expression, and one on a
    column made of that again copies both: with large expressions the plan grows beyond use. Nothing is pushed
    through a generator's own columns, so later plans see plain attributes.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))
