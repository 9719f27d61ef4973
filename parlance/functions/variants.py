"""Typed reads of JSON values held as VARIANT: a value of another type counts as absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def text(v: Column) -> Column:
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def integer(v: Column) -> Column:
    return F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "long"))


def is_object(v: Column) -> Column:
    # only an object can be read as one, whatever it has; its kind would list all that is in it
    return F.try_variant_get(v, "$", "struct<_:variant>").isNotNull()


def flag(v: Column, default: bool) -> Column:
    return F.coalesce(F.when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")), F.lit(default))


def first_text(*values: Column) -> Column:
    """The first of some texts that is neither absent nor empty."""
    return F.coalesce(*[F.nullif(text(v), F.lit("")) for v in values])
