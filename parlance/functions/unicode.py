"""Text addressed in UTF-16 units, by way of the text's UTF-16 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16(text: Column) -> Column:
    return F.encode(text, "UTF-16BE")


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(utf16(text)) / 2).cast("int")


def on_boundary(text: Column, unit: Column) -> Column:
    """Whether ``unit`` is the start of a character or the end of the text."""
    lead = F.hex(F.substring(utf16(text), unit * 2 + 1, F.lit(1)))
    inside = (unit >= 0) & (unit < units(text)) & ~lead.between("DC", "DF")
    return inside | (unit == units(text))


def cut(text: Column, start: Column, end: Column) -> Column:
    """The characters from one unit to another, both on boundaries."""
    return F.decode(F.substring(utf16(text), start * 2 + 1, (end - start) * 2), "UTF-16BE")
