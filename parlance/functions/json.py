"""JSON text in the form that digests are taken of: no spaces, characters beyond ASCII as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters whose code has a hex letter.
LETTERED = [0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)]


def quoted(text: Column) -> Column:
    """A JSON string; control characters without a short form as four lower-case hex digits."""
    made = F.to_json(F.array(text))
    plain = F.substring(made, F.lit(2), F.length(made) - 2)
    # an escaped backslash before a u is no code, so it steps aside while codes are rewritten
    out = F.replace(plain, F.lit("\\\\"), F.lit("\x01"))
    for code in LETTERED:
        out = F.replace(out, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return F.when(text.isNotNull(), F.when(plain.contains("\\u00"), F.replace(out, F.lit("\x01"), F.lit("\\\\"))).otherwise(plain))


def value(x: Column, kind: str) -> Column:
    """Text, number or boolean; null as the word."""
    shown = quoted(x) if kind == "string" else x.cast("string")
    return F.coalesce(shown, F.lit("null"))


def canonical_object(fields: dict[str, Column]) -> Column:
    """An object with its keys sorted; the values are JSON already (:func:`value`)."""
    parts = []
    for name in sorted(fields):
        parts += [F.lit("," if parts else "{"), F.lit(f'"{name}":'), fields[name]]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def array(items: Column) -> Column:
    """A list from an array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)
