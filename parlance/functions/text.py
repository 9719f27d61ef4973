"""Scalar functions over texts: comparison form, style features, format checks, n-grams."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as an emoji, a mention, a link and a role at the start of a line.
EMOJI = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}]"
MENTION = "(?U)@[\\w.-]+"
LINK = "(?i)https?://|www\\."
ROLE = "(?iU)(^|\\n)\\s*(assistant|system|user)\\s*:"
FEATURES = (
    "characters",
    "words",
    "lines",
    "punctuation_density",
    "uppercase_ratio",
    "emoji_rate",
    "mention_rate",
    "url_rate",
    "question_rate",
    "exclamation_rate",
    "terminal_punctuation_rate",
    "starts_lowercase_rate",
    "repeated_character_rate",
)


@F.arrow_udf(T.StringType())
def _folded(texts: pa.Array) -> pa.Array:
    # one text after another, so that a batch of long ones is not held as objects
    each = (x.as_py() for x in texts)
    return pa.array((None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in each), pa.string())


def normalize_text(text: Column) -> Column:
    """NFKC, case-folded, whitespace as single spaces.

    ASCII texts, for which lower case is all of it, stay in the JVM; others pass an Arrow UDF, as
    Spark has neither NFKC nor case folding.
    """
    ascii_only = F.length(text) == F.octet_length(text)
    simple = F.trim(F.regexp_replace(F.lower(text), "[\\s\\x0b\\x1c-\\x1f]+", " "))
    return F.when(ascii_only, simple).otherwise(_folded(F.when(~ascii_only, text)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def features(text: Column) -> dict[str, Column]:
    """The style features of a text without the whitespace at its ends, as doubles."""
    t = strip(text)
    n = F.length(t)
    letters = F.regexp_count(t, F.lit("\\p{L}"))
    words = F.when(n == 0, 0).otherwise(F.regexp_count(t, F.lit("(?U)[\\s\\x1c-\\x1f]+")) + 1)
    rate = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    ratio = lambda a, b: a / F.greatest(b, F.lit(1))
    return {
        "characters": n.cast("double"),
        "words": words.cast("double"),
        "lines": (F.regexp_count(t, F.lit("\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]")) + 1).cast("double"),
        "punctuation_density": ratio(F.regexp_count(t, F.lit("\\p{P}")), n),
        "uppercase_ratio": ratio(F.regexp_count(t, F.lit("\\p{Lu}")), letters),
        "emoji_rate": rate(t.rlike(EMOJI)),
        "mention_rate": rate(t.rlike(MENTION)),
        "url_rate": rate(t.rlike(LINK)),
        "question_rate": rate(t.contains("?")),
        "exclamation_rate": rate(t.contains("!")),
        "terminal_punctuation_rate": rate(F.substring(t, -1, 1).isin(".", "!", "?", "…")),
        "starts_lowercase_rate": rate(t.rlike("^\\p{Ll}")),
        "repeated_character_rate": rate(t.rlike("(?s)(.)\\1{2,}")),
    }


def format_violation(text: Column) -> Column:
    """Whether an output has marks that belong to the prompt's format."""
    low = F.lower(text)
    return text.rlike(ROLE) | low.contains("<think>") | low.contains("</think>") | low.contains("[next response]") | low.contains("conversation:")


def found_mentions(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)))


def unknown_mention(text: Column, prompt: Column) -> Column:
    """Whether a text mentions someone whom its prompt doesn't."""
    return F.size(F.array_except(found_mentions(text), found_mentions(prompt))) > 0


def windows(text: Column, size: int, piece: int = 1024) -> Column:
    """``array<array<string>>``: all windows of ``size`` characters, piece by piece.

    Characters of a long text are found from its start each time, so it is cut into pieces first.
    """
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)), F.lit(piece))
    pieces = F.transform(starts, lambda s: F.substring(text, s, F.lit(piece + size - 1)))
    inside = lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - size + 1), lambda i: F.substring(p, i, F.lit(size)))
    return F.when(n >= size, F.transform(pieces, inside)).otherwise(F.array().cast("array<array<string>>"))


def beginning(text: Column, limit: int) -> Column:
    """The text up to where it surely has more than ``limit`` columns, however its whitespace is shown; else all of it.

    Each character that is neither whitespace nor a mark takes a column at least.
    """
    return F.regexp_extract(text, f"(?sU)^(?:[\\s\\p{{Mn}}]*+[^\\s\\p{{Mn}}]){{0,{limit + 1}}}+[\\s\\p{{Mn}}]*+", 0)


def display_prefix(text: Column, limit: int) -> Column:
    """``text`` cut to ``limit`` columns with an ellipsis; wide characters take two, marks none."""
    # The blocks of wide characters that names and chats have.
    wide = "[\\x{1100}-\\x{115F}\\x{231A}\\x{231B}\\x{2E80}-\\x{303E}\\x{3041}-\\x{33FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{A000}-\\x{A4CF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE6F}\\x{FF00}-\\x{FF60}\\x{FFE0}-\\x{FFE6}\\x{1F300}-\\x{1F64F}\\x{1F900}-\\x{1F9FF}\\x{20000}-\\x{3FFFD}]"
    width = lambda c: F.when(c.rlike("^\\p{Mn}$"), 0).when(c.rlike(f"^{wide}$"), 2).otherwise(1)
    # what comes after more than ``limit`` columns changes nothing
    chars = F.regexp_extract_all(beginning(text, limit), F.lit("(?s)."), F.lit(0))
    total = F.aggregate(chars, F.lit(0), lambda s, c: s + width(c))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("w"), F.lit(False).alias("full"))

    def step(s: Column, c: Column) -> Column:
        over = s["full"] | (s["w"] + width(c) > limit - 1)
        return F.struct(F.when(over, s["out"]).otherwise(F.concat(s["out"], c)).alias("out"), (s["w"] + width(c)).alias("w"), over.alias("full"))

    cut = F.aggregate(chars, start, step)["out"]
    return F.when(total <= limit, text).otherwise(F.concat(F.regexp_replace(cut, "(?U)\\s+$", ""), F.lit("…")))


def title(explicit: Column, first_user_text: Column) -> Column:
    """A chat's title: the given one (64 columns), else its first user text (48), else Chat."""
    one_line = lambda x, limit: F.trim(F.regexp_replace(beginning(x, limit), "(?U)\\s+", " "))
    found = F.coalesce(F.nullif(one_line(first_user_text, 48), F.lit("")), F.lit("Chat"))
    return F.when(explicit.isNotNull(), display_prefix(one_line(explicit, 64), 64)).otherwise(display_prefix(found, 48))


def basename(path: Column) -> Column:
    """The last part of a path or of a repository's name."""
    return F.substring_index(F.replace(F.regexp_replace(path, "[/\\\\]+$", ""), F.lit("\\"), F.lit("/")), "/", -1)


def canonical_name(target: Column, run_id: Column, model: Column) -> Column:
    return F.concat(F.upper(target), F.lit("@"), F.substring(run_id, 1, 8), F.lit(" ["), basename(model), F.lit("]"))
