"""Raw events: lines of JSON, each identified by a digest of its bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import variants as v

SOURCE = "signal"


def identify_lines(lines: DataFrame, source: str = SOURCE) -> DataFrame:
    """``id, source, payload`` of the lines (one column ``value``) that are not blank.

    ``payload`` is null where a line is not a JSON object; callers that must fail on such lines
    check :func:`bad_lines` first.
    """
    line = F.trim(F.regexp_replace("value", "^[ \\t\\n\\r\\x0b\\x0c]+|[ \\t\\n\\r\\x0b\\x0c]+$", ""))
    stripped = lines.select(line.alias("value")).where("value != ''")
    parsed = F.try_parse_json("value")
    return stripped.select(F.concat(F.lit(f"{source}:"), F.sha2("value", 256)).alias("id"), F.lit(source).alias("source"), F.when(v.is_object(parsed), F.col("value")).alias("payload"))


def read_events(spark: SparkSession, path: str, source: str = SOURCE) -> DataFrame:
    return identify_lines(spark.read.text(path), source)


def stream_events(spark: SparkSession, path: str, source: str = SOURCE, files_per_trigger: int | None = None) -> DataFrame:
    """The same over files that keep arriving; ``trigger(availableNow=True)`` gives the bounded form."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return identify_lines(reader.text(path), source)


def bad_lines(events: DataFrame) -> DataFrame:
    return events.where("payload IS NULL").select("id")


def list_groups(groups: DataFrame) -> DataFrame:
    """``id, name, active`` from JSON objects in a column ``value``.

    A group is active if it is not left or blocked; membership is assumed where it isn't stated.
    """
    rows = groups.select(F.try_variant_get(F.try_parse_json("value"), "$", "struct<id:variant,name:variant,isMember:variant,isBlocked:variant>").alias("g"))
    g = F.col("g")
    active = v.flag(g["isMember"], True) & ~v.flag(g["isBlocked"], False)
    return rows.select(v.text(g["id"]).alias("id"), F.coalesce(v.text(g["name"]), F.lit("")).alias("name"), active.alias("active"))
