"""Chats: turns, their prompts and seeds, snapshots and their lineage, the registry of assistants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from parlance.functions.json import array, canonical_object, value


def turn_order_violations(turns: DataFrame) -> DataFrame:
    """``chat, turn, rule``: a first turn that is not the user's, a role twice in a row, another role."""
    order = Window.partitionBy("chat").orderBy("turn")
    before = turns.withColumn("_last", F.lag("role").over(order)).withColumn("_nth", F.row_number().over(order))
    rules = [
        F.when(~F.col("role").isin("user", "assistant"), "role"),
        F.when((F.col("_nth") == 1) & (F.col("role") != "user"), "start"),
        F.when(F.col("role") == F.col("_last"), "alternation"),
    ]
    return before.select("chat", "turn", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def context_fit(turns: DataFrame, limit: int, budget: int, tokens: Column) -> DataFrame:
    """The newest turns of each chat: ``limit`` at most, and no more tokens than ``budget``.

    Whole turns go, oldest first. ``kept`` is false for those, so a caller sees what was dropped;
    a newest turn that alone exceeds the budget is not kept either.
    """
    newest = Window.partitionBy("chat").orderBy(F.desc("turn"))
    upto = newest.rowsBetween(Window.unboundedPreceding, 0)
    used = turns.withColumn("nth", F.row_number().over(newest)).withColumn("used", F.sum(tokens).over(upto))
    return used.withColumn("kept", (F.col("nth") <= limit) & (F.col("used") <= budget)).drop("nth")


def transcript_digest(turns: DataFrame) -> DataFrame:
    """``chat, digest`` of the canonical turns in order; a changed digest means unsaved changes."""
    body = canonical_object({"content": value(F.col("text"), "string"), "role": value(F.col("role"), "string")})
    grouped = turns.groupBy("chat").agg(F.array_sort(F.collect_list(F.struct("turn", body.alias("b")))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x["b"]), ",")
    return grouped.select("chat", F.sha2(F.concat(F.lit("["), joined, F.lit("]")), 256).alias("digest"))


def dirty(turns: DataFrame, saved: DataFrame) -> DataFrame:
    """``chat, dirty``: whether the turns are no longer those of the digest that was saved (chat, digest), if any was."""
    known = saved.select("chat", F.col("digest").alias("_saved"))
    return transcript_digest(turns).join(known, "chat", "left").select("chat", (~F.col("digest").eqNullSafe(F.col("_saved"))).alias("dirty"))


def retry(turns: DataFrame) -> DataFrame:
    """Each chat without its last turn, if that is an assistant's, and the attempt that follows."""
    last = turns.groupBy("chat").agg(F.max_by(F.struct("turn", "role"), "turn").alias("last"))
    joined = turns.join(last, "chat")
    gone = (F.col("turn") == F.col("last.turn")) & (F.col("last.role") == "assistant")
    return joined.where(~gone).select(*turns.columns, F.when(F.col("last.role") == "assistant", 1).otherwise(0).alias("attempt"))


def leaves(snapshots: DataFrame) -> DataFrame:
    """Snapshots that are nobody's parent."""
    parents = snapshots.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
    return snapshots.join(parents, "id", "left_anti")


def without_leaf(snapshots: DataFrame, ident: Column) -> DataFrame:
    """All snapshots but one, which must be a leaf: the job fails if it has children."""
    children = snapshots.where(F.col("parent") == ident).agg(F.count("*").alias("n"))
    checked = snapshots.crossJoin(F.broadcast(children))
    guard = F.when(F.col("n") > 0, F.raise_error(F.lit("the snapshot has children")).cast("boolean")).otherwise(F.col("id") != ident)
    return checked.where(guard).drop("n")


def renamed_leaf(snapshots: DataFrame, ident: Column, name: str, column: str = "title") -> DataFrame:
    """The same with another title for one leaf."""
    leaf = leaves(snapshots).where(F.col("id") == ident).select("id", F.lit(name).alias("_new"))
    return snapshots.join(F.broadcast(leaf), "id", "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*snapshots.columns)


def weighted_throughput(turns: DataFrame, *by: str) -> DataFrame:
    """Tokens per second, weighted by tokens, over turns with a rate; null without any."""
    rated = F.col("rate").isNotNull()
    total = F.sum(F.when(rated, F.col("tokens")))
    return turns.groupBy(*by).agg((F.sum(F.col("tokens") * F.col("rate")) / F.nullif(total, F.lit(0))).alias("throughput"))


def telemetry_violations(turns: DataFrame, counts: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """``chat, turn, field`` of counts below zero or absent and metrics that are negative or not finite."""
    rules = [F.when(F.col(c).isNull() | (F.col(c) < 0), c) for c in counts]
    rules += [F.when(F.isnan(m) | (F.col(m) < 0) | (F.abs(m) == float("inf")), m) for m in metrics]
    return turns.select("chat", "turn", F.explode(F.array_compact(F.array(*rules))).alias("field"))


def context_pressure(tokens: Column, limit: int) -> Column:
    return 100.0 * tokens / limit


def prefix_collisions(runs: DataFrame, ident: str, length: int = 8) -> DataFrame:
    """Runs with ``shared``: how many have the same first characters, this one included."""
    prefix = F.substring(ident, 1, length)
    counts = runs.groupBy(prefix.alias("_p")).agg(F.count("*").alias("shared"))
    return runs.withColumn("_p", prefix).join(counts, "_p").drop("_p")


def runs_with_datasets(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Runs with what they were trained on; a run whose dataset is gone stays, with an error."""
    joined = runs.join(datasets.withColumnRenamed("id", "_d"), F.col("dataset_id") == F.col("_d"), "left")
    return joined.withColumn("error", F.when(F.col("_d").isNull(), "dataset not found")).drop("_d")


def registry(base: DataFrame, runs: DataFrame, chats: DataFrame) -> DataFrame:
    """``name, type, entry``: the base models, the runs (FAULT if they have an error), the saved chats."""
    b = base.select("name", F.lit("BASE").alias("type"), F.lit("READY").alias("entry"))
    ok = F.col("error").isNull()
    r = runs.select("name", F.when(ok, "CONSTRUCT").otherwise("—").alias("type"), F.when(ok, "READY").otherwise("FAULT").alias("entry"))
    return b.unionByName(r).unionByName(chats.select("name", F.lit("TRACE").alias("type"), F.lit("READY").alias("entry")))


def flatten_fields(row: DataFrame) -> DataFrame:
    """``name, value`` for every field of one row with nested structs; names of a path parted by spaces."""
    pairs = []

    def walk(fields, path: str, label: str) -> None:
        for f in sorted(fields, key=lambda f: f.name):
            at, name = f"{path}.`{f.name}`" if path else f"`{f.name}`", f"{label} {f.name}".strip()
            if f.dataType.typeName() == "struct":
                walk(f.dataType.fields, at, name)
            else:
                pairs.append((name, at))

    walk(row.schema.fields, "", "")
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(p).cast("string").alias("value")) for n, p in pairs])))


def normalized_policy(settings: Column, kind: StructType, without: tuple[str, ...] = ("specified",)) -> Column:
    """Canonical JSON of one struct of settings: sorted names, nulls kept, the names in ``without`` left out."""

    def shown(x: Column, t: DataType) -> Column:
        if isinstance(t, StructType):
            return canonical_object({f.name: shown(x[f.name], f.dataType) for f in t.fields})
        if isinstance(t, ArrayType):
            return F.coalesce(array(F.transform(x, lambda y: shown(y, t.elementType))), F.lit("null"))
        return value(x, "string" if isinstance(t, StringType) else "number")

    return canonical_object({f.name: shown(settings[f.name], f.dataType) for f in kind.fields if f.name not in without})


def command_matches(typed: DataFrame, commands: list[str]) -> DataFrame:
    """The rows of ``typed`` with each ``command`` that begins with what was typed."""
    names = F.array(*[F.lit(c) for c in commands])
    usable = F.col("typed").startswith("/") & ~F.col("typed").rlike("(?U)\\s")
    return typed.where(usable).withColumn("command", F.explode(names)).where(F.col("command").startswith(F.col("typed")))
