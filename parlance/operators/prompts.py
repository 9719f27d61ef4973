"""Prompts that fit: as many of a chat's newest turns as a tokenizer's limit lets be."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from parlance.functions.bpe import Encoder


def newest_turns(turns: DataFrame, limit: int, entry: Column) -> DataFrame:
    """``chat, role, entries, earlier``: at most ``limit`` newest turns in order, the last one's role, and how many were before these."""
    place = F.row_number().over(Window.partitionBy("chat").orderBy(F.desc("turn")))
    counts = turns.groupBy("chat").agg(F.count("*").alias("n"))
    last = turns.withColumn("place", place).where(F.col("place") <= limit)
    lists = last.groupBy("chat").agg(F.array_sort(F.collect_list(F.struct("turn", entry.alias("entry"), "role"))).alias("e"))
    return lists.join(counts, "chat").select("chat", F.element_at("e.role", -1).alias("role"), F.col("e.entry").alias("entries"), (F.col("n") - F.size("e")).alias("earlier"))


def fewest_dropped(n: int, fits) -> int:
    """The least d in [0, n) for which ``fits(d)``, given that what fits with d fits with more; n if none does."""
    low, high = 0, n
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def fit_prompts(chats: DataFrame, ranks: Broadcast, budget: int, head: str, tail: str, between: str = "\n") -> DataFrame:
    """``chat, prompt, tokens, dropped, error`` of rows (chat, role, entries, earlier).

    A prompt is the head, the entries from one on, and the tail. Whole entries go, oldest first, until the prompt
    has ``budget`` tokens at most; counts of parts don't add up, so prompts are encoded whole, a few for each chat: a
    shorter one never has more tokens here, as entries are cut apart at line breaks. ``error`` says why there is no
    prompt: the newest turn is not a user's, or too long by itself.
    """

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(ranks.value)
        for batch in batches:
            out = []
            for role, entries, earlier in zip(*(batch.column(c).to_pylist() for c in ("role", "entries", "earlier")), strict=True):
                if role != "user":
                    out.append((None, None, None, "a prompt requires a newest user message"))
                    continue
                made = {}

                def fits(d, entries=entries, made=made):
                    prompt = head + between.join(entries[d:]) + tail
                    made[d] = prompt, encoder.count(prompt)
                    return made[d][1] <= budget

                d = fewest_dropped(len(entries), fits)
                if d == len(entries):
                    out.append((None, made[d - 1][1], None, "the newest user message exceeds the limit by itself"))
                else:
                    out.append((*made[d], earlier + d, None))
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("chat"), *arrays], names=["chat", "prompt", "tokens", "dropped", "error"])

    return chats.mapInArrow(run, StructType([StructField("chat", chats.schema["chat"].dataType), *StructType.fromDDL("prompt string, tokens long, dropped long, error string").fields]))
