"""Tokens over ``documents`` and ``conversations``, by a public byte-pair vocabulary that the box has."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import bpe
from parlance.operators import evaluation as ev
from parlance.operators import prompts as pr
from parlance.queries.chat import turns
from parlance.queries.registry import query, table

VOCABULARY = os.environ.get("PARLANCE_VOCABULARY", "file:///opt/tokenizers/byte_bpe_50k.tiktoken")
LIMIT, BUDGET, LONGEST = 8, 300, 2048
HEAD, TAIL = "You are T. Write only T's next message.\n\nConversation:\n", "\n\n[next response]"


@query()
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every text: how many, and a digest of them."""
    d = bpe.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.vocabulary(spark, VOCABULARY), tokens="text")
    return d.select("doc_id", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join("tokens", ","), 256).alias("digest"))


@query()
def validate_row_tokens_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose prompt is the first half of a text and whose completion is the rest: what keeps them from training."""
    half = F.floor(F.length("text") / 2).cast("int")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("whole"), F.substring("text", F.lit(1), half).alias("start"))
    made = bpe.with_tokens(rows, bpe.vocabulary(spark, VOCABULARY), full="whole", prompt="start")
    return ev.token_row_errors(made, LONGEST)


@query()
def fit_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each conversation the prompt of its newest turns that fits the limit."""
    entry = F.concat(F.lit("\n["), "role", F.lit("]\n"), F.coalesce("text", F.lit("")))
    chats = pr.newest_turns(turns(spark, sf_dir, True), LIMIT, entry)
    return pr.fit_prompts(chats, bpe.vocabulary(spark, VOCABULARY), BUDGET, HEAD, TAIL).select("chat", F.sha2("prompt", 256).alias("digest"), "tokens", "dropped", "error")
