"""Byte-pair encoding by ranked merges, in tasks.

A vocabulary is a table of byte strings and ranks: a text is cut into words by a pattern, and in each word the
pair with the lowest rank is merged until none is left that the table knows. The table is broadcast, so its size is
checked first.
"""

from __future__ import annotations

import base64
from array import array

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

# Fixed value: how byte-level vocabularies of this kind cut a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a vocabulary file at most, and words whose tokens a task remembers.
LARGEST, REMEMBERED = 64 << 20, 1 << 18
#: More than any rank.
NO_RANK = 1 << 62


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    # where parts begin, and the rank of each part with the next one; a merge changes two of these
    cuts = list(range(len(word) + 1))
    pairs = [ranks.get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pairs and (best := min(pairs)) != NO_RANK:
        i = pairs.index(best)
        del cuts[i + 1], pairs[i]
        if i:
            pairs[i - 1] = ranks.get(word[cuts[i - 1] : cuts[i + 1]], NO_RANK)
        if i < len(pairs):
            pairs[i] = ranks.get(word[cuts[i] : cuts[i + 2]], NO_RANK)
    return [ranks[word[i:j]] for i, j in zip(cuts, cuts[1:])]


class Known(dict):
    """The tokens of words as the bytes of 32-bit numbers, each word's worked out when it is first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        made = array("i", merged(word.encode(), self.ranks)).tobytes()
        if len(self) < REMEMBERED:
            self[word] = made
        return made


class Encoder:
    """Encodes texts; made in a task from a broadcast vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.words, self.known = regex.compile(pattern), Known(ranks)

    def packed(self, text: str) -> bytes:
        """The tokens of a text, four bytes each."""
        return b"".join(map(self.known.__getitem__, self.words.findall(text)))

    def tokens(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 4


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The ranks of a file of lines "base64 rank", broadcast; ValueError for one that is too large for that."""
    lines = spark.read.text(path)
    size = lines.selectExpr("coalesce(sum(length(value) + 1), 0) AS n").first()["n"]
    if size > LARGEST:
        raise ValueError(f"a vocabulary of {size} bytes is too large to broadcast")
    ranks = {base64.b64decode(a): int(b) for a, b in (r["value"].split() for r in lines.where("value <> ''").collect())}
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("a vocabulary needs all single bytes")
    return spark.sparkContext.broadcast(ranks)


def with_tokens(rows: DataFrame, ranks: Broadcast, **columns: str) -> DataFrame:
    """``rows`` with arrays of tokens: ``name=text column``. A null text has null tokens."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = Encoder(ranks.value)

        def lists(texts: pa.Array) -> pa.Array:
            made = [None if t is None else encoder.packed(t) for t in texts.to_pylist()]
            ends = np.cumsum([0, *(len(m or b"") // 4 for m in made)], dtype=np.int32)
            flat = pa.array(np.frombuffer(b"".join(m for m in made if m), np.int32))
            return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([m is None for m in made], pa.bool_()))

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *(lists(batch.column(c)) for c in columns.values())], names=[*batch.schema.names, *columns])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *(StructField(n, ArrayType(IntegerType())) for n in columns)]))
