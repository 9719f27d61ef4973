"""Tokens as another implementation finds them, and prompts against all cuts."""

from __future__ import annotations

import base64
from pathlib import Path

import pytest

from parlance.functions import bpe
from parlance.operators import prompts as pr
from parlance.queries import tokens as tq

PATH = Path(tq.VOCABULARY.removeprefix("file://"))


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    if not PATH.exists():
        pytest.skip("no vocabulary")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, PATH.open("rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_of_texts(spark, sf_dir, reference):
    texts = ["", " ", "Hello  world\n\n it's 12,345!", "größe 😀 ￼ ñandú\t\x0b", "a" * 300, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["tokens"] for r in bpe.with_tokens(rows, bpe.vocabulary(spark, tq.VOCABULARY), tokens="text").collect()}
    assert got == {i: None if t is None else reference.encode_ordinary(t) for i, t in enumerate(texts)}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in tq.tokenize(spark, sf_dir).collect()} == {i: -1 if t is None else len(reference.encode_ordinary(t)) for i, t in docs.items()}


def test_errors_of_rows(spark, sf_dir, reference):
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        full, prompt = (reference.encode_ordinary(t) for t in (r["text"], r["text"][: len(r["text"]) // 2]))
        if not full or not prompt:
            want.add((r["doc_id"], "invalid tokens"))
        elif len(full) <= len(prompt):
            want.add((r["doc_id"], "no supervised tokens"))
        elif full[: len(prompt)] != prompt:
            want.add((r["doc_id"], "boundary changed"))
        elif len(full) > tq.LONGEST:
            want.add((r["doc_id"], "too long"))
    assert {tuple(r) for r in tq.validate_row_tokens_bpe(spark, sf_dir).collect()} == want and {"boundary changed", "too long"} <= {e for _, e in want}


def test_prompts_against_all_cuts(spark, sf_dir, reference):
    import hashlib

    chats = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role IN ('user', 'assistant')").collect():
        chats.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    want = {}
    for chat, turns in chats.items():
        turns = sorted(turns)
        for dropped in range(max(0, len(turns) - tq.LIMIT), len(turns)):
            prompt = tq.HEAD + "\n".join(f"\n[{role}]\n{text}" for _, role, text in turns[dropped:]) + tq.TAIL
            n = len(reference.encode_ordinary(prompt))
            if n <= tq.BUDGET:
                want[chat] = hashlib.sha256(prompt.encode()).hexdigest(), n, dropped, None
                break
        else:
            want[chat] = None, n, None, "the newest user message exceeds the limit by itself"
        if turns[-1][1] != "user":
            want[chat] = None, None, None, "a prompt requires a newest user message"
    assert {r["chat"]: tuple(r)[1:] for r in tq.fit_prompt(spark, sf_dir).collect()} == want


def test_fewest_dropped():
    assert [pr.fewest_dropped(9, lambda d, k=k: d >= k) for k in range(11)] == [*range(10), 9]


def test_vocabulary_is_checked(spark, tmp_path, monkeypatch):
    (tmp_path / "v").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        bpe.vocabulary(spark, str(tmp_path / "v"))
    monkeypatch.setattr(bpe, "LARGEST", 3)
    with pytest.raises(ValueError, match="too large"):
        bpe.vocabulary(spark, str(tmp_path / "v"))


def test_long_words_take_no_quadratic_time():
    import random
    import time

    ranks = {bytes([i]): i for i in range(256)} | {bytes([a, b]): 256 + 26 * a + b for a in range(97, 123) for b in range(97, 123)}
    word = bytes(random.Random(1).choices(range(97, 123), k=6000))
    start = time.process_time()
    got = bpe.merged(word, ranks)
    # all pairs looked at anew for each merge took some seconds
    assert time.process_time() - start < 1
    assert b"".join({v: k for k, v in ranks.items()}[t] for t in got) == word and len(got) < 4500


def test_a_text_is_encoded_word_by_word_once():
    encoder = bpe.Encoder({bytes([i]): i for i in range(256)} | {b"ab": 256, b" ab": 300})
    assert encoder.tokens("ab ab aab") == [256, 300, 32, 97, 256] and encoder.count("ab ab aab") == 5 and encoder.tokens("") == []
    assert set(encoder.known) == {"ab", " ab", " aab"}
