"""Ranked search against the formula worked out term by term."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from oracle import connect, same

from parlance.llm import search
from parlance.llm.queries import ORACLE_SQL, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "term string, doc_id long, shard long, text string, score long, q long, `a.b` int"


def lowered(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, k=10):
    found = [(i, Counter(t)) for i, text in docs if (t := lowered(text))]
    n_docs, total = len(found), sum(sum(c.values()) for _, c in found)
    df, out = Counter(t for _, c in found for t in c), []
    for item, text in queries:
        scored = []
        for doc_id, c in found:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(lowered(text)) if t in c)
            if score > 0:
                scored.append((-score, doc_id if doc_id is not None else 1 << 63))
        out += [(item, rank, doc if doc < 1 << 63 else None, -score) for rank, (score, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def crowd(n=300, seed=3):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(3000)] + ["Größe", "İx", "naïve", "A1"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in rng.sample(range(10 * n), n)]
    docs += [(90_000 + i, docs[5][1]) for i in range(40)]  # equal scores
    docs += [(None, docs[6][1]), (docs[7][0], docs[7][1]), (95_000, None), (95_001, ""), (95_002, " .,;\n\t"), (95_003, "W3-W4_w5[w6]{w7}~w8\x7fw9@A1"), (95_004, "alpha w3 " * 50_000)]
    queries = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(25)]
    return docs, [*queries, (100, docs[5][1]), (101, None), (102, ""), (103, "unheard of"), (104, "w3"), (104, "w3"), (None, "w4 größe GRÖßE")]


def frames(spark, docs, queries):
    d = spark.createDataFrame([("t", i, 1, text, 2, 3, 4) for i, text in docs], DOCS)
    q = spark.createDataFrame([("t", i, 1, text, 2, 3, 4) for i, text in queries], DOCS.replace("doc_id", "item_id"))
    return d, q


@pytest.mark.parametrize(("postings", "query_bytes"), [(1 << 21, 1 << 24), (500, 1 << 24), (40, 700)])
def test_against_formula(spark, postings, query_bytes):
    docs, queries = crowd()
    d, q = frames(spark, docs, queries)
    index = search.build(d.repartition(5), postings=postings)
    assert found(search.search(index, q, query_bytes=query_bytes)) == brute(docs, queries)
    assert found(search.search(index, q, k=3)) == brute(docs, queries, 3)


def test_of_whole_table(spark, sf_dir):
    same(QUERIES["op13_search"](spark, sf_dir), connect(sf_dir), ORACLE_SQL["op13_search"])


def test_empty_tables(spark):
    docs, queries = crowd(20)
    d, q = frames(spark, docs, queries)
    assert search.ranked_search(d.limit(0), q, item_id="item_id").collect() == []
    assert search.ranked_search(d, q.limit(0)).collect() == []
    assert search.ranked_search(d.where("text IS NULL"), q).collect() == []


def test_pieces_of_long_texts(monkeypatch):
    text = b"aa,B1 " * 100 + "ü".encode() * 30 + b" z"
    whole = [t for x in search.terms_of(text) for t in x]
    monkeypatch.setattr(search, "PIECE", 7)
    assert [t for x in search.terms_of(text) for t in x] == whole
    assert whole[:2] == [b"aa", b"b1"] and len(whole) == 202
