"""SimHash, exact and passage deduplication, and sharding, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from parlance.llm import exactdup, sharding, simhash, suffixdup
from parlance.llm.queries import ORACLE_SQL


def brute_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def roots(nodes, linked):
    """Smallest node of each component, by search."""
    out = {}
    for start in sorted(nodes):
        if start in out:
            continue
        todo = [start]
        out[start] = start
        while todo:
            x = todo.pop()
            for y in nodes:
                if y not in out and linked(x, y):
                    out[y] = start
                    todo.append(y)
    return out


def test_simhash_equals_brute_force(spark, documents):
    docs = {r["doc_id"]: r["text"] for r in documents.collect()}
    fp = {i: brute_fingerprint(t) for i, t in docs.items()}
    want = roots(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = simhash.simhash_groups(documents).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}
    kept = simhash.near_dedup(documents)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == documents.columns


@pytest.mark.parametrize("bucket", [4, 4096])
def test_simhash_links_survive_large_buckets(spark, bucket):
    """Many fingerprints that share a half, so that buckets overflow and go on to narrower keys."""
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(40, 56) for b in range(40, 56)} | {base ^ (0b111 << s) for s in range(0, 30, 7)} | {0xF0F0 << 20})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    want = roots(list(range(len(fps))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    found = {r["fp"]: r["component_id"] for r in simhash.groups(df, bucket).collect()}
    assert [found[f] for f in signed] == [want[i] for i in range(len(fps))]


def test_simhash_edges(edges):
    got = simhash.simhash_groups(edges()).collect()
    assert len(got) == 12 and {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3, 9)} == {"0" * 16}
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 5)} == {4}
    kept = simhash.near_dedup(edges())
    assert kept.columns == edges().columns and Counter(r["doc_id"] for r in kept.collect()).most_common(1)[0][1] == 1
    assert simhash.simhash_groups(edges(0)).count() == 0 and simhash.near_dedup(edges(0)).count() == 0


@pytest.mark.parametrize("bits", [62, 1])
def test_exact_groups(edges, bits):
    """With one bit of fingerprint, almost all texts of a length collide."""
    rows = edges().collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    got = exactdup.exact_groups(edges(), bits=bits).collect()
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert exactdup.exact_groups(edges(0)).count() == 0


@pytest.mark.parametrize("bits", [62, 1])
def test_exact_groups_of_huge_texts(spark, bits, monkeypatch):
    """Texts of several parts: copies, one that differs in its last byte, ties and nulls; hashed and compared in parts."""
    monkeypatch.setattr(exactdup, "PART", 1000)
    big = "".join(chr(97 + i * i % 23) for i in range(4500))
    texts = [(1, big), (2, big), (3, big[:-1] + "!"), (3, big), (4, None), (5, ""), (None, big), (6, "short"), (7, big[:3000]), (8, big[:3000])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = exactdup.exact_groups(df, bits=bits, huge_bytes=2000).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    plain = exactdup.exact_groups(df, bits=bits).collect()
    assert sorted(map(str, map(tuple, plain))) == sorted(map(str, want))


def test_fingerprint_needs_little_memory():
    import tracemalloc

    text = bytes(range(1, 129)) * (1 << 16)
    tracemalloc.start()
    exactdup.fingerprint(text)
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()


def test_exact_oracle(spark, sf_dir, documents):
    from oracle import connect, same

    same(exactdup.exact_groups(documents), connect(sf_dir), ORACLE_SQL["op4_exact_dedup"])


def test_polynomials_compose():
    for p, base in exactdup.FIELDS:
        value = lambda t: (sum((c + 1) * pow(base, len(t) - 1 - i, p) for i, c in enumerate(t)) % p, len(t))
        a, b = b"some text" * 3, "ñandú 😀".encode()
        assert exactdup.combine(p, base, value(a), value(b)) == value(a + b)
    big = bytes(range(256)) * 60
    assert exactdup.fingerprint(big) >> 31 == sum((c + 1) * pow(1000003, len(big) - 1 - i, 2147483647) for i, c in enumerate(big)) % 2147483647


def brute_removed(texts, length):
    where = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            where[t[i : i + length]].append((d, i))
    gone = [bytearray(len(t)) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = b"\1" * length
    return gone


@pytest.mark.parametrize("length", [50, 400])
def test_repeats_equal_brute_force(spark, documents, length):
    few = documents.orderBy("doc_id").limit(90)
    rows = few.collect()
    # a passage in most texts, with other surroundings each time, overlapping itself, and copies
    passage = "the quick brown fox jumps over " * 14
    texts = [(r["text"][:3000] + (f" {r['doc_id']} {passage[r['doc_id'] % 9 :]}{r['doc_id']}" if r["doc_id"] % 3 else "")) for r in rows] + ["ab" * 500, "ab" * 300, "xyz!" * (length // 4 + 9), "." * (length + 3), passage * 3, "", rows[5]["text"], "x" * length]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, None)], "doc_id long, text string")
    data = [t.encode() for t in texts]
    gone = brute_removed(data, length)
    got = {r["doc_id"]: r for r in suffixdup.remove_repeats(df, length=length).collect()}
    for i, (t, g) in enumerate(zip(data, gone, strict=True)):
        kept = bytes(c for c, x in zip(t, g, strict=True) if not x)
        spans = len(re.findall(b"\1+", bytes(g)))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(t), sum(g), spans, hashlib.sha256(kept).hexdigest()), i
    assert got[1000]["n_bytes"] == 0


def test_repeats_in_classes_too_large_for_a_task(spark, monkeypatch):
    monkeypatch.setattr(suffixdup, "CLASS", 8)
    seed = "".join(chr(97 + i * 7 % 26) for i in range(40))
    texts = [f"{i:05d}" * 14 + seed + f"{i // 2:05d}" * 14 for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = brute_removed([t.encode() for t in texts], 60)
    got = {r["doc_id"]: r["n_removed"] for r in suffixdup.remove_repeats(df, length=60).collect()}
    assert got == {i: sum(g) for i, g in enumerate(gone)}


def test_repeats_edges(edges):
    got = suffixdup.remove_repeats(edges()).collect()
    assert len(got) == 12 and all(r["n_removed"] == 1_100_000 for r in got if r["doc_id"] in (6, 8))
    assert suffixdup.remove_repeats(edges(0)).count() == 0


def brute_cuts(sizes, shards):
    """The least capacity by trying each in turn, and the greedy shards."""
    low = max(max(sizes), -(-sum(sizes) // shards))
    while True:
        out, load = [0], 0
        for s in sizes:
            if load + s > low:
                out.append(0)
                load = 0
            load += s
            out[-1] += 1
        if len(out) <= shards:
            return low, out
        low += 1


def test_sharding_is_minimax(spark, documents):
    docs = documents.limit(120)
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256((r["text"] or "").encode()).digest()].append(r)
    order = sorted(groups)
    sizes = [sum(len((r["text"] or "").encode()) + 1 for r in groups[k]) for k in order]
    capacity, counts = brute_cuts(sizes, 8)
    got = sharding.assign_shards(docs).collect()
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) == capacity
    for s in load:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    shard_of = defaultdict(set)
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    for r in got:
        shard_of[texts[r["doc_id"]]].add(r["shard"])
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(x) == 1 for x in shard_of.values())


@pytest.mark.parametrize("held", [2, 100_000])
def test_sharding_search_in_rounds(spark, documents, held, monkeypatch):
    """With few ends on the driver the capacity is narrowed by aggregates first."""
    monkeypatch.setattr(sharding, "HELD", held)
    docs = documents.limit(60)
    sizes = docs.groupBy(F.sha2("text", 256).alias("k")).agg(F.sum(F.octet_length("text") + 1).alias("s")).orderBy("k").collect()
    capacity, _ = brute_cuts([r["s"] for r in sizes], 8)
    assert sharding.assign_shards(docs).groupBy("shard").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] == capacity


def test_sharding_edges(edges):
    got = sharding.assign_shards(edges()).collect()
    assert len(got) == 12 and len({(r["shard"], r["slot"]) for r in got}) == 12
    assert sharding.assign_shards(edges(0)).count() == 0


def test_written_shards_hold_all_texts(spark, documents):
    from parlance.llm.common import shared_dir

    path = f"{shared_dir(spark)}/shards-{hashlib.sha256(b'test').hexdigest()[:8]}-{id(documents)}"
    where = sharding.write_shards(documents, path)
    back = spark.read.parquet(path)
    assert back.count() == documents.count() == where.count()
    assert back.join(documents.select("doc_id", F.col("text").alias("t")), "doc_id").where("NOT text <=> t").count() == 0


def test_written_shards_keep_null_and_repeated_ids(spark, edges, tmp_path):
    docs = edges()
    where = sharding.write_shards(docs, str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards")).collect()
    key = lambda r: (r["doc_id"] or -1, r["text"] or "")
    assert sorted(map(key, back)) == sorted(map(key, docs.collect()))
    slots = {(r["shard"], r["slot"]) for r in where.collect()}
    assert len(slots) == len(back) == 12 and {(r["shard"], r["slot"]) for r in back} == slots
    assert sharding.write_shards(docs.limit(0), str(tmp_path / "none")).count() == 0


def brute_passages(texts, size):
    where = defaultdict(set)
    for d, t in enumerate(texts):
        ws = t.split()
        for i in range(len(ws) - size + 1):
            where[tuple(ws[i : i + size])].add(d)
    return {d for x in where.values() if len(x) > 1 for d in x}


@pytest.mark.parametrize("size", [9, 51])
def test_shared_passages_equal_brute_force(spark, documents, size, monkeypatch):
    """Passages of one word less and of just as many, short and long texts, copies; in blocks smaller than the long ones."""
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    filler = lambda n: " ".join(word() for _ in range(n))
    passage = [word() for _ in range(size)]
    texts = [r["text"] or "" for r in documents.orderBy("doc_id").limit(80).collect()]
    texts += [f"{filler(20)} {' '.join(passage)} {filler(20)}", f"{filler(300)}\n{'  '.join(passage)}\t{filler(300)}", " ".join(passage[1:]) + " " + filler(30), " ".join(passage[:-1]), "", "   "]
    inside = [word() for _ in range(size)]
    texts += [filler(2 * size), filler(500) + " " + " ".join(inside) + " " + filler(700), " ".join(inside)]
    twice = " ".join(word() for _ in range(size))
    texts += [twice + " " + filler(9) + " " + twice, filler(size - 1), filler(size - 1)]
    texts += [texts[3], "x " * (size - 1) + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in suffixdup.remove_repeats(df, passage=size).where("shares_passage").collect()}
    assert got == brute_passages(texts, size)
    data = [t.encode() for t in texts]
    monkeypatch.setattr(suffixdup, "BLOCK", 700)
    parts = defaultdict(set)
    for d, t in enumerate(data):
        for block, number, first in suffixdup._word_blocks([t], size):
            parts[d] |= set(suffixdup.word_windows(block, first, size)[1].tolist())
    assert all(len(parts[d]) == len({tuple(t.split()[i : i + size]) for i in range(len(t.split()) - size + 1)}) for d, t in enumerate(data))
    assert not suffixdup.shared_passages(df.select(F.col("text").cast("binary")).limit(0), size).count()
