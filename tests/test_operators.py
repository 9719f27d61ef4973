"""Operators against plain Python on small random inputs."""

from __future__ import annotations

import datetime as dt
import difflib
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import render as rd
from parlance.functions import text as tx
from parlance.functions.json import quoted
from parlance.operators import artifacts as ar
from parlance.operators import context as cx
from parlance.operators import evaluation as ev
from parlance.operators import matching as mt
from parlance.operators import panel as pn
from parlance.operators import resampling as rs
from parlance.operators import selection as sel
from parlance.operators import transcripts as tr
from parlance.plans.bitmaps import broadcast_bitmap
from parlance.plans.durable import fresh_path
from parlance.plans.ordering import global_rank

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("seed", [1, 2])
def test_last_k_is_causal(spark, seed):
    """One hot chat, ties, and long stretches that are edited or deleted too late to be seen."""
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        sent = rng.randrange(120)
        edited = sent + rng.choice([0, 3, 300]) if rng.random() < 0.5 else None
        deleted = sent + rng.choice([2, 300]) if rng.random() < 0.4 else None
        rows.append((i, 0 if rng.random() < 0.8 else rng.randrange(1, 4), sent, edited, deleted))
    schema = "id long, chat long, sent_at timestamp_ntz, edited_at timestamp_ntz, deleted_at timestamp_ntz"
    messages = spark.createDataFrame([(i, c, at(s), at(e), at(d)) for i, c, s, e, d in rows], schema)
    targets = [(1000 + j, rng.randrange(4), rng.randrange(130), *((50, 7) if j % 2 else (None, None))) for j in range(40)]
    tdf = spark.createDataFrame([(t, c, at(x), at(b), k) for t, c, x, b, k in targets], "target_id long, chat long, at timestamp_ntz, bound_at timestamp_ntz, bound_id long")
    want = {}
    for t, c, x, b, k in targets:
        seen = [(s, i) for i, c2, s, e, d in rows if c2 == c and s < x and (e is None or e < x) and (d is None or d < x) and (b is None or (s, i) > (b, k))]
        for nth, (_, i) in enumerate(sorted(seen, reverse=True)[:5], 1):
            want[t, nth] = i
    for f in (cx.last_k, cx.last_k_by_range):
        assert {(r["target_id"], r["nth"]): r["id"] for r in f(messages, tdf, 5).collect()} == want


def test_last_k_carries_chats_over_ranges(spark):
    """One chat fills many ranges, others share some; ids are texts, targets come without bounds."""
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        sent = rng.randrange(400)
        edited = sent + rng.choice([0, 5, 200, 2000]) if rng.random() < 0.3 else None
        deleted = sent + rng.choice([1, 900]) if rng.random() < 0.2 else None
        rows.append((f"m{i}", "hot" if rng.random() < 0.7 else rng.choice("abc"), sent, edited, deleted))
    df = spark.createDataFrame([(i, c, at(s), at(e), at(d)) for i, c, s, e, d in rows] + [("none", None, at(1), None, None), (None, "hot", at(1), None, None)], "id string, chat string, sent_at timestamp, edited_at timestamp, deleted_at timestamp")
    targets = [(j, rng.choice(["hot", "hot", "a", "b", "empty"]), rng.randrange(420)) for j in range(150)]
    tdf = spark.createDataFrame([(t, c, at(x)) for t, c, x in targets], "target_id int, chat string, at timestamp")
    want = {}
    for t, c, x in targets:
        seen = [(s, i) for i, c2, s, e, d in rows if c2 == c and max(y for y in (s, e, d) if y is not None) < x]
        want |= {(t, nth): i for nth, (_, i) in enumerate(sorted(seen, reverse=True)[:32], 1)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = cx.last_k(df, tdf, 32)
        assert {(r["target_id"], r["nth"]): r["id"] for r in got.collect()} == want
        assert cx.last_k(df.limit(0), tdf, 32).count() == 0 and cx.last_k(df, tdf.limit(0), 32).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_global_rank_has_no_gaps(spark):
    df = spark.range(500).select(F.pmod(F.col("id") * 7919, F.lit(500)).alias("x"))
    got = global_rank(df, [F.col("x")]).collect()
    assert all(r["rank"] == r["x"] + 1 for r in got) and len(got) == 500
    assert global_rank(df.where("x < 0"), [F.col("x")]).count() == 0


@pytest.mark.parametrize(("n", "want"), [(10, {"train": 6, "valid": 2, "test": 2}), (3, {"train": 1, "valid": 1, "test": 1})])
def test_split_sizes(spark, n, want):
    df = spark.range(n).select("id", (F.lit(T0) + F.make_interval(mins=F.col("id").cast("int"))).alias("sent_at"))
    got = sel.chronological_split(df, "sent_at", "id", 0.2, 0.2)
    assert {r["split"]: r["n"] for r in sel.split_counts(got).collect()} == want
    with pytest.raises(ValueError):
        sel.chronological_split(df.limit(2), "sent_at", "id", 0.2, 0.2)
    with pytest.raises(ValueError):
        sel.check_ratios(1, 0.5, 0.5)


def test_longest_match_equals_difflib(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(5, 40)))
    shared = [word() * 2 for _ in range(3)]
    train = [word() + rng.choice(shared) + word() for _ in range(6)] + ["", "abc"]
    cand = [word() + (rng.choice(shared) if rng.random() < 0.6 else "") + word() for _ in range(20)] + ["", train[0]]
    c = spark.createDataFrame(list(enumerate(cand)), "cand_id int, norm string")
    t = spark.createDataFrame(list(enumerate(train)), "train_id int, norm string")
    got = {r["cand_id"]: r["longest"] for r in mt.longest_matches(c, t, 20).collect()}
    for i, x in enumerate(cand):
        best = max(difflib.SequenceMatcher(None, x, y, autojunk=False).find_longest_match().size for y in train)
        assert got[i] == (best if best >= 20 else 0)
    exact = {r["cand_id"] for r in mt.exact_matches(c, t).collect()}
    assert exact == {i for i, x in enumerate(cand) if x and x in train}


def test_longest_match_of_one_passage_in_all_texts_and_of_chance_runs(spark):
    """A passage that all texts share, texts of two letters (runs of windows from several texts), nulls and doubled lengths."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("ab") for _ in range(n))
    passage = noise(45)
    train = [noise(30) + passage + noise(30) for _ in range(12)] + ["z" * 70, "", None, "0123456789" * 4]
    cand = [noise(30) + passage + noise(30) for _ in range(25)] + [noise(90) for _ in range(10)]
    cand += ["z" * n for n in (7, 8, 9, 15, 16, 17, 70, 71, 200)] + ["", None, "0123456789" * 4, passage[:20] + "z" * 40]
    c = spark.createDataFrame(list(enumerate(cand)), "cand_id int, norm string")
    t = spark.createDataFrame(list(enumerate(train)), "train_id int, norm string")
    got = {r["cand_id"]: r["longest"] for r in mt.longest_matches(c, t, 8).collect()}
    for i, x in enumerate(cand):
        best = max(difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).find_longest_match().size for y in train)
        assert got[i] == (best if best >= 8 else 0), i
    assert mt.longest_matches(c, t.where("false"), 8).where("longest > 0").isEmpty() and mt.longest_matches(c.where("false"), t, 8).isEmpty()


def test_windows_that_no_training_text_has_are_no_rows(spark):
    """Of candidates' windows only those that the bitmap may hold leave their task; no pair that shares a seed is lost."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh é😀") for _ in range(n))
    train = [noise(200) for _ in range(8)] + ["", None, "short"]
    cand = [noise(300) + (rng.choice(train[:8])[20:90] if i % 3 == 0 else "") + noise(300) for i in range(30)] + ["", None]
    c = spark.createDataFrame(list(enumerate(cand)), "cand_id int, norm string")
    t = spark.createDataFrame(list(enumerate(train)), "train_id int, norm string")
    seeds = {(j, y[k : k + 16]) for j, y in enumerate(train) if y and len(y) >= 50 for k in range(0, len(y) - 15, 35)}
    pairs = {(i, j) for i, x in enumerate(cand) for j, w in seeds if x and w in x}
    assert pairs and {tuple(r) for r in mt.seed_pairs(c, t, 50).collect()} == pairs
    every = mt.positioned(t, "train_id", "norm", 50)
    bitmap = broadcast_bitmap(every, "h1", "h2")
    kept = {(r["cand_id"], r["pos"]) for r in mt.positioned(c, "cand_id", "norm", 50, bitmap=bitmap).collect()}
    known = {y[k : k + 50] for y in train if y for k in range(len(y) - 49)}
    shared = {(i, k) for i, x in enumerate(cand) if x for k in range(len(x) - 49) if x[k : k + 50] in known}
    assert shared <= kept and len(kept) < len(shared) + 20 < mt.positioned(c, "cand_id", "norm", 50).count() // 10


def test_normalize_text(spark):
    texts = ["Straße ﬁn", "ΑΣ", "  a\x1cB ", "", "İx", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    import unicodedata

    for r in df.select("i", tx.normalize_text(F.col("t")).alias("n")).collect():
        t = texts[r["i"]]
        assert r["n"] == (None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def test_text_features_at_the_edges(spark):
    rows = spark.createDataFrame([("",), ("  aaa!? @bob www.x ",), ("Hi \U0001f600\nyou…",)], "t string")
    f = tx.features(F.col("t"))
    empty, loud, two = [r.asDict() for r in rows.select(*[c.alias(n) for n, c in f.items()]).collect()]
    assert empty["lines"] == 1 and empty["words"] == 0 and empty["terminal_punctuation_rate"] == 0
    assert loud["repeated_character_rate"] == loud["mention_rate"] == loud["url_rate"] == loud["question_rate"] == loud["starts_lowercase_rate"] == 1
    assert two["emoji_rate"] == 1 and two["lines"] == 2 and two["words"] == 3 and two["terminal_punctuation_rate"] == 1


def test_json_quotes_like_python(spark):
    import json

    texts = ['a"b\\c', "\n\t\x0b\x1f\x7f", "\\u000B", "é 😀", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(quoted(F.col("t"))).collect()
    assert [r[0] for r in got] == [json.dumps(t, ensure_ascii=False) for t in texts]


def test_rendering(spark):
    m = F.array(F.struct(F.lit(3).alias("start"), F.lit(1).alias("length"), F.lit("Ann").alias("name")))
    one = spark.createDataFrame([("\U0001f600 x!", "@@x a")], "a string, b string")
    at_sign = F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("length"), F.lit("Bo").alias("name")))
    name = rd.person_name(F.lit(" @@ Al  [x|y] "))
    header = rd.message_header(F.lit("A"), F.lit("T"), F.lit(True), F.lit(2), F.lit(True), rd.reply_text(F.lit(True), F.lit("B"), F.lit('s"')))
    line = rd.reaction_line(F.lit("A"), F.lit("+"), F.lit(True), F.lit("B"))
    talk = rd.conversation(F.lit("T"), F.array(F.struct(F.lit("A").alias("header"), F.lit("hi").alias("content")), F.struct(F.lit("r").alias("header"), F.lit(None).cast("string").alias("content"))))
    got = one.select(rd.render_mentions(F.col("a"), m), rd.render_mentions(F.col("b"), at_sign), name, header, line, talk).first()
    assert got[0] == "\U0001f600 @Ann!" and got[1] == "@@Bo a" and got[2] == "Al (x/y)"
    assert got[3] == 'A | mentions @T | 2 attachments | reply to B: "s\\""' and got[4] == 'A removed "+" reaction from B\'s message'
    assert got[5] == "You are T. Write only T's next message.\n\nConversation:\n\n[A]\nhi\n\n[r]\n\n[next response]"


def test_likelihood_weighs_examples_or_tokens(spark):
    s = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 27.0)], "example_id int, tokens double, nll double")
    r = ev.likelihood(s).first()
    assert r["macro_mean_nll"] == 2.0 and r["corpus_mean_nll"] == pytest.approx(2.8)


def mixed(x):
    for _ in range(2):
        x = (x ^ x >> 16) * rs.FACTOR & 0xFFFFFFFF
    return x ^ x >> 16


def poisson(seed, name, x, sample):
    key = int(hashlib.md5(f"{seed}:{name}:{x}".encode()).hexdigest()[:8], 16)
    drawn = mixed((mixed(key ^ mixed(sample + 1)) + key) & 0xFFFFFFFF)
    return sum(drawn >= int(c * 2**32) for c in rs.POISSON)


def ends(found, confidence=0.95):
    found, tail = sorted(found), (1 - confidence) / 2
    return tuple(found[min(len(found) - 1, int(x * len(found)))] for x in (tail, 1 - tail))


def test_poisson_weights_have_mean_and_variance_one():
    w = rs.poisson_weights(np.arange(1000) * 7919, np.arange(1000))
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01
    assert abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.005 and abs(np.corrcoef(w[:, :-1].ravel(), w[:, 1:].ravel())[0, 1]) < 0.005


def test_bootstrap_interval_equals_plain_sums(spark):
    x = {f"e{i}": (i * 37 % 11) / 4 for i in range(40)}
    df = spark.createDataFrame([*x.items(), ("null", None)], "example_id string, delta double").repartition(7)
    found = []
    for b in range(90):
        w = {e: poisson(5, "example", e, b) for e in x}
        found.append(sum(w[e] * d for e, d in x.items()) / sum(w.values()))
    r = rs.bootstrap_interval(df, 90, 0.9, 5).first()
    assert tuple(r) == pytest.approx((sum(x.values()) / 40, *ends(found, 0.9)))
    assert tuple(rs.bootstrap_interval(df.limit(0), 9).first()) == (None, None, None)


def deal(n, rows, samples, seed):
    """The draws of all blocks, by one recursion from the top."""
    def down(low, high, draws):
        if high - low == 1:
            return [draws]
        middle = (low + high) // 2
        size = lambda a, b: min(b * rows, n) - a * rows
        left = np.random.default_rng([seed, low, high]).binomial(draws, size(low, middle) / size(low, high))
        return down(low, middle, left) + down(middle, high, draws - left)

    return np.array(down(0, -(-n // rows), np.full(samples, n)))


def test_drawn_interval_is_a_resampling(spark):
    rng, n, rows, samples = np.random.default_rng(8), 1003, 100, 400
    x = rng.normal(size=n)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "idx long, delta double").repartition(5)
    draws = deal(n, rows, samples, 42)
    assert (draws.sum(axis=0) == n).all() and all((draws[i] == rs.draws_of_block(n, i, samples, 42, rows)).all() for i in range(11))
    means = np.zeros(samples)
    for i in range(11):
        own, part = np.random.default_rng([42, i]), x[i * rows : (i + 1) * rows]
        for b in range(samples):
            means[b] += part[own.integers(0, len(part), draws[i][b])].sum() / n
    assert tuple(rs.drawn_interval(df, samples, block=rows).first()) == pytest.approx((x.mean(), *ends(means.tolist())))
    # the spread of the means is that of a resampling, and draws add up to the rows
    assert means.std() == pytest.approx(x.std() / n**0.5, rel=0.12)
    assert tuple(rs.drawn_interval(df.withColumn("delta", F.lit(1.0)), 50, block=rows).first()) == (1.0, 1.0, 1.0)
    assert tuple(rs.drawn_interval(df.limit(0), samples=5).first()) == (None, None, None)


def test_cluster_interval_equals_plain_sums(spark):
    """Examples and raters are drawn together, again where nothing is decided; a group without a decisive answer has no rate."""
    rng, samples = random.Random(2), 60
    rows = [("d", e, r, rng.choice(["policy", "base", "tie"])) for e in range(9) for r in range(4) if rng.random() < 0.7] + [("none", 1, 1, "tie")]
    rows += [("one", e, 7, rng.choice(["policy", "base"])) for e in range(5)]  # a third of its samples are empty
    df = spark.createDataFrame(rows, "dimension string, example_id long, rater_id long, choice string").repartition(3)
    got = {r["dimension"]: tuple(r)[1:] for r in rs.cluster_interval(df, "policy", "base", "dimension", samples, 0.9, 3).collect()}
    for name in ("d", "one"):
        found = []
        for b in range(samples):
            n = 0
            while not n:
                w = [(poisson(3, "example", e, b) * poisson(3, "rater", r, b), c) for d, e, r, c in rows if d == name]
                n, b = sum(x for x, c in w if c != "tie"), b + samples
            found.append(sum(x for x, c in w if c == "policy") / n)
        cells = [c for d, _, _, c in rows if d == name and c != "tie"]
        mine = [(e, r) for d, e, r, _ in rows if d == name]
        assert got[name] == pytest.approx((cells.count("policy") / len(cells), *ends(found, 0.9), len({e for e, _ in mine}), len({r for _, r in mine})))
    assert got["none"] == (None, None, None, 1, 1)


def alpha(rows):
    units = {}
    for b, _, c in rows:
        units.setdefault(b, []).append(c)
    units = [Counter(u) for u in units.values() if len(u) > 1]
    n = sum(sum(u.values()) for u in units)
    if len({r for _, r, _ in rows}) < 2 or not units:
        return None
    observed = sum((sum(u.values()) ** 2 - sum(c * c for c in u.values())) / (sum(u.values()) - 1) for u in units) / n
    total = sum(units, Counter())
    expected = (n * n - sum(c * c for c in total.values())) / (n * (n - 1))
    return 1 - observed / expected if expected else 1.0


@pytest.mark.parametrize("case", ["random", "same", "one rater", "no pairs"])
def test_agreement(spark, case):
    rng = random.Random(5)
    rows = [(b, r, rng.choice(["policy", "base", "tie"]) if case == "random" else "policy") for b in range(12) for r in range(1 if case == "one rater" else 3) if case != "no pairs" or b % 3 == r]
    df = spark.createDataFrame([(str(b), r, "voice", c) for b, r, c in rows], "ballot_id string, rater_id int, dimension string, choice string")
    got, want = pn.agreement(df).first()["alpha"], alpha(rows)
    assert got == (want if want is None else pytest.approx(want))


def test_schedules(spark):
    examples = spark.createDataFrame([(f"{i:064x}", [1, 0]) for i in range(30)], "example_id string, seeds array<long>")
    raters = spark.createDataFrame([("a",), ("b",)], "rater_id string")
    rows = pn.ballot_schedule(examples, raters, 2, 7, 20, 0.25).collect()
    one, two = ({r["ballot_id"]: r for r in rows if r["rater_id"] == x} for x in "ab")
    assert set(one) == set(two) and len(one) == 20 and len({r["example_id"] for r in rows}) == 20
    assert Counter(r["matchup"] for r in one.values()) == {"policy-base": 15, "human-policy": 3, "human-base": 2}
    assert {i: r["a_identity"] for i, r in one.items()} != {i: r["a_identity"] for i, r in two.items()}
    assert all({r["a_identity"], r["b_identity"]} == set(r["matchup"].split("-")) and (r["run_index"] is None) == (r["matchup"] == "human-base") for r in rows)
    assert Counter(r["seed"] for r in one.values()) == {0: 10, 1: 10}
    few = pn.ballot_schedule(examples.limit(3), raters.limit(1), 2, 7, 20, 0.5).collect()
    assert sorted(Counter(r["matchup"] for r in few).values()) == [1, 1, 1]  # half of three rounds to the even two
    assert pn.ballot_schedule(examples.limit(0), raters, 2, 7, 20, 0.25).count() == 0


def test_selection_and_pseudonym_rules(spark):
    audit = spark.createDataFrame([(5, 3, 2, 1, 1, 0, 0, 0)], "target_messages long, included long, excluded long, attachment long, deleted long, edited long, no_text long, no_visible_text long")
    counts = spark.createDataFrame([("train", 2), ("test", 1)], "split string, n long")
    assert sel.selection_violations(audit, counts).count() == 0
    bad = audit.withColumn("deleted", F.lit(-1).cast("long")).withColumn("target_messages", F.lit(6).cast("long"))
    assert {r[0] for r in sel.selection_violations(bad, counts.limit(1)).collect()} == {"a count is absent or negative", "counts differ from the splits", "included and excluded differ from all", "excluded differs from the reasons"}
    names = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("t", "y")], "person string, pseudonym string")
    assert sorted(map(tuple, sel.pseudonym_violations(names, F.lit("t")).collect())) == [("a", "name is not unique"), ("b", "name is not unique"), ("c", "no name"), ("t", "target has a pseudonym")]


def test_artifacts_commit_to_their_rows(spark):
    root = fresh_path(spark, "artifacts")
    rows = spark.range(25).select(F.col("id").alias("index"), F.format_string("row %d", "id").alias("value"))
    ident = ar.write_artifact(spark, root, {"a": rows, "none": rows.limit(0)}, {"x": 1})
    assert ar.write_artifact(spark, root, {"a": rows.repartition(3), "none": rows.limit(0)}, {"x": 1}) == ident
    assert ar.write_artifact(spark, root, {"a": rows.where("index <> 3"), "none": rows.limit(0)}, {"x": 1}) != ident
    ar.verify_artifact(spark, f"{root}/{ident}")
    assert ar.read_part(spark, f"{root}/{ident}", "a").count() == 25
    rows.select("value").limit(1).write.text(f"{root}/{ident}/b")
    with pytest.raises(ValueError):
        ar.verify_artifact(spark, f"{root}/{ident}")


def test_lineage_changes_leaves_only(spark):
    s = spark.createDataFrame([("a", None, "t"), ("b", "a", "t")], "id string, parent string, title string")
    assert [r["id"] for r in tr.leaves(s).collect()] == ["b"]
    assert tr.without_leaf(s, F.lit("b")).count() == 1
    with pytest.raises(Exception, match="children"):
        tr.without_leaf(s, F.lit("a")).collect()
    assert {r["title"] for r in tr.renamed_leaf(s, F.lit("a"), "new").collect()} == {"t"}


def test_titles_fit_columns(spark):
    texts = ["short", "x" * 60, "漢" * 40, None, "  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tx.title(F.lit(None).cast("string"), F.col("t"))).collect()]
    assert got == ["short", "x" * 47 + "…", "漢" * 23 + "…", "Chat", "Chat"]


def test_own_identity_is_one(spark):
    people = spark.createDataFrame([("a", True), ("b", True)], "person string, is_self boolean")
    assert sel.self_identity(people.limit(1)).first()["person"] == "a"
    with pytest.raises(Exception, match="found 2"):
        sel.self_identity(people).collect()


def test_titles_look_at_the_beginning_of_a_text_only(spark):
    starts = ["word " * 3, " \n\t" * 40 + "a" * 47, "é" * 48, "é" * 49, "e" + "́" * 90 + "x" * 60, "名" * 24, "名 " * 30, " ́ " * 60 + "y" * 50, ""]
    df = spark.createDataFrame([(s + end,) for s in starts for end in ("", " ", " tail" * 100, "́" * 50)], "t string")
    one_line = F.trim(F.regexp_replace("t", "(?U)\\s+", " "))
    rows = df.select("t", one_line.alias("line"), tx.title(F.lit(None).cast("string"), F.col("t")).alias("title"), tx.beginning(F.col("t"), 48).alias("start")).collect()

    def width(c):
        return 0 if c == "́" else 2 if c == "名" else 1

    for r in rows:
        out, used = "", 0
        for c in r["line"]:
            used += width(c)
            if used > 47:
                break
            out += c
        want = r["line"] if sum(map(width, r["line"])) <= 48 else out.rstrip() + "…"
        assert r["title"] == (want or "Chat"), r["t"]
        assert r["t"].startswith(r["start"]) and sum(c not in " \n\t́" for c in r["start"]) <= 49


def test_windows_that_nobody_asks_for_cost_no_second_hash():
    import time

    top = 2**64 - 1
    some = np.array([0, 1, mt.PRIME - 1, mt.PRIME, mt.PRIME + 1, 2 * mt.PRIME, mt.PRIME**2, 2**62, top], np.uint64)
    assert mt.reduced(some.copy()).tolist() == [int(x) % mt.PRIME for x in some]
    hashes = mt.window_hasher(50)
    chars = np.random.default_rng(1).integers(32, 127, 2000).astype(np.uint64)
    nobody, everybody = np.zeros(1 << 17, np.uint8), np.full(1 << 17, 255, np.uint8)
    assert all((a == b).all() for a, b in zip(hashes(chars, everybody), hashes(chars), strict=True))
    assert [len(x) for x in hashes(chars, nobody)] == [0, 0, 0]

    def seconds(*bitmap):
        start = time.process_time()
        for _ in range(200):
            hashes(chars, *bitmap)
        return time.process_time() - start

    assert min(seconds(nobody) for _ in range(3)) < min(seconds() for _ in range(3))


def test_weights_as_their_formula_and_faster():
    import time

    keys, samples = np.random.default_rng(2).integers(0, 1 << 32, 40), np.arange(10_000)

    def mixed(x):
        for _ in range(2):
            x = (x ^ x >> np.uint32(16)) * np.uint32(rs.FACTOR)
        return x ^ x >> np.uint32(16)

    def plain():
        k = keys.astype(np.uint32)[:, None]
        drawn = mixed(mixed(k ^ mixed((samples + 1).astype(np.uint32))[None, :]) + k)
        return np.searchsorted(np.array(rs.STEPS, np.uint32), drawn, side="right").astype(np.float64)

    def seconds(f):
        start = time.process_time()
        for _ in range(5):
            f()
        return time.process_time() - start

    assert (rs.poisson_weights(keys, samples) == plain()).all() and rs.poisson_weights(keys[:0], samples).shape == (0, 10_000)
    assert min(seconds(lambda: rs.poisson_weights(keys, samples)) for _ in range(3)) < 0.8 * min(seconds(plain) for _ in range(3))
