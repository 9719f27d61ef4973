"""Language ID, decontamination, toxicity, licenses, mixing and tool calls."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from parlance.llm import decontam, langid, licenses, mixing, toolcalls, toxicity
from parlance.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def sf01(sf_dir):
    larger = Path(sf_dir).parent / "sf0.01"
    return str(larger) if larger.is_dir() else sf_dir


def test_language_of_held_out_rows(spark, sf01):
    got = QUERIES["op2_langid"](spark, sf01).join(spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95 and got.where("score < 0 OR score > 1").count() == 0


def test_language_edges(spark, edges, documents):
    model = langid.fit(documents, ~langid.held_out())
    got = langid.identify(edges(), model).select("row.doc_id", "lang_pred", "score", "rejected").collect()
    assert len(got) == 12
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in got if r["doc_id"] in (1, 2, 3, 9, 10))
    assert langid.drop_rejected(documents).columns == documents.columns
    assert langid.identify(edges(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.language_ids(edges(0).union(edges()).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_rejects_noise_and_keeps_clean_rows(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    model = langid.fit(docs, ~langid.held_out())
    assert langid.identify(docs, model).where("rejected").count() == 0
    rng = random.Random(1)
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. "
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto. "
    for n in (500, 2000, 8000, 400_000):
        letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
        _, near, far = model.predict([letters, base64.b64encode(rng.randbytes(n)).decode(), (polish * (n // 100 + 1))[:n], (finnish * (n // 100 + 1))[:n]])
        assert far.all(), (n, near, far)


ARTICLES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
}


def test_language_keeps_real_sentences_and_rejects_digests(spark):
    sf = Path("/root/testdata/sf0.1")
    if not sf.is_dir():
        pytest.skip(f"no tables at {sf}")
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"), ~langid.held_out())
    names, _, far = model.predict(list(ARTICLES.values()))
    assert names == list(ARTICLES) and not far.any()
    rng = random.Random(3)
    digests = [" ".join(f"{rng.getrandbits(128):032x}" for _ in range(n)) for n in (2, 6, 20, 200)]
    noise = [base64.b64encode(rng.randbytes(300)).decode(), " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(60))]
    assert model.predict([*digests, *noise])[2].all()


def test_language_predictions_against_plain_python(spark, sf_dir, documents):
    """Every prediction worked out anew, n-gram by n-gram."""
    model = langid.fit(documents, ~langid.held_out())

    def plain(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0, True
        low = text.lower()
        codes = [32]
        for c in low:
            if c.isalpha():
                codes.append(ord(c))
            elif codes[-1] != 32:
                codes.append(32)
        codes += [32] * (codes[-1] != 32)
        counts = Counter()
        for order, (start, width) in enumerate(langid.SPANS):
            for i in range(len(codes) - order):
                h = 0
                for c in codes[i : i + order + 1]:
                    h = (h * 0x9E3779B1 + c) % 2**64
                counts[start + (h * 0x9E3779B97F4A7C15 % 2**64 >> 40) % width] += 1
        x = {k: math.log1p(n) * model.idf[k] for k, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        cos = [sum(v * c[k] for k, v in x.items()) / norm for c in model.centroids]
        best = max(range(len(cos)), key=lambda j: (cos[j], -j))
        n, near = sum(counts.values()), min(max(cos[best], 0), 1)
        other = max(c for j, c in enumerate(cos) if model.owner[j] != model.owner[best])
        decided = near >= langid.DECIDED and other <= (langid.GAP if n < langid.SHORT else langid.LONG_GAP) * near
        letters = sum(c.isalpha() for c in low) / sum(c not in " \t\n\r\x0b\x0c" and not 9 <= ord(c) < 14 for c in low)
        return model.names[model.owner[best]], near, (near < model.floor[min(int(math.log2(n)), 31)] and not decided) or letters < model.letters

    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = {r["doc_id"]: r for r in langid.language_ids(documents).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        name, score, far = plain(text)
        assert (got[i]["lang_pred"], got[i]["rejected"]) == (name, far) and got[i]["score"] == pytest.approx(score, abs=1e-9), i


def test_floors_of_rare_lengths():
    counted = np.zeros((32, langid.CELLS), np.int64)
    counted[10, 300], counted[10, 700] = 20, 980
    floor = langid._floors(counted, 0.01)
    assert floor[8] == pytest.approx(0.15) and set(floor[10:]) == {0.3} and langid._floors(counted * 0, 0.01).max() == 0


def test_long_texts_are_read_whole():
    text = ("abc d " * 30 + "x" * 40) * 50
    import numpy as np

    whole = np.zeros(langid.FEATURES)
    langid._add_grams(text, whole)
    kept, langid.PIECE = langid.PIECE, 97
    parts = np.zeros(langid.FEATURES)
    langid._add_grams(text, parts)
    langid.PIECE = kept
    assert (whole == parts).all()


def brute_contamination(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, found = split(text), set(), set()
    for name, body in items:
        ks = split(body)
        k = min(13, len(ks))
        wins = {tuple(ks[i : i + k]) for i in range(len(ks) - k + 1)} if k else set()
        for i in range(len(ws) - k + 1 if k else 0):
            if tuple(ws[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(name)
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(ws)


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_contamination_equals_brute_force(spark, documents, sf_dir, most):
    """By the broadcast set, and by the join that takes its place for a large benchmark; ids repeat and are null."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(12).selectExpr("CAST(item_id AS STRING) AS item_id", "text")
    more = [("short", "Of THE and"), ("none", "!!"), ("null", None), ("short", "and the"), ("short", "Of THE and"), (None, "of the"), (None, "in the"), ("a", bench.first()["text"])]
    bench = bench.union(spark.createDataFrame(more, "item_id string, text string"))
    docs = documents.limit(40)
    items = [(r["item_id"] or "", r["text"]) for r in bench.collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in decontam.contamination(docs, bench, max_broadcast_bytes=most).collect()}
    assert got == {r["doc_id"]: brute_contamination(r["text"], items) for r in docs.collect()}
    assert len({g[2] for g in got.values()}) > 2


def test_windows_of_texts_in_parts(monkeypatch):
    """Long texts are cut into parts whose windows are those of the whole."""
    rng = random.Random(3)
    text = " ".join(rng.choice(["ab", "c", "word", "é" * 9]) + ("  " if rng.random() < 0.1 else "") for _ in range(700)).encode()
    monkeypatch.setattr(decontam, "PIECE", 64)
    ws = text.split()
    got = {}
    for number, part in decontam._parts(text, 12):
        assert part.split() == ws[number : number + len(part.split())]
        for i, h in enumerate(decontam._window_hashes(part, 13, decontam._bounds(part)).tolist()):
            got[number + i] = h
    whole = decontam._window_hashes(text, 13, decontam._bounds(text)).tolist()
    assert [got[i] for i in range(len(ws) - 12)] == whole


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_contamination_edges(spark, edges, most):
    bench = spark.createDataFrame([("a", "hello big wide world again"), (None, "x y z")], "item_id string, text string")
    got = decontam.scan_benchmark(edges(), bench, max_broadcast_bytes=most).select("row.doc_id", "n_words", "n_hit", "contaminated").collect()
    assert len(got) == 12 and sum(r["contaminated"] for r in got) == 4
    assert decontam.drop_contaminated(edges(), bench).columns == edges().columns
    kept = decontam.drop_contaminated(edges(), bench, max_broadcast_bytes=most)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "6", "7", "8", "9", "10"])
    assert decontam.scan_benchmark(edges(), bench.limit(0), max_broadcast_bytes=most).where("contaminated").count() == 0
    assert decontam.scan_benchmark(edges(0), bench, max_broadcast_bytes=most).count() == 0
    clean = decontam.remove_spans(edges(), bench, max_broadcast_bytes=most).select("row.doc_id", "clean_text").collect()
    assert len(clean) == 12 and all((r["clean_text"] is None) == (r["doc_id"] in (1, 9)) for r in clean)


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_spans_are_removed(spark, most):
    docs = spark.createDataFrame([(1, "Before, Hello big (wide) world again! After")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "hello big wide world again")], "item_id string, text string")
    clean = decontam.remove_spans(docs, bench, max_broadcast_bytes=most).first()["clean_text"]
    assert clean.split() == ["Before,", "()", "!", "After"]


def auc(rows):
    ranked = sorted(rows)
    good, area = 0, 0
    for _, label in ranked:
        if label:
            area += good
        else:
            good += 1
    return area / max(1, good * (len(ranked) - good))


def test_toxicity_of_held_out_rows(spark, sf_dir):
    """On the largest of the small tables, as the rarer toxic words need labelled documents."""
    from pathlib import Path

    large = Path(sf_dir).parent / "sf0.1"
    path = str(large) if large.is_dir() else sf_dir
    labels = spark.read.parquet(f"{path}/labels.parquet")
    got = QUERIES["op6_toxicity"](spark, path).where("held_out").join(labels, "doc_id").collect()
    found = auc([(r["score"], r["toxic"]) for r in got])
    print("held-out AUC", found)
    assert found > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_crf_marginals_equal_enumeration():
    import itertools

    import numpy as np

    model = toxicity.Model(evidence={"bad": 3.0, "3:": 1.0}, weights=np.array([-1.0, 1.0, 0.5, 0.5]), moves=np.array([-0.5, -1.0, 0.3, 0.7]))
    words = ["a", "bad", "b", "bad", "c"]
    e = np.exp(model.features(words) @ model.weights)
    start, ab, ba, bb = np.exp(model.moves)
    move = {(0, 0): 1.0, (0, 1): ab, (1, 0): ba, (1, 1): bb}
    total, on = 0.0, np.zeros(5)
    for path in itertools.product((0, 1), repeat=5):
        w = (start if path[0] else 1.0) * np.prod([e[i] if s else 1.0 for i, s in enumerate(path)]) * np.prod([move[p] for p in itertools.pairwise(path)])
        total += w
        on += w * np.array(path)
    assert model.tag([words])[0] == pytest.approx(on / total)
    both = model.tag([words, [], words[::-1]])
    assert both[0] == pytest.approx(on / total) and len(both[1]) == 0


def test_toxicity_edges(spark, edges):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)], "doc_id long, toxic int")
    assert toxicity.toxicity(edges(), labels).count() == 12
    none = toxicity.toxicity(edges(), labels.limit(0)).collect()
    assert len({r["score"] for r in none if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.toxicity(edges(0), labels).count() == 0


def test_toxic_spans_are_offsets_in_the_text_itself(spark):
    """Lower case can be longer than the text."""
    model = toxicity.Model(evidence={"bad": 8.0}, weights=np.array([-6.0, 2.0, 0.0, 0.0]))
    docs = spark.createDataFrame([(1, "İİİ bad day"), (2, "a BAD, bad İ"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in toxicity.score_rows(docs, model).select("row.doc_id", "spans").collect()}
    assert got == {1: [(4, 7)], 2: [(2, 10)], 3: []}


def test_toxicity_of_repeated_labels(spark, documents):
    """An id with both labels is toxic; the order of rows doesn't matter."""
    docs = documents.select("doc_id", "text")
    labels = spark.read.parquet(f"{documents.inputFiles()[0].rsplit('/', 1)[0]}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    more = labels.union(labels.where("doc_id % 5 = 0").withColumn("toxic", 1 - F.col("toxic"))).union(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int"))
    once = labels.where("doc_id % 5 <> 0").union(labels.where("doc_id % 5 = 0").withColumn("toxic", F.lit(1)))
    fits = [toxicity.fit(docs, x) for x in (more, more.orderBy(F.desc("toxic")), once)]
    assert fits[0].evidence and all(f.evidence == fits[0].evidence and np.allclose(f.weights, fits[0].weights) and np.allclose(f.scale, fits[0].scale) for f in fits)


def test_mixing_of_repeated_labels(spark, documents):
    some = documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "low").otherwise("good").alias("domain"))
    twice = some.union(some.withColumn("domain", F.lit("low")))
    assert mixing.train(documents, twice) == mixing.train(documents, twice.orderBy(F.desc("domain"))) == mixing.train(documents, some)


MIT = licenses.KNOWN[0][1]


def test_license_spellings_of_neighbours(spark):
    """Words that share a space are all spelled alike; two words that are one, in a row."""
    rows = [(1, "licence licence licence"), (2, "License, license: LICENSE"), (3, "sub licence sub licenced per cent non-commercial"), (4, "sublicense sublicensed percent noncommercial"), (5, "sub sub license")]
    got = {r["doc_id"]: r["norm_sha256"] for r in licenses.license_ids(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1] == got[2] == sha("license license license") and got[3] == got[4] == sha("sublicense sublicensed percent noncommercial") and got[5] == sha("sub sublicense")


def test_whole_licenses_by_digest(spark):
    from pathlib import Path

    files = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    assert [i for i, _ in licenses.KNOWN_DIGESTS] == list(files)
    there = [(i, Path("/usr/share/common-licenses", f)) for i, f in files.items()]
    rows = [(n, p.read_text(), i) for n, (i, p) in enumerate(there) if p.is_file()]
    if not rows:
        pytest.skip("no licenses on this machine")
    changed = [(n, "Copyright 2020 Me\n" + t.replace("\n", "\r\n").upper(), i) for n, t, i in rows]
    docs = spark.createDataFrame(rows + changed, "doc_id int, text string, due string")
    got = licenses.scan_licenses(docs).select("row.due", "license_id").collect()
    assert all(r["due"] == r["license_id"] for r in got) and len(got) == 2 * len(rows)


def test_license_texts(spark):
    changed = "Copyright (c) 2020 Some Body\nAll rights reserved.\n\n" + MIT.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ;\n")
    rows = [(1, MIT), (2, changed), (3, MIT + " more"), (4, "a\nReleased under the MIT Licence!\nb\nLicensed under CC BY-NC 4.0."), (5, None), (6, "...")]
    got = {r["doc_id"]: r for r in licenses.license_ids(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [got[i]["license_id"] for i in range(1, 7)] == ["MIT", "MIT", None, None, None, None]
    assert got[4]["notices"] == "CC-BY-NC-4.0,MIT" and got[5]["norm_sha256"] == got[6]["norm_sha256"]


def test_license_oracle_and_edges(spark, sf_dir, edges):
    same(QUERIES["op8_licenses"](spark, sf_dir), connect(sf_dir), ORACLE_SQL["op8_licenses"])
    assert licenses.scan_licenses(edges()).count() == 12 and licenses.scan_licenses(edges(0)).count() == 0
    assert licenses.scan_licenses(edges(), known=licenses.known_digests(spark).limit(0), notices=()).where("license_id IS NOT NULL").count() == 0


def test_mixing_meets_its_targets(spark, sf01):
    got = QUERIES["op7_mixing"](spark, sf01).collect()
    total = sum(r["n_tokens"] for r in got)
    for d, target in mixing.TARGETS.items():
        assert sum(r["rate"] * r["n_tokens"] * r["posterior"][d] for r in got) / total == pytest.approx(target, abs=1e-4)
    assert all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in got)


def test_rates_equal_brute_force(spark):
    """The same steps in plain Python; a target of zero pushes rates to their bound."""
    rng = random.Random(1)
    rows = [(rng.randrange(1, 50), (p := rng.random(), 1 - p)) for _ in range(200)]
    df = spark.createDataFrame([(n, list(p)) for n, p in rows], "n_tokens long, posterior array<double>")
    steps = mixing.fit_rates(df, [0.9, 0.1], steps=60)
    got = [r[0] for r in df.select(mixing._rate(F.col("posterior"), steps)).collect()]
    total = sum(n for n, _ in rows)
    assert sum(r * n * p[0] for r, (n, p) in zip(got, rows, strict=True)) / total == pytest.approx(0.9, abs=1e-4)
    # at the optimum a rate is max(0, 1 - p . c) for one vector c; check that order is kept
    ranked = sorted(zip((p[0] for _, p in rows), got, strict=True))
    assert all(a[1] <= b[1] + 1e-9 for a, b in zip(ranked, ranked[1:], strict=False)) and min(got) >= 0
    assert mixing.fit_rates(df.limit(0), [0.5, 0.5]) == []


def test_mixing_edges(spark, edges):
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {r["rate"] for r in mixing.mixture(edges(), none).collect()} == {1.0}
    some = spark.createDataFrame([(i, "good" if i < 8 else "low") for i in range(1, 11)], "doc_id long, domain string")
    assert mixing.mixture(edges(), some).count() == 12 and mixing.mixture(edges(0), some).count() == 0
    kept = mixing.resample(edges(), some)
    assert kept.columns == edges().columns and kept.count() <= 12


def test_toxic_documents_are_a_domain_of_the_mix(spark, sf01):
    rows = spark.createDataFrame([(0, 1), (1, 1), (0, 0), (1, 0), (None, 1), (0, None)], "toxic int, quality int")
    assert [r[0] for r in rows.select(mixing.label_domain()).collect()] == ["good", "toxic", "low", "toxic", None, None]
    got = QUERIES["op7_mixing"](spark, sf01).select("n_tokens", "rate", "posterior").collect()
    total = sum(r["n_tokens"] for r in got)
    assert sum(r["rate"] * r["n_tokens"] * r["posterior"]["toxic"] for r in got) / total == pytest.approx(0.03, abs=1e-4)


def brute_thinning(rows, targets, most=1.0):
    """Rates in [0, most] by plain projected gradient steps on the squared residuals and the ridge."""
    n, p = np.array([float(n) for n, _ in rows]), np.array([p for _, p in rows])
    share, there = np.array(targets) / sum(targets), n @ p / n.sum()
    goal = share * min(t / s for t, s in zip(there, share, strict=True) if s > 0)
    r = np.ones(len(n))
    for _ in range(6000):
        gap = (n * r) @ p / n.sum() - goal
        r = np.clip(r - (p @ gap + mixing.RIDGE * (r - 1)) / (1 + mixing.RIDGE), 0, most)
    return r.tolist()


def test_thinning_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(150):
        e = [rng.random() ** 4 + 1e-6 for _ in range(3)]
        e[0] += 1
        rows.append((rng.randrange(1, 50), tuple(x / sum(e) for x in e)))
    for goal, most in (([0.90, 0.06, 0.04], 1), ([0.90, 0.06, 0.04], 2), ([0.95, 0.05], 1), ([0.0, 1.0], 1), ([0.2, 0.8], 1)):
        some = [(n, (p[0], *([sum(p[1:])] if len(goal) == 2 else p[1:]))) for n, p in rows]
        df = spark.createDataFrame([(n, list(p)) for n, p in some], "n_tokens long, posterior array<double>")
        c = mixing.fit_thinning(df, goal, most, tolerance=1e-9)
        got = [r[0] for r in df.select(mixing._thinned(F.col("posterior"), c, most)).collect()]
        assert got == pytest.approx(brute_thinning(some, goal, most), abs=1e-4) and all(0 <= r <= most for r in got), (goal, most)
    assert mixing.fit_thinning(df.limit(0), [0.5, 0.5]) == [0.0, 0.0] == mixing.fit_thinning(df, [0.0, 0.0])


def test_a_classifier_that_is_never_sure_costs_no_clean_rows(spark):
    """Every row looks a little toxic, so the target is out of reach; rows that are most likely good stay."""
    rows = [(10, [0.88, 0.02, 0.10])] * 800 + [(10, [0.10, 0.80, 0.10])] * 150 + [(10, [0.60, 0.05, 0.35])] * 50
    df = spark.createDataFrame(rows, "n_tokens long, posterior array<double>")
    rate = mixing._thinned(F.col("posterior"), mixing.fit_thinning(df, [0.90, 0.07, 0.03]), 1)
    got = {r["p"]: r["rate"] for r in df.groupBy(F.col("posterior")[0].alias("p")).agg(F.min(rate).alias("rate")).collect()}
    assert got[0.88] > 0.99 and got[0.10] < 0.6


def test_one_extreme_document_thins_no_other(spark):
    """Before, all rates were scaled by the largest of any document."""
    rows = [(1, [0.97, 0.03])] * 700 + [(1, [0.10, 0.90])] * 300 + [(1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "n_tokens long, posterior array<double>")
    rate = mixing._thinned(F.col("posterior"), mixing.fit_thinning(df, [0.92, 0.08]), 1)
    got = df.groupBy(F.col("posterior")[0].alias("p")).agg(F.min(rate).alias("low"), F.max(rate).alias("high")).collect()
    assert all(r["low"] == 1 for r in got if r["p"] > 0.9) and all(0 < r["high"] < 0.4 for r in got if r["p"] < 0.9)


def calls_and_results(spark, calls, results):
    c = spark.createDataFrame([(1, i, 0, *x) for i, x in enumerate(calls)], "conv_id long, turn long, nth long, call_id string, name string, arguments string, after array<string>")
    r = spark.createDataFrame([(1, 100 + i, *x) for i, x in enumerate(results)], "conv_id long, turn long, call_id string, content string")
    return c, r


TOOLS = {"add": {"a": ("integer", True), "b": ("number", False), "tags": ("array", False)}}


def test_tool_calls(spark):
    calls = [
        ("one", "add", '{ "b": 1.5, "a": 2, "tags": ["é"] }', None),
        ("two", "add", '{"a": "2", "z": 1}', ["one"]),
        ("three", "add", '{"a": 1}', ["two", "one", "gone"]),
        ("loop", "add", '{"a": 1}', ["pool"]),
        ("pool", "add", '{"a": 1}', ["loop"]),
        ("behind", "add", '{"a": 1}', ["pool"]),
        ("four", "sub", "{}", []),
        ("five", "add", "{", []),
        ("one", "add", '{"a": 9}', []),
        (None, "add", '{"a": 1}', []),
        ("lone", "add", '{"a": 1}', []),
    ]
    results = [("one", 'say "x"'), ("one", "again"), ("two", "r"), ("three", "r"), ("none", "r"), (None, "r"), ("four", "r")]
    got = {r["turn"]: r for r in toolcalls.link_calls(*calls_and_results(spark, calls, results), TOOLS).collect()}
    status = {t: r["status"] for t, r in got.items()}
    assert [status[i] for i in range(11)] == ["ok", "invalid", "ok", "cyclic", "cyclic", "cyclic", "invalid", "invalid", "repeated", "unanswered", "unanswered"]
    assert {t: s for t, s in status.items() if t >= 100} == {101: "repeated", 104: "orphan", 105: "orphan"}
    assert [got[i]["level"] for i in (0, 1, 2, 3, 10)] == [0, 1, 2, None, 0]
    assert got[1]["errors"] == ["a: not integer", "z: unknown"] and got[6]["errors"] == ["unknown tool"]
    assert got[0]["json"] == '{"arguments":{"a":2,"b":1.5,"tags":["é"]},"content":"say \\"x\\"","id":"one","name":"add","status":"ok"}'
    assert all(json.dumps(json.loads(r["json"]), ensure_ascii=False, separators=(",", ":"), sort_keys=True) == r["json"] for r in got.values())


def brute_levels(after):
    """Longest chain before each call; calls on or behind a cycle have none."""
    out = {}
    while True:
        new = {c: max((out[d] + 1 for d in ds if d in after), default=0) for c, ds in after.items() if c not in out and all(d in out for d in ds if d in after)}
        if not new:
            return out
        out |= new


def test_levels_equal_brute_force(spark):
    rng = random.Random(11)
    after = {}
    for g in range(40):
        for i in range(rng.randrange(1, 14)):
            after[f"{g}.{i}"] = [f"{g}.{rng.randrange(0, 14)}" if rng.random() < 0.1 else f"{g}.{rng.randrange(max(1, i))}" for _ in range(rng.randrange(0, 4) if i else 0)] + (["gone"] if i % 5 == 0 else [])
    after |= {"self": ["self"], "a": ["b"], "b": ["c"], "c": ["a"], "behind": ["c", "0.0"]}
    df = spark.createDataFrame([(1, c, ds) for c, ds in after.items()], "conv_id long, call_id string, after array<string>")
    assert {r["call_id"]: r["level"] for r in toolcalls.levels(df).collect()} == brute_levels(after)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n, written, keep = 5000, [], toolcalls.stored
    monkeypatch.setattr(toolcalls, "stored", lambda df: written.append(1) or keep(df))
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("string").alias("call_id"), F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("after"))
    got = toolcalls.levels(df).agg(F.max("level").alias("m"), F.count("*").alias("n"), F.sum((F.col("level").cast("string") == F.col("call_id")).cast("int")).alias("right")).first()
    assert tuple(got) == (n - 1, n, n) and len(written) < 3 + 6 * 16


def test_tool_messages(spark):
    call = {"tool_calls": [{"id": "x", "name": "add", "arguments": {"a": 1}}, {"id": "y", "name": "add", "arguments": {"a": 2}, "after": ["x"]}]}
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", json.dumps(call)), (1, 2, "tool", '{"tool_call_id": "x", "content": "1"}'), (1, 3, "assistant", None), (1, 4, "tool", "junk")]
    calls, results = toolcalls.parse_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = toolcalls.link_calls(calls, results, TOOLS).orderBy("level").collect()
    assert [(r["call_id"], r["level"], r["status"]) for r in got] == [("x", 0, "ok"), ("y", 1, "unanswered")]


def test_tool_oracle_and_empty(spark, sf_dir):
    same(QUERIES["op9_tool_calls"](spark, sf_dir), connect(sf_dir), ORACLE_SQL["op9_tool_calls"])
    c, r = calls_and_results(spark, [("a", "add", "{}", None)], [("a", "x")])
    assert toolcalls.link_calls(c.limit(0), r.limit(0), TOOLS).count() == 0
    assert toolcalls.link_calls(c.limit(0), r, TOOLS).first()["status"] == "orphan"
    assert toolcalls.link_calls(c, r.limit(0), TOOLS).first()["status"] == "invalid"
