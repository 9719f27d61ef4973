"""The pipeline, stage by stage, each on what its predecessor kept."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import decontam, langid, mixing, simhash


def test_stages(spark, sf_dir, documents):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        kept[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name != "shard":
            assert out.columns == documents.columns
            if name != "mix":
                assert out.count() == len(kept[name])
        before, docs = docs, spark.createDataFrame(out.collect(), out.schema)
        if name == "language":
            model = langid.fit(before, ~langid.held_out())
            rejected = {r["doc_id"] for r in langid.identify(before, model).where("rejected").select("row.doc_id").collect()}
            assert kept[name] == {r["doc_id"] for r in documents.collect()} - rejected and len(rejected) < 20
        if name == "near_dedup":
            assert kept[name] == {r["component_id"] for r in simhash.simhash_groups(before).collect()}
        if name == "decontaminate":
            bad = {r["doc_id"] for r in decontam.contamination(before, bench).where("contaminated").collect()}
            assert kept[name] == {r["doc_id"] for r in before.collect()} - bad
        if name == "mix":
            assert kept[name] <= {r["doc_id"] for r in before.collect()}
        if name == "shard":
            assert kept[name] == {r["doc_id"] for r in before.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "shard"]


def test_run_gives_shards(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.where(~F.col("shard").between(0, 7)).count() == 0 and got.count() > 100


def test_mix_keeps_what_a_plain_fit_keeps(spark, sf_dir):
    """The rows of the stage, by a fit in plain Python over the same posteriors, on the table of 1000 documents."""
    from test_filters import brute_thinning

    larger = Path(sf_dir).parent / "sf0.01"
    sf_dir = str(larger) if larger.is_dir() else sf_dir
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", mixing.label_domain().alias("domain"))
    model = mixing.train(docs, labelled)
    unit = F.pmod(F.xxhash64(F.lit("copies"), "row.doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    scored = mixing.with_posteriors(docs, model).select("row.doc_id", "n_tokens", "posterior", unit.alias("unit")).collect()
    targets = [mixing.TARGETS[d] for d in model.domains]
    rates = brute_thinning([(r["n_tokens"], r["posterior"]) for r in scored], targets)
    due = {r["doc_id"] for r, rate in zip(scored, rates, strict=True) if rate >= r["unit"]}
    got = [r["doc_id"] for r in corpus_pipeline.mix(spark, docs, sf_dir).select("doc_id").collect()]
    assert len(got) == len(set(got)) and len(due ^ set(got)) <= 2  # rates are equal to the fit's tolerance
    clean = {r["doc_id"] for r, rate in zip(scored, rates, strict=True) if rate == 1}
    assert len(clean) > len(rates) / 2 and clean <= set(got) and len(got) > sum(rates) - 60
