"""The pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rng = random.Random(2)
    sentences = [x for r in docs.where("lang = 'en' AND n_chars > 1500").collect() for x in r["text"].split("\n") if 60 < len(x) < 400 and x.isprintable() and "!!" not in x and "|" not in x and "%" not in x]
    some = lambda k: "\n".join(rng.sample(sentences, k))
    clean = some(9)
    near = clean.split(" ")
    near[30] = "changed"
    planted = [(10**6, clean), (10**6 + 1, clean), (10**6 + 2, " ".join(near)), (10**6 + 3, some(5) + "\n" + bench + "\n" + some(5)), (10**6 + 4, some(9) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (10**6 + 5, None), (10**6 + 6, "")]
    rows = spark.createDataFrame(planted, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.char_length("text").cast("long").alias("n_chars"))
    every = docs.unionByName(rows).withColumn("score", F.lit("clashes"))
    sf = f"file://{tmp_path}"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    kept = every
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialise(stage(spark, kept, sf), name)
        assert kept.columns == every.columns and kept.schema["n_chars"].dataType == every.schema["n_chars"].dataType
    found = {r["doc_id"]: r for r in kept.where("doc_id >= 1000000").collect()}
    assert 10**6 in found and 10**6 + 1 not in found and 10**6 + 2 not in found
    leak = found[10**6 + 3]
    assert bench[:60] not in leak["text"] and leak["n_chars"] == len(leak["text"])
    assert "[SECRET]" in found[10**6 + 4]["text"] and "04dbebab" not in found[10**6 + 4]["text"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert pieces.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_odd_rows(spark, tmp_path):
    """Null, empty and very long texts, repeated and null ids, an empty table, and an extra column."""
    long = " ".join(f"word{k % 977} and{k % 31}" for k in range(60_000)) + " password = hunter2hunter2"
    rows = [(1, None, "a"), (2, "", "b"), (3, "some words of a text", "c"), (3, "some words of a text", "d"), (3, "other words in this one", "e"), (None, "a row without an id", "f"), (7, long, "g")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    sf = f"file://{tmp_path}"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for docs in (odd, odd.limit(0)):
        scored = stages["quality_classifier"](spark, docs, sf)
        assert scored.columns == docs.columns and scored.count() <= docs.count()
        kept = docs
        for name in ("jaccard_join", "decontamination", "secret_scan"):
            kept = corpus_pipeline.materialise(stages[name](spark, kept, sf), name)
            assert kept.columns == docs.columns
        if docs is odd:
            got = sorted(((r["doc_id"], r["text"], r["row"]) for r in kept.collect()), key=str)
            want = [r for r in rows if r[2] != "d"]  # of equal rows the first stays
            want[-1] = (7, long.replace("password = hunter2hunter2", "[SECRET]"), "g")
            assert got == sorted(want, key=str)
        assert stages["best_fit_packing"](spark, kept, sf).select("doc_id", "piece").distinct().count() >= kept.select("doc_id").distinct().count()
