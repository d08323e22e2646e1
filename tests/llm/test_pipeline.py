"""The pipeline on the smallest table, stage by stage."""

import corpus_pipeline
from scoreloom.llm import bm25, langid, queries

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if name == "ngram_jaccard_join":
            assert docs.select("text").distinct().count() == counts[-1]
        if name == "benchmark_decontamination":
            assert bm25.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert counts[0] >= 0.97 * before and counts[0] >= counts[1] >= counts[2] and counts[3] == counts[4]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(langid.training_rows(docs))).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
