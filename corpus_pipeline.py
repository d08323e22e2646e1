"""From raw documents to token files in five stages, each on all that the one before it kept.

run() writes each stage's result as Parquet in the shared folder and reads it back for the next, so a lost executor
costs no more than the stage that it was in. Tables that a stage writes on its way are deleted when the next one begins,
whose input is stored by then.

Null texts and texts without letters go in the first stage; null keys, sources and languages and repeated rows go through
as each stage's operator states; an empty table stays empty; further columns of any name go along to the last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm import base, bm25, jaccard, langid, rans, wfq
from scoreloom.llm.queries import tokenizer_path

#: By application, the folders that its last stage has written on its way. Tables of other results are not among them.
_HELD: dict[str, list[str]] = {}


def _stage(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    held = _HELD.setdefault(spark.sparkContext.applicationId, [])
    base.drop(spark, held)
    with base.owned() as written:
        out = build()
    held += written
    return out


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters, or far from every language, go."""
    return _stage(spark, lambda: langid.keep_identified(docs, langid.fit(langid.training_rows(docs))))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or near-equal documents."""
    return _stage(spark, lambda: jaccard.one_of_each(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _stage(spark, lambda: bm25.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return _stage(spark, lambda: wfq.mixed(docs))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; returns their index: doc_id, start, n_tokens, ids_crc32."""
    return _stage(spark, lambda: rans.token_index(rans.write_token_files(docs, tokenizer_path())))


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("source_mix", mixed_sources),
    ("token_files", token_files),
]

#: Language models, set similarity and token files are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{base.shared_dir(spark)}/scoreloom/{uuid.uuid4().hex}"
    before: list[str] = []
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}/rows"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        base.drop(spark, before)
        before = [path]
    return docs
