"""Incremental scoring of new cases: an extension, as no streaming is asked for. The plan per batch is the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def unseen(cases: DataFrame, done: DataFrame, case: str = "case_id") -> DataFrame:
    """Cases that have no result yet."""
    return cases.join(done.select(case).distinct(), case, "left_anti")


def score_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, score: Callable[[DataFrame], DataFrame]):
    """Scores JSON files as they arrive, each batch once, to Parquet folders named by batch; runs until what is there is done."""

    def batch(df: DataFrame, number: int) -> None:
        score(df).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
