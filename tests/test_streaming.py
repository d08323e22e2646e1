"""Incremental scoring: files that come later are scored once, and equal one score over all of them."""

import json

from pyspark.sql import functions as F

from scoreloom.functions import text as T
from scoreloom.streaming.incremental import score_stream, unseen

SCHEMA = "case_id string, report string"


def lengths(df):
    return df.select("case_id", F.size(T.phrases(F.col("report"))).alias("phrases"))


def put(folder, name, rows):
    (folder / name).write_text("".join(json.dumps({"case_id": c, "report": r}) + "\n" for c, r in rows), encoding="utf-8")


def test_each_file_is_scored_once(spark, tmp_path):
    source, sink, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    source.mkdir()
    first, second = [("a", "The bone is sound. No cyst."), ("b", None)], [("c", ""), ("a", "Teeth are present, and the canal is seen.")]

    def run():
        query = score_stream(spark, str(source), SCHEMA, str(sink), str(mark), lengths)
        query.awaitTermination()
        assert query.exception() is None
        return sorted(tuple(r) for r in spark.read.parquet(str(sink)).select("case_id", "phrases", "batch").collect())

    put(source, "1.json", first)
    early = run()
    assert {(c, n) for c, n, _ in early} == {("a", 2), ("b", 0)}
    assert run() == early  # nothing new, nothing scored
    put(source, "2.json", second)
    late = run()
    assert [r for r in late if r[2] == early[0][2]] == early  # what was scored stays as it is
    whole = lengths(spark.createDataFrame(first + second, SCHEMA))
    assert sorted((c, n) for c, n, _ in late) == sorted(tuple(r) for r in whole.collect())


def test_unseen(spark):
    cases = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "case_id string")
    done = spark.createDataFrame([("a", 1), ("a", 2)], "case_id string, batch int")
    # repeated rows stay, and so does a case without a name, as no result is known to be its own
    assert sorted((r["case_id"] or "") for r in unseen(cases, done).collect()) == ["", "b", "b"]
    assert unseen(cases, done.limit(0)).count() == 4
