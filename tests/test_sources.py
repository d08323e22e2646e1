"""Readers, manifests, checks and the entry module."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from scoreloom.sources import cases


def tree(tmp_path):
    for case, files in {"A001": ["volume.nii.gz", "report_1.txt"], "P002": ["volume.mha", "a.txt", "b.txt"], "S001": ["volume.nii"]}.items():
        (tmp_path / case).mkdir()
        for f in files:
            (tmp_path / case / f).write_text("﻿ Some  report. " if f.endswith("txt") else "x", encoding="utf-8")
    return str(tmp_path)


def test_discovery(spark, tmp_path):
    found = cases.discovered(spark, tree(tmp_path))
    got = {r["case_id"]: r for r in found.collect()}
    assert set(got) == {"A001", "P002", "S001"} and len(got["P002"]["report_paths"]) == 2 and got["S001"]["report_paths"] is None
    assert {r["status"]: r["cases"] for r in cases.integrity_profile(found).collect()} == {"complete": 2, "volume_only": 1}
    with pytest.raises(ValueError, match="S001"):
        cases.strict_cases(found)
    assert [r["case_id"] for r in cases.strict_cases(found.where("case_id <> 'S001'")).collect()] == ["A001", "P002"]
    assert "report" not in "".join(c for c in cases.manifest(found).columns if c != "report_count")
    assert {r["report"] for r in cases.read_reports(spark, f"{tmp_path}/*/*.txt").collect()} == {"Some report."}


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([(" fine ",)], "report string")
    out = cases.challenge_output(df).select("output").first()[0]
    assert json.loads(out) == {"report": "fine"}
    parsed = spark.createDataFrame([(out,), ('{"report":"x","more":1}',)], "o string").select(cases.parse_output(F.col("o")).alias("r"))
    assert [r["r"] for r in parsed.collect()] == ["fine", None]
    with pytest.raises(Exception, match="20000"):
        cases.challenge_output(spark.createDataFrame([("  ",)], "report string")).collect()
    cases.write_versioned(df, f"{tmp_path}/v", 3)
    assert cases.read_versioned(spark, f"{tmp_path}/v", 3).count() == 1
    with pytest.raises(ValueError):
        cases.read_versioned(spark, f"{tmp_path}/v", 4)


def test_pairs_and_caches(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"prediction": "a", "reference": "b"}\n{"prediction": 1}\n')
    with pytest.raises(ValueError):
        cases.read_pairs(spark, f"{tmp_path}/p.json")
    want = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "case_id string, version int")
    have = spark.createDataFrame([("a", 1), ("b", 0)], "case_id string, version int")
    assert sorted(r["case_id"] for r in cases.stale_caches(want, have, ["version"]).collect()) == ["b", "c"]
    r = cases.cache_report(want, have, ["version"]).first()
    assert (r["cases"], r["missing"], r["stale"], r["ok"]) == (3, 1, 1, False)
    with pytest.raises(ValueError, match="odd"):
        cases.check_config({"odd": 1}, {"known": 2})


def test_synthetic_is_stable(spark):
    a, b = (cases.synthetic_cases(spark.newSession() if k else spark, 24, [("No lesion is seen.", 0.9, 0.5), ("The ridge is thin.", 0.2, 1.0)]).orderBy("case_id").collect() for k in (0, 1))
    assert a == b and {r["center"] for r in a} == set("PFSA")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
