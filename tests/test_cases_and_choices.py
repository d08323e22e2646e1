"""Readers, settings, boards, choices and the model's way from a package to a report."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_volumes import nifti

from scoreloom import __main__ as command
from scoreloom.functions import concepts as C
from scoreloom.functions import fixed_values as V
from scoreloom.operators import models, rank, select
from scoreloom.plans.stages import Stages
from scoreloom.sources import cases


def test_paths_and_suffixes(spark):
    df = spark.createDataFrame([("/a/x.nii.gz",), ("/a/y.NRRD",), ("/a/z.txt",)], "path string")
    got = [tuple(r) for r in df.select(cases.has_volume_suffix(F.col("path")), cases.strip_suffix(F.col("path"))).collect()]
    assert got == [(True, "/a/x"), (True, "/a/y"), (False, "/a/z.txt")]
    folders = spark.createDataFrame([("/r/volumes",), ("/r/images",)], "path string")
    assert cases.first_existing(folders, ["cbct", "images", "volumes"]).first()["path"] == "/r/images"
    assert cases.first_existing(folders, ["none"]).first()["path"] is None


def test_one_input(spark):
    files = spark.createDataFrame([("/in/b.mha",), ("/in/a.nii",), ("/in/note.txt",)], "path string")
    with pytest.raises(ValueError, match="2 found"):
        cases.single_input(files)
    assert cases.single_input(files, first_of_many=True) == "/in/a.nii"
    assert cases.single_input(files.where("path like '%mha'")) == "/in/b.mha"
    with pytest.raises(ValueError, match="none found"):
        cases.single_input(files.where("path like '%txt'"))


def test_corpus_and_invariants(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"case_id": "a", "reports": ["x"]}\n\n{"case_id": "b", "reports": ["y", "z"]}\n')
    assert sorted(r["case_id"] for r in cases.read_corpus(spark, f"{tmp_path}/c.json").collect()) == ["a", "b"]
    (tmp_path / "e.json").write_text("\n")
    with pytest.raises(ValueError, match="no cases"):
        cases.read_corpus(spark, f"{tmp_path}/e.json")
    good = spark.createDataFrame([("a", ["x"])], "case_id string, reports array<string>")
    assert cases.valid_cases(good).count() == 1
    for bad in ((" ", ["x"]), ("a", []), ("a", ["x", " "])):
        with pytest.raises(Exception, match="not blank"):
            cases.valid_cases(spark.createDataFrame([bad], good.schema)).collect()


def test_boards_and_tables(spark, tmp_path):
    (tmp_path / "b.csv").write_text("position,team,score\n2, Beta ,0.5\n1,Alpha,0.75\n10,Gamma,0.25\n")
    board = cases.anonymized_board(spark, f"{tmp_path}/b.csv", ["position", "team", "score"], ["position", "score"])
    assert [tuple(r) for r in board.orderBy("anonymous_entry").collect()] == [("1", "0.75", "Entry-01"), ("2", "0.5", "Entry-02"), ("10", "0.25", "Entry-03")]
    with pytest.raises(ValueError, match="rank"):
        cases.anonymized_board(spark, f"{tmp_path}/b.csv", ["rank"], ["score"])
    wide = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 0.0)], "case_id string, p1 double, p2 double")
    assert [tuple(r) for r in cases.matrix_to_rows(wide).collect()] == [("a", "p1", 1.0)] and cases.matrix_to_rows(wide, keep_zero=True).count() == 4
    one, two = spark.createDataFrame([(0.5, 3)], "bleu double, n int"), spark.createDataFrame([(0.25,)], "bleu double")
    rows = cases.with_provenance({"prior": one, "model": two}, ["bleu", "n"], {"model": "fold 1"})
    assert [tuple(r) for r in rows.orderBy("place").collect()] == [("prior", None, 0, 0.5, 3), ("model", "fold 1", 1, 0.25, None)]
    lines = [r["line"] for r in cases.markdown(rows.orderBy("place"), ["variant", "bleu", "n"]).collect()]
    assert lines == ["| prior | 0.5 | 3 |", "| model | 0.25 | - |"]
    settings = rank.grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]})
    assert settings.count() == 6 and {tuple(r) for r in settings.collect()} == {(a, b) for a in (1, 2) for b in "xyz"}


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# note\n\nexport SCORELOOM_MOST=9\nSCORELOOM_NAME='a b'\n")
    given = cases.dotenv(str(tmp_path / ".env"))
    assert given == {"SCORELOOM_MOST": "9", "SCORELOOM_NAME": "a b"}
    assert cases.overridden({"most": 26, "name": None, "least": 6}, given) == {"most": 9, "name": "a b", "least": 6}
    (tmp_path / ".env").write_text("no sign\n")
    with pytest.raises(ValueError, match=":1:"):
        cases.dotenv(str(tmp_path / ".env"))


def test_admissible(spark):
    candidates = spark.createDataFrame([(0, "x"), (1, "x"), (2, None), (3, "y"), (4, None)], "proto int, key string")
    chosen = candidates.where("proto in (0, 2)")
    foes = spark.createDataFrame([(2, 3)], "i int, j int")
    assert [r["proto"] for r in select.admissible(candidates, chosen, foes).collect()] == [4]


def test_consistent_subsets(spark):
    rows = [("c", 0, "k"), ("c", 1, "k"), ("c", 2, None), ("c", 3, None), ("c", 4, "m"), ("d", 0, "k"), ("d", 1, "k2")]
    s = spark.createDataFrame(rows, "case_id string, position int, key string")
    foes = spark.createDataFrame([("c", 2, 3), ("c", 1, 4), ("d", 0, 1)], "case_id string, i int, j int")
    got = sorted((r["case_id"], r["position"]) for r in select.consistent_subset(s, foes).collect())
    assert got == [("c", 0), ("c", 2), ("c", 4), ("d", 0)]  # 4 stays, as its foe 1 went


def test_lengths_and_medoids(spark):
    curve = spark.createDataFrame([(1, 0.5), (2, 0.8), (3, 0.81)], "n int, v double")
    assert [r["n"] for r in rank.pinned_or_knee(curve, "n", "v", 0.1).collect()] == [2] and rank.pinned_or_knee(curve, "n", "v", 0.1, pinned=3).first()["v"] == 0.81
    u = spark.createDataFrame([("g", 0, 1, 0.5, 3), ("g", 0, 2, 0.5, 3), ("g", 1, 0, 0.5, 9), ("g", 1, 2, 0.5, 9), ("g", 2, 0, 0.1, 9), ("g", 2, 1, 0.2, 9)], "g string, i int, j int, u double, n int")
    assert rank.medoid(u, ["g"]).first()["chosen"] == 1
    sets = spark.createDataFrame([("g", 0, ["a", "b"], 1), ("g", 1, ["a", "b", "c"], 1), ("g", 2, ["z"], 1)], "g string, i int, words array<string>, n int")
    assert rank.consensus(sets, ["g"]).first()["chosen"] == 0


def test_retrieval_model(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 3)) * [1, 100, 1] + [0, 7, 2]
    x[:, 2] = 5.0
    f = spark.createDataFrame([(f"c{k}", [float(v) for v in r]) for k, r in enumerate(x)], "case_id string, f array<double>")
    said = spark.createDataFrame([(f"c{k}", f"Report {k}.") for k in range(20)], "case_id string, report string")
    cases.write_versioned(models.fit_retrieval(f, said), f"{tmp_path}/model", 2)
    model = cases.read_versioned(spark, f"{tmp_path}/model", 2)
    asked = x[:5] + rng.normal(size=(5, 3)) * [0.1, 10, 0]
    q = spark.createDataFrame([(f"q{k}", [float(v) for v in r]) for k, r in enumerate(asked)], "case_id string, f array<double>")
    std = np.where(x.std(0) > 1e-9, x.std(0), 1)
    z, zq = (x - x.mean(0)) / std, (asked - x.mean(0)) / std
    for r in models.retrieved(model, q, 3).collect():
        d = ((z - zq[int(r["case_id"][1:])]) ** 2).mean(1)
        assert r["match"] == f"c{d.argmin()}" and r["distance"] == pytest.approx(d.min()) and r["report"] == f"Report {d.argmin()}."


def test_catalogue_records():
    assert len({c.key for c in V.CATALOGUE}) == len(V.CATALOGUE) and all(bool(c.patterns) != bool(c.covers) for c in V.CATALOGUE)
    assert [c.key for c in C.CONCEPTS] == [c.key for c in V.CATALOGUE] and {c.section for c in V.CATALOGUE} <= set(V.SECTIONS)


def test_predict_and_ablation(spark, tmp_path, capsys):
    rng = np.random.default_rng(5)
    data, work = tmp_path / "data", str(tmp_path / "work")
    said = ["The right maxillary sinus shows mucosal thickening.", "Impacted tooth 48 is visible.", "The mandibular canals are regular."]
    for k in range(8):
        case = data / f"P{k:03d}"
        case.mkdir(parents=True)
        (case / "volume.nii").write_bytes(nifti(rng.integers(0, 900 + 90 * k, (6, 7, 8)).astype(np.float32), [0.8, 0.8, 0.8]))
        (case / "report_1.txt").write_text(" ".join(said[i] for i in range(3) if (k >> i) & 1 or i == 2), encoding="utf-8")
    s = Stages(spark, work, str(data), least=1, most=3, shape=[6, 6, 6])
    s.run_all(rounds=0)
    rows = {r["variant"]: r for r in s.ablation().collect()}
    assert set(rows) == {"prior", "model"} and rows["model"]["final"] == pytest.approx(s.read("scores").first()["final"])
    (tmp_path / "config.json").write_text('{"shape": [6, 6, 6], "least": 1, "most": 3}')
    capsys.readouterr()
    new = tmp_path / "new.nii"
    new.write_bytes(nifti(rng.integers(0, 1200, (6, 7, 8)).astype(np.float32), [0.8, 0.8, 0.8]))
    assert command.main(["--work", work, "--config", str(tmp_path / "config.json"), "predict", "--volume", str(new)]) == 0
    (row,) = (json.loads(line) for line in capsys.readouterr().out.splitlines())
    assert row["case_id"] == "new" and json.loads(row["output"]) == {"report": row["report"]} and 1 <= len(row["protos"]) <= 3
    new.write_bytes(b"broken")
    assert command.main(["--work", work, "predict", "--volume", str(new)]) == 2
