"""What steps carry and hold must not grow faster than their input."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import concepts
from scoreloom.operators import additive, bank, entail, metrics, models


def test_assign_counts_pairs_without_their_sets(spark):
    many = "id int, words array<string>, concepts array<string>"
    phrases = spark.createDataFrame([(1, ["a", "b", "#x"], []), (2, ["a", "c", "d"], ["x"]), (3, ["z"], ["x"])], many)
    known = spark.createDataFrame([(0, ["a", "b"], ["x"]), (1, ["c", "d", "a"], ["x"]), (2, ["#x", "b"], [])], many.replace("id", "proto"))
    got = bank.assign(phrases, known, 0.1)
    assert {r["id"]: (r["proto"], r["similarity"] and round(r["similarity"], 6)) for r in got.collect()} == {1: (2, round(2 / 3, 6)), 2: (1, 1.0), 3: (None, None)}
    # sets of both sides would be copied once for each word that a pair has in common
    assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_mentions_are_parsed_once_whatever_reads_them(spark):
    said = spark.createDataFrame([(1, "No periapical lesion is seen at tooth 36."), (2, None)], "id int, text string")
    got = concepts.with_mentions(said)
    assert {r["id"]: len(r["mentions"] or []) for r in got.collect()} == {1: 1, 2: 0}
    # a filter of the reader, and each of two readers, had the parsing in it again
    assert "regexp_instr" not in got.select("id", F.explode("mentions"))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_clinical_scores_shuffle_no_pairs(spark):
    pairs = spark.createDataFrame([(1, "No lesion at tooth 36. The sinus is clear. The sinus is clear.", "The sinus is clear. A lesion at tooth 36."), (2, "", "The sinus is clear."), (3, None, None)], "case_id int, prediction string, reference string")
    got = entail.clinical_scores(pairs)
    sides = [entail.report_statements(pairs, c) for c in ("prediction", "reference")]
    count = lambda x, y: {r[0]: (r[1], r[2]) for r in entail.supported(x, y).groupBy("case_id").agg(F.count("*"), F.sum(F.col("entailed").cast("int"))).collect()}
    p, r = count(*sides), count(*sides[::-1])
    found = {x["case_id"]: ((x["candidate_count"], x["entailed_candidate_count"]), (x["reference_count"], x["entailed_reference_count"])) for x in got.collect()}
    assert found == {k: (p.get(k, (0, 0)), r.get(k, (0, 0))) for k in (1, 2, 3)} and found[1][0][1] > 0
    # statements met by their words, in rows of both texts, and were joined with both signs
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2


def test_equal_cases_are_scored_once(spark):
    bank = spark.createDataFrame([(0, "The left sinus is clear.", 0), (1, "A lesion is seen.", 1)], "proto int, text string, position int")
    refs = spark.createDataFrame([(k, ["The left sinus is clear." if k % 2 else "A lesion is seen. No more."], f"g{k % 3}") for k in range(12)], "case_id int, references array<string>, source string")
    table = additive.case_table(bank, refs, keep=["source"], clinical=False)
    once = additive.equal_cases(table, "source")
    assert once.count() == 2 and sum(g["n"] for r in once.collect() for g in r["groups"]) == 12
    trials = [additive.Trial((0,)), additive.Trial((0, 1), without="g1"), additive.Trial((1,), only="g2")]
    got = additive.score_trials(once, additive.statements_of(bank), trials, "source").orderBy("trial").collect()
    plain = [table, table.where("source <> 'g1'"), table.where("source = 'g2'")]
    for row, t, some in zip(got, trials, plain, strict=True):
        alone = additive.score_trials(some, additive.statements_of(bank), [additive.Trial(t.protos)]).first()
        assert row["cases"] == alone["cases"] == some.count() and row["bleu_4"] == pytest.approx(alone["bleu_4"]) and row["meteor"] == pytest.approx(alone["meteor"])


def test_nearest_by_blocks_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(models, "BLOCK", 40)
    rng = np.random.default_rng(6)
    x = rng.integers(-3, 4, (150, 5)).astype(np.float32) / 3
    x[60:90] = x[7]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(150, [1.0, 2.0]), (151, None)]
    e = spark.createDataFrame(rows, "item int, v array<float>")
    got = models.nearest(e.where("item % 10 = 0 and item < 150").withColumnRenamed("item", "query"), e.where("item < 150"), 5, others=True)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    for r in got.collect():
        d = ((x[r["query"]] - x).astype(np.float64) ** 2).sum(1) / 5
        d[r["query"]] = np.inf
        assert r["distance"] == pytest.approx(d.min()) and r["match"] == np.flatnonzero(np.isclose(d, d.min(), rtol=1e-12))[0]
    # vectors that are no plain numbers go as they went: a null distance is the least
    odd = models.nearest(e.where("item = 0").withColumnRenamed("item", "query"), e.where("item >= 140"), 5).first()
    assert odd["match"] == 150 and odd["distance"] is None


def test_nearest_by_strips_measures_what_single_precision_leaves_open(monkeypatch):
    rng = np.random.default_rng(8)
    for case in range(24):
        monkeypatch.setattr(models, "STRIP", (7, 11) if case % 2 else (256, 1024))
        monkeypatch.setattr(models, "KEPT", 5 if case % 3 == 0 else 1 << 20)
        a, b = (rng.integers(-2, 3, (int(rng.integers(1, 60)), 3 + case % 4)).astype(np.float32 if case % 4 < 2 else np.float64) / 3 for _ in "ab")
        a, b = (((v * [1, 1, 1e-22, 1e13][case % 4]) + [0, 1e6, 0][case % 3]).astype(a.dtype) for v in (a, b))
        b[0] = 1e14
        names, others = rng.integers(0, 50, len(a)), rng.permutation(len(b))
        want = []
        for i in range(len(a)):
            d = sum((a[i, k] - b[:, k]).astype(np.float64) ** 2 for k in range(a.shape[1]))
            d = np.where(others == names[i], np.inf, d)
            j = np.lexsort((others, d))[0]
            want += [(i, j, d[j])] if np.isfinite(d[j]) else []
        assert [tuple(r) for r in zip(*models._nearest_of(a, b, models._same_names(names, others), others), strict=True)] == want


def test_nearest_neighbour_asks_for_every_vector(spark, tmp_path):
    from scoreloom.plans import catalogue

    rng = np.random.default_rng(9)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(rng.normal(size=(120, 64)).astype(np.float32))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r["query"] for r in catalogue.QUERIES["nearest_neighbour"](spark, str(tmp_path)).collect()} == set(range(120))


def test_pair_counts_hold_a_slice(spark):
    tokens = np.arange(metrics.SLICE_TOKENS // 2, dtype=np.int64) % 977
    bounds = np.arange(0, len(tokens) + 1, 64)
    tracemalloc.start()
    metrics._row_counts((tokens, bounds), (tokens[::-1].copy(), bounds))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
