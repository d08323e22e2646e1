"""Operators against plain Python: captions, alignment, selection, ranks, models, searches."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import bank, entail, metrics, models, rank, search, select
from scoreloom.functions import concepts as C


def words(rng, n):
    return " ".join(rng.choice("abcdefgh") for _ in range(n))


def plain_bleu(pairs):
    num, den, hl, rl = [0] * 4, [0] * 4, 0, 0
    for p, r in pairs:
        p, r = p.split(), r.split()
        hl, rl = hl + len(p), rl + len(r)
        for n in range(1, 5):
            a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (p, r))
            num[n - 1] += sum(min(v, b[k]) for k, v in a.items())
            den[n - 1] += max(1, sum(a.values()))
    if not num[0]:
        return 0.0
    bp = 1.0 if hl > rl else math.exp(1 - rl / hl)
    return bp * math.exp(sum(math.log((a or 0.1) / b) for a, b in zip(num, den)) / 4)


def plain_meteor(p, r):
    p, r = p.split(), r.split()
    if not p and not r:
        return 1.0
    used, at = set(), []
    for t in p:
        for i, x in enumerate(r):
            if i not in used and t == x:
                used.add(i)
                at.append(i)
                break
    if not at:
        return 0.0
    m, chunks = len(at), 1 + sum(b != a + 1 for a, b in zip(at, at[1:]))
    pr, rc = m / len(p), m / len(r)
    return 10 * pr * rc / (rc + 9 * pr) * (1 - 0.5 * (chunks / m) ** 3)


def test_captions_match_plain_python(spark):
    rng = random.Random(3)
    rows = [(k, words(rng, rng.randint(0, 30)), words(rng, rng.randint(0, 30))) for k in range(40)] + [(100, "", ""), (101, "a b", ""), (102, "", "a")]
    df = spark.createDataFrame(rows, "case_id int, prediction string, reference string")
    got = metrics.corpus_bleu(df).first()
    assert got["bleu_4"] == pytest.approx(plain_bleu([(p, r) for _, p, r in rows]), abs=1e-12)
    for r in metrics.meteor(df).collect():
        _, p, q = next(x for x in rows if x[0] == r["case_id"])
        assert r["meteor"] == pytest.approx(plain_meteor(p, q), abs=1e-12)


def test_caption_edges(spark):
    df = lambda p, r: spark.createDataFrame([(0, p, r)], "case_id int, prediction string, reference string")
    long = "one two three four five six seven eight nine ten"
    assert metrics.corpus_bleu(df(long, long)).first()["bleu_4"] == pytest.approx(1.0)
    assert metrics.meteor(df(long, long)).first()["meteor"] == pytest.approx(0.9995)
    assert metrics.corpus_bleu(df("a b c", "a b c")).first()["bleu_4"] == pytest.approx(0.1**0.25, abs=1e-9)
    assert metrics.corpus_bleu(df("", "a b")).first()["bleu_4"] == 0.0
    assert metrics.corpus_bleu(df("a", "a").where("false")).first()["bleu_4"] == 0.0
    assert metrics.term_f1(df("an implant", "bone implant")).first()["term_f1"] == pytest.approx(2 / 3)


def test_entailment(spark):
    def score(a, b):
        s = entail.signed(spark.createDataFrame([(0, a), (1, b)], "k int, phrase string"))
        x, y = s.where("k = 0").select(F.col("sig").alias("a")), s.where("k = 1").select(F.col("sig").alias("b"))
        return x.join(y).select(entail.entailment(F.col("a"), F.col("b")).alias("e")).first()["e"]

    assert score("Mucosal thickening of the left maxillary sinus.", "Left maxillary sinus with mucosal thickening.") >= 0.62
    assert score("No periapical lesion.", "Periapical lesion is present.") == 0.0
    assert score("Left maxillary sinus is opacified.", "Right maxillary sinus is opacified.") == 0.0
    assert score("Impacted tooth 38.", "Impacted tooth 48.") == 0.0
    assert score("Left mandibular canal is regular.", "Bilateral mandibular canals are regular.") > 0


def test_report_scores(spark):
    full = "No periapical lesion is seen. Impacted tooth 48 is present. The maxillary sinus is clear."
    less = "No periapical lesion is seen. The maxillary sinus is clear."
    df = spark.createDataFrame([(0, less, full), (1, full, less), (2, "", full)], "case_id int, prediction string, reference string")
    got = {r["case_id"]: r for r in entail.clinical_scores(df).collect()}
    assert got[0]["logical_precision"] == 1 and got[0]["logical_recall"] < 1
    assert got[1]["logical_recall"] == 1 and got[1]["logical_precision"] < 1
    assert got[2]["logical_f1"] == 0
    total = entail.clinical_aggregate(entail.clinical_scores(df)).first()
    p, r = total["logical_precision"], total["logical_recall"]
    assert total["logical_f1"] == pytest.approx(2 * p * r / (p + r))


def test_threshold_selection_bounds(spark):
    rng = random.Random(1)
    rows = [(c, p, rng.random()) for c in range(10) for p in range(8)]
    s = spark.createDataFrame(rows, "case_id int, proto int, p double")
    t = spark.createDataFrame([(p, 0.5) for p in range(8)], "proto int, thr double")
    for least, most in ((0, 8), (3, 4), (8, 8)):
        got = Counter(r["case_id"] for r in select.threshold_select(s, t, least, most).where("chosen").collect())
        for c in range(10):
            n = sum(p >= 0.5 for k, _, p in rows if k == c)
            assert got[c] == max(least, min(most, n))


def test_resolve_and_subsets(spark):
    chosen = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.9), (0, 3, 0.2), (1, 2, 0.5)], "case_id int, proto int, p double")
    foes = spark.createDataFrame([(1, 2), (2, 3)], "i int, j int")
    assert sorted((r[0], r[1]) for r in select.resolve(chosen, foes).select("case_id", "proto").collect()) == [(0, 1), (0, 3), (1, 2)]
    s = spark.createDataFrame([(0, 0, "x", 1.0), (0, 1, "x", 2.0), (0, 2, None, 0.0), (0, 3, None, 0.0)], "case_id int, position int, key string, v double")
    assert sorted(r["position"] for r in select.deduplicate(s, score="v").collect()) == [1, 2, 3]
    none = spark.createDataFrame([(0, 2, 3)], "case_id int, i int, j int")
    assert sorted(r["position"] for r in select.consistent_subset(s, none).collect()) == [0, 2]


def test_conflicts(spark):
    texts = ["Absence from the arch of teeth 35, 36 and 37.", "Composite fillings on teeth 36.", "Complete edentulism of the mandible.", "Mandibular canal course is lingual.", "Mandibular canal course is buccal."]
    s = C.with_mentions(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    got = {(r["i"], r["j"]): r["reason"] for r in select.conflict_pairs(s).collect()}
    assert got[(0, 1)] == "absent tooth described" and got[(1, 2)] == "complete edentulism" and got[(3, 4)] == "exclusive attribute"


def test_ranks(spark):
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 10, 60), rng.integers(0, 2, 60)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(s, y)], "s int, y int")
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert rank.auc(df, "s", "y").first()["auc"] == pytest.approx(np.mean(pairs))
    assert rank.auc(df.where("y = 1"), "s", "y").first()["auc"] is None
    curve = spark.createDataFrame([(1, 0.5), (2, 0.8), (3, 0.81), (4, 1.2)], "n int, v double")
    assert rank.knee(curve, "n", "v", 0.1).first()["knee"] == 2 and rank.knee(curve, "n", "v", 0.001).first()["knee"] == 4


def test_folds_and_models(spark):
    cases = spark.createDataFrame([(f"{g}{k:03d}", g) for g in "PSA" for k in range(23)], "case_id string, center string")
    folds = models.stratified_folds(cases, "center", 5).collect()
    sizes = Counter((r["center"], r["fold"]) for r in folds)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(folds) == 69
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=80) > 0).astype(int)
    w, b = models.fit_logistic(x, y)
    assert np.mean(((x @ w + b) > 0) == y) > 0.85
    f = spark.createDataFrame([(f"c{k}", [float(v) for v in x[k]]) for k in range(80)], "case_id string, f array<double>")
    lab = spark.createDataFrame([(f"c{k}", 0) for k in range(80) if y[k]], "case_id string, proto int")
    fo = spark.createDataFrame([(f"c{k}", k % 4) for k in range(80)], "case_id string, fold int")
    got = models.out_of_fold(f, lab, fo, spark.createDataFrame([(0,), (1,)], "proto int"))
    assert rank.auc(got.where("proto = 0"), "p", "y").first()["auc"] > 0.75
    assert {r["p"] for r in got.where("proto = 1").collect()} == {0.0}  # no support: the prior


def test_average_linkage_matches_naive():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - x @ x.T
    groups = [[k] for k in range(30)]
    while len(groups) > 1:
        best = min((np.mean([d[a, b] for a in p for b in q]), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
        if best[0] >= 0.6:
            break
        _, i, j = best
        groups[i] += groups.pop(j)
    got = bank.average_linkage(x.astype(np.float64), 0.6)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got.tolist())}


def test_statement_bank_has_long_phrases(spark, tmp_path):
    from scoreloom.plans import catalogue

    text = "The quick survey of all the northern rooms shows that seventeen wooden tables were painted green before the winter festival began."
    rows = [(k, 0, "user", text) for k in range(3)] + [(k, 1, "user", f"A short note about number{k} is here.") for k in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalogue.QUERIES["statement_bank"](spark, str(tmp_path)).collect()
    assert any("seventeen wooden tables" in r["text"] and r["support"] == 3 for r in got)


def test_greedy_search_improves(spark):
    texts = ["No periapical lesion is seen in the scan", "The maxillary sinus is clear on both sides", "Something quite different stands here"]
    b = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "proto int, text string, position int")
    refs = spark.createDataFrame([(k, f"{texts[0]}. {texts[1]}.") for k in range(3)], "case_id int, reference string")
    t = search.greedy(b, refs, [0, 1, 2], most=3, refine=0)
    assert sorted(t.chosen) == [0, 1] and [s["value"] for s in t.steps] == sorted(s["value"] for s in t.steps)


def test_calibrate():
    best = {0: 0.3, 1: 0.7}
    score = lambda settings: [-sum((s[p] - best[p]) ** 2 for p in best) for s in settings]
    got, trace = search.calibrate({0: 0.5, 1: 0.5}, score, grid=[0.4, 0.5, 0.6], local_grid=[0.1, 0.3, 0.5, 0.7], order=[0, 1], rounds=3)
    assert got == best and trace == sorted(trace)
