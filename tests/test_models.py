"""Gates from merged sums, k-means without each group, ranks by ranges: against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import bank, models, rank


def rows_of(x, names, kind="case_id string, f array<double>"):
    return [(n, [float(v) for v in r]) for n, r in zip(names, x)], kind


@pytest.fixture(scope="module")
def gate_data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 5)) * [1, 10, 0.1, 1, 0] + [0, 500, 3, 0, 2]
    names = [f"c{k:03d}" for k in range(90)]
    y = {0: x[:, 0] + rng.normal(0, 0.5, 90) > 0, 1: x[:, 1] > 505, 2: np.arange(90) < 2, 4: rng.random(90) > 0.4}
    labels = [(names[k], p) for p, own in y.items() for k in np.flatnonzero(own)]
    labels += labels[:3]  # repeated rows are one label
    features = spark.createDataFrame(*rows_of(x, names)).repartition(5)
    return x, y, names, features, spark.createDataFrame(labels, "case_id string, proto int").repartition(3)


def plain_gate(x, y, keep, least=3):
    n, pos = keep.sum(), y[keep].sum()
    if not least <= pos <= n - least:
        return None
    std = x[keep].std(0)
    mean, scale = x[keep].mean(0), np.where(std > 1e-9, std, 1.0)
    w, b = models.fit_logistic((x[keep] - mean) / scale, y[keep].astype(int))
    return w, b, mean, scale


@pytest.mark.parametrize("numbers", [1 << 22, 40])
def test_gates_equal_single_fits(spark, gate_data, monkeypatch, numbers):
    x, y, names, features, labels = gate_data
    monkeypatch.setattr(models, "CURVE_NUMBERS", numbers)
    protos = spark.createDataFrame([(p, 0.25) for p in range(5)], "proto int, prevalence double")
    for r in models.fit_gates(features, labels, protos).collect():
        want = plain_gate(x, y.get(r["proto"], np.zeros(90, bool)), np.ones(90, bool))
        assert r["fitted"] == (want is not None)
        if want:
            assert r["weights"] == pytest.approx(want[0], abs=1e-6) and r["intercept"] == pytest.approx(want[1], abs=1e-6)
            assert r["mean"] == pytest.approx(want[2]) and r["scale"] == pytest.approx(want[3])
        else:
            assert r["weights"] == [0.0] * 5 and r["intercept"] == pytest.approx(np.log(0.25 / 0.75))


def test_out_of_fold_equals_single_fits(spark, gate_data):
    x, y, names, features, labels = gate_data
    fold = np.arange(90) % 4
    folds = spark.createDataFrame([(n, int(k)) for n, k in zip(names, fold)], "case_id string, fold int")
    got = {(r["case_id"], r["proto"]): r for r in models.out_of_fold(features, labels, folds, spark.createDataFrame([(p,) for p in range(5)], "proto int")).collect()}
    assert len(got) == 450
    for p in range(5):
        own = y.get(p, np.zeros(90, bool))
        for k in range(4):
            fit = plain_gate(x, own, fold != k)
            for i in np.flatnonzero(fold == k):
                r = got[names[i], p]
                want = own[fold != k].mean() if fit is None else 1 / (1 + np.exp(-((x[i] - fit[2]) / fit[3] @ fit[0] + fit[1])))
                assert r["y"] == own[i] and r["p"] == pytest.approx(want, abs=1e-6)


def plain_kmeans(z, at, rounds=50):
    for _ in range(rounds):
        near = ((z[:, None] - at[None]) ** 2).sum(2).argmin(1)
        new = np.array([z[near == c].mean(0) if (near == c).any() else at[c] for c in range(len(at))])
        if np.abs(new - at).max() <= 1e-9:
            break
        at = new
    d = ((z[:, None] - at[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1).sum(), at


def test_kmeans_without_each_group(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(m, 1, (25, 3)) for m in (0, 5, 9)]) * [1, 20, 3]
    groups = rng.choice(["a", "b", "c"], 75)
    df = spark.createDataFrame([(f"c{k}", str(g), [float(v) for v in r]) for k, (g, r) in enumerate(zip(groups, x))], "case_id string, g string, f array<double>").repartition(4)
    routed, costs = models.grouped_kmeans(df, "g", 3, restarts=3)
    got = {(r["held_out"], r["case_id"]): r for r in routed.collect()}
    known = {r["held_out"]: r for r in costs.collect()}
    assert set(known) == {"a", "b", "c", None} and len(got) == 300
    for held in known:
        keep = np.ones(75, bool) if held is None else groups != held
        mean, std = x[keep].mean(0), x[keep].std(0)
        z = (x - mean) / std
        fits = []
        for r in range(3):
            first = df.where("true" if held is None else f"g <> '{held}'").orderBy(F.xxhash64(F.lit(2026 + r), "case_id"), "case_id").limit(3).collect()
            fits.append((*plain_kmeans(z[keep], (np.array([v["f"] for v in first]) - mean) / std)[1:], r))
        cost, at, restart = min(fits, key=lambda f: (f[0], f[2]))
        assert known[held]["cost"] == pytest.approx(cost) and known[held]["restart"] == restart
        near = ((z[:, None] - at[None]) ** 2).sum(2).argmin(1)
        assert [got[held, f"c{k}"]["cluster"] for k in range(75)] == near.tolist()
        assert all(got[held, f"c{k}"]["held"] == (not keep[k]) for k in range(75))


def test_running_sums_by_ranges(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["x", "y", None]), rng.randint(0, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, g string, n long").repartition(6)
    got = {r["k"]: r["upto"] for r in rank.running_sum(df, "n", [F.col("k").desc()], ["g"]).collect()}
    for g in ("x", "y", None):
        total = 0
        for k, _, n in sorted((r for r in rows if r[1] == g), reverse=True):
            total += n
            assert got[k] == total
    alone = {r["k"]: r["upto"] for r in rank.running_sum(df, "n", ["k"]).collect()}
    assert alone[499] == sum(n for _, _, n in rows) and rank.running_sum(df.where("false"), "n", ["k"]).count() == 0


def test_rings_of_decoys(spark):
    cases = spark.createDataFrame([(f"c{k}",) for k in range(30)], "case_id string")
    got = rank.decoys(cases, 4).collect()
    assert len(got) == 120 and len({tuple(r) for r in got}) == 120 and all(r["case_id"] != r["other"] for r in got)
    assert rank.decoys(cases.limit(1), 4).count() == 0


def test_assignment_meets_few_pairs(spark):
    """All pairs at or above the threshold are found, against plain sets, for thresholds low and high."""
    rng = random.Random(10)
    pool = [f"w{k}" for k in range(40)] + ["the"] * 30
    make = lambda n: sorted({rng.choice(pool) for _ in range(rng.randint(0, n))})
    phrases, protos = [make(14) for _ in range(150)], [make(14) for _ in range(40)]
    p = spark.createDataFrame([(k, w, []) for k, w in enumerate(phrases)], "id int, words array<string>, concepts array<string>")
    b = spark.createDataFrame([(k, w, []) for k, w in enumerate(protos)], "proto int, words array<string>, concepts array<string>")
    for t in (0.05, 0.34, 0.5, 1.0):
        got = {r["id"]: (r["similarity"], r["proto"]) for r in bank.assign(p, b, t).collect()}
        for k, w in enumerate(phrases):
            best = max(((len({*w} & {*v}) / len({*w} | {*v}), i) for i, v in enumerate(protos) if w and v), default=(0, None))
            assert got[k] == (pytest.approx(best[0]), best[1]) if best[0] >= t else got[k] == (None, None)


def test_ensemble_and_header_features(spark):
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    protos = spark.createDataFrame([(0, 0.3)], "proto int, prevalence double")
    linear = spark.createDataFrame([("a", 0, 0.9)], "case_id string, proto int, p double")
    networks = spark.createDataFrame([("a", 0, 0.1), ("b", 0, 0.2), ("b", 0, 0.6)], "case_id string, proto int, p double")
    assert {r["case_id"]: r["p"] for r in models.ensemble(cases, linear, networks, protos).collect()} == {"a": 0.9, "b": pytest.approx(0.4), "c": 0.3}
    head = spark.createDataFrame([([10, 20, 30], [0.5, 1.0, 2.0])], "shape array<int>, spacing array<double>")
    got = head.select(models.header_features(F.col("shape"), F.col("spacing")).alias("f")).first()["f"]
    assert got == pytest.approx([*np.log1p([10, 20, 30]), 0.5, 1.0, 2.0, *np.log1p([5, 20, 60])])
    report = models.prior_report(spark.createDataFrame([(0, 0.3), (1, 0.9), (2, 0.9), (3, 0.1)], "proto int, prevalence double"), 0.2, 2)
    assert [r["proto"] for r in report.collect()] == [1, 2]
