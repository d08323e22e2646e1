"""Searches, gates, assignment, conflicts, diagnostics and training pairs against plain Python."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import concepts as C
from scoreloom.functions import text as T
from scoreloom.operators import bank, metrics, models, rank, search, select


def test_counts_match_the_alignment_join(spark):
    """What is counted within a row is what the join of occurrences finds."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    df = spark.createDataFrame([(k, say(rng.randint(0, 40)), say(rng.randint(0, 40))) for k in range(60)], "case_id int, prediction string, reference string")
    met = {r["case_id"]: r["n"] for r in metrics.alignment(metrics.tokenized(df), ["case_id"]).groupBy("case_id").agg(F.count("*").alias("n")).collect()}
    for r in metrics.pair_counts(df, ["case_id"]).collect():
        assert r["matches"] == met.get(r["case_id"], 0) and r["m1"] == r["matches"] and r["t2"] == max(0, r["np"] - 1)
    assert metrics.pair_counts(df.where("false"), ["case_id"]).count() == 0


def plain_similarity(a, ca, b, cb):
    if not a & b:
        return 0.0
    j = len(a & b) / len(a | b)
    if not ca or not cb:
        return j
    return 0.7 * j + 0.3 * len(ca & cb) / len(ca | cb) if ca & cb else 0.4 * j


def test_assignment_with_concepts(spark):
    rng = random.Random(9)
    pick = lambda pool, n: {rng.choice(pool) for _ in range(n)}
    make = lambda: (pick("abcdefghij", rng.randint(0, 6)), pick("xyz", rng.randint(0, 3)))
    phrases, protos = [make() for _ in range(40)], [make() for _ in range(12)]
    rows = lambda xs: [(k, sorted(w), sorted(c)) for k, (w, c) in enumerate(xs)]
    p = spark.createDataFrame(rows(phrases), "id int, words array<string>, concepts array<string>")
    b = spark.createDataFrame(rows(protos), "proto int, words array<string>, concepts array<string>")
    got = {r["id"]: r for r in bank.assign(p, b, 0.3).collect()}
    for k, (w, c) in enumerate(phrases):
        best = max(((plain_similarity(w, c, v, d), i) for i, (v, d) in enumerate(protos)), default=(0, None))
        if best[0] >= 0.3:
            assert got[k]["similarity"] == pytest.approx(best[0]) and got[k]["proto"] == best[1]
        else:
            assert got[k]["proto"] is None
    one = spark.createDataFrame([(sorted({"a", "b"}), ["x"], ["b", "c"], ["x", "y"])], "a array<string>, b array<string>, c array<string>, d array<string>")
    assert one.select(bank.statement_similarity(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("s")).first()["s"] == pytest.approx(0.7 / 3 + 0.15)


def plain_resolution(protos, strength, foes):
    left = list(protos)
    for a in protos:
        for b in sorted(foes.get(a, ())):
            if a in left and b in left:
                left.remove(b if strength[a] >= strength[b] else a)
    return set(left)


def test_resolution_matches_a_plain_walk(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(12), 2))) for _ in range(20)}
    foes = {}
    for a, b in pairs:
        foes.setdefault(a, set()).add(b)
        foes.setdefault(b, set()).add(a)
    cases = {c: {p: rng.choice([0.1, 0.4, 0.4, 0.9]) for p in rng.sample(range(12), 7)} for c in range(25)}
    chosen = spark.createDataFrame([(c, p, v) for c, x in cases.items() for p, v in x.items()], "case_id int, proto int, p double")
    conflicts = spark.createDataFrame(sorted(pairs), "i int, j int")
    out = select.resolve(chosen, conflicts)
    got = {}
    for r in out.collect():
        got.setdefault(r["case_id"], set()).add(r["proto"])
    assert got == {c: plain_resolution(sorted(x), x, foes) for c, x in cases.items()}
    assert out.columns == chosen.columns and "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_decoded_reports(spark):
    scores = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8), (0, 2, 0.1), (1, 0, 0.1), (1, 1, 0.2), (1, 2, 0.1)], "case_id int, proto int, p double")
    thresholds = spark.createDataFrame([(k, 0.5) for k in range(3)], "proto int, thr double")
    statements = spark.createDataFrame([(0, "the sinus is clear", "sinus", 0.2), (1, "a crown on 36", "dentition", 0.1), (2, "no lesion", "periapical", 0.5)], "proto int, text string, section string, prevalence double")
    foes = spark.createDataFrame([(0, 1)], "i int, j int")
    got = {r["case_id"]: r for r in select.decoded_reports(scores, thresholds, statements, None, 1, 3).collect()}
    assert got[0]["protos"] == [1, 0] and got[0]["report"] == "A crown on 36. The sinus is clear." and got[1]["protos"] == [1]
    got = {r["case_id"]: r["report"] for r in select.decoded_reports(scores, thresholds, statements, foes, 0, 3).collect()}
    assert got == {0: "The sinus is clear.", 1: ""}


def test_contradictions(spark):
    texts = ["A periapical lesion is seen at tooth 36.", "No periapical lesion is seen.", "The maxillary sinus is clear.", "Possible periapical lesion."]
    s = C.with_mentions(spark.createDataFrame(list(enumerate(texts)), "proto int, text string"))
    assert [tuple(r) for r in select.contradictions(s).collect()] == [(0, 1)]


def test_final_scores_of_several_references(spark):
    texts = ["No periapical lesion is seen.", "Impacted tooth 48 is present."]
    predictions = spark.createDataFrame([(0, " ".join(texts)), (1, texts[0]), (2, "left out here")], "case_id int, prediction string")
    references = spark.createDataFrame([(0, texts), (1, [texts[0]]), (3, texts)], "case_id int, references array<string>")
    r = metrics.challenge_scores(predictions, references).first()
    assert r["cases"] == 2 and r["logical_precision"] == 1 and r["clinical"] == 1
    firsts = spark.createDataFrame([(0, " ".join(texts), texts[0]), (1, texts[0], texts[0])], "case_id int, prediction string, reference string")
    c = metrics.caption_scores(firsts).first()
    assert r["bleu_4"] == pytest.approx(c["bleu_4"]) and r["final"] == pytest.approx(0.8 + 0.2 * c["captioning"])
    with pytest.raises(ValueError):
        metrics.challenge_scores(predictions.where("case_id = 2"), references)


def test_searches(spark):
    texts = ["No periapical lesion is seen in the scan", "The maxillary sinus is clear on both sides", "Something quite different stands here", "A crown stands on tooth 36"]
    b = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "proto int, text string, position int")
    refs = spark.createDataFrame([(k, f"{texts[0]}. {texts[1]}.") for k in range(3)], "case_id int, reference string")
    t = search.local_search(b, refs, [0, 1, 2, 3], [2, 3], floors={})
    assert t.chosen == [0, 1] and [s["value"] for s in t.steps] == sorted(s["value"] for s in t.steps)
    assert search.local_search(b, refs, [0, 1, 2, 3], [0, 1], floors={"meteor": 2.0}).chosen == [0, 1]
    # from one statement too many, refinement takes it out
    g = search.greedy(b, refs, [0, 1, 2], most=0, refine=2)
    assert sorted(g.chosen) == [0, 1]


def test_gate_conversion(spark):
    """A gate that tells the cases apart replaces a statement of all."""
    score = lambda trials: [len(core) - sum(abs(t - 0.3) for t in gates.values()) * 4 + 1.5 * len(gates) for core, gates in trials]
    core, gates, value = search.convert_gates([1, 2], [1, 3], [0.1, 0.3, 0.5], score)
    assert (core, gates) == ({2}, {1: 0.3, 3: 0.3}) and value == pytest.approx(4.0)
    texts = ["No periapical lesion is seen.", "Impacted tooth 48 is present."]
    b = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "proto int, text string, position int")
    cases = spark.createDataFrame([(0,), (1,)], "case_id int")
    oof = spark.createDataFrame([(0, 1, 0.9), (1, 1, 0.2)], "case_id int, proto int, p double")
    refs = spark.createDataFrame([(0, [" ".join(texts)]), (1, [texts[0]])], "case_id int, references array<string>")
    chosen = search.gated_selection(cases, oof, frozenset({0}), {1: 0.5})
    assert sorted(map(tuple, chosen.collect())) == [(0, 0), (0, 1), (1, 0)]
    r = search.score_selection(chosen, b, refs).first()
    assert r["clinical"] == 1 and r["mean_sentences"] == 1.5
    assert search.score_selection(search.gated_selection(cases, oof, frozenset(), {}), b, refs).first()["final"] == 0
    used = search.compacted(spark.createDataFrame([(7,), (3,)], "proto int"), spark.createDataFrame([(5,), (3,)], "proto int"))
    assert sorted(map(tuple, used.collect())) == [(3, 0, True), (5, 1, False), (7, 2, True)]


def test_diagnostics(spark):
    cases = spark.createDataFrame([(k, "PASF"[k % 4]) for k in range(40)], "case_id int, center string")
    labels = spark.createDataFrame([(k, 0) for k in range(0, 40, 4)] + [(k, 1) for k in range(40)] + [(k, 2) for k in range(20)], "case_id int, proto int")
    b = spark.createDataFrame([(0, 0.25), (1, 1.0), (2, 0.5)], "proto int, prevalence double")
    got = {r["proto"]: r for r in rank.group_shares(labels, cases, b, "center").collect()}
    assert set(got) == {0, 2} and got[0]["style_auc"] == 1 and got[0]["largest_share"] == pytest.approx(1, abs=1e-6)
    assert got[2]["style_auc"] == pytest.approx(0.5) and got[2]["largest_share"] == pytest.approx(0.25, abs=1e-6)
    d = rank.decoys(cases, 3).collect()
    assert len(d) == 120 and all(r["case_id"] != r["other"] for r in d) and max(Counter(r["other"] for r in d).values()) == 3
    assert rank.decoys(cases.limit(2), 4).count() == 2
    own = spark.createDataFrame([(0.9,), (0.5,)], "v double")
    far = spark.createDataFrame([(0.5,), (0.1,), (0.2,)], "v double")
    r = rank.discrimination(own, far, "v").first()
    assert r["auc"] == pytest.approx((3 + 2.5) / 6) and r["separation"] == pytest.approx(0.7 - 0.8 / 3)
    grid = rank.grid(spark, {"w": [0.1, 0.5], "n": [1, 2, 3]})
    assert grid.distinct().count() == 6 and rank.leaderboard(grid, "w", ["n"], 2).count() == 2
    masked = spark.createDataFrame([("a", 3.0, 1, 1, True), ("a", 2.0, 0, 2, True), ("a", 9.0, 0, 3, False), ("b", 1.0, 1, 4, True)], "c string, s double, y int, k int, m boolean")
    assert tuple(rank.mean_average_precision(masked, "s", "y", ["c"], ["k"], "m").first()) == (1, 1.0)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 4)).astype(np.float32)
    items = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(30)], "item int, v array<float>")
    queries = items.where("item < 5").withColumnRenamed("item", "query")
    d = ((x[:5, None] - x[None]) ** 2).mean(2)
    assert {r["query"]: r["match"] for r in models.nearest(queries, items, 4).collect()} == {k: k for k in range(5)}
    np.fill_diagonal(d, np.inf)
    assert {r["query"]: r["match"] for r in models.nearest(queries, items, 4, others=True).collect()} == {k: int(d[k].argmin()) for k in range(5)}


def test_gates_over_all_cases(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    f = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(60)], "case_id int, f array<double>")
    labels = spark.createDataFrame([(k, 0) for k in range(60) if x[k, 0] > 0], "case_id int, proto int")
    got = {r["proto"]: r for r in models.fit_gates(f, labels, spark.createDataFrame([(0, 0.5), (1, 0.2)], "proto int, prevalence double")).collect()}
    assert got[0]["fitted"] and got[0]["weights"][0] > abs(got[0]["weights"][1])
    assert not got[1]["fitted"] and 1 / (1 + np.exp(-got[1]["intercept"])) == pytest.approx(0.2)


def test_composition(spark):
    texts = ["plain text", "café", "café", "ﬁne ½ ①", "ＡＢ", "it’s — so", "x²", None, "Ĳ", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: r["t"] for r in T.composed(df, "t").collect()}
    assert got == {k: t if t is None else unicodedata.normalize("NFKC", t) for k, t in enumerate(texts)}
    # the pattern for texts that are left alone holds for each of its characters, alone and side by side
    import re

    inert = [chr(c) for c in range(0x3000) if re.match(T.COMPOSED, chr(c))]
    assert all(unicodedata.normalize("NFKC", c) == c for c in inert) and len(inert) > 300
    assert unicodedata.normalize("NFKC", "".join(inert)) == "".join(inert)


def test_training_pairs(spark):
    report = "The sinus is clear. No lesion is seen. A crown is on tooth 36."
    df = spark.createDataFrame([(report,), ("One phrase only here.",), (None,)], "report string")
    plain = T.training_pairs(df, shuffled=False).collect()
    assert [r["findings"] for r in plain] == [["The sinus is clear.", "No lesion is seen.", "A crown is on tooth 36."]]
    mixed = T.training_pairs(df).collect()
    assert len(mixed) == 1 and sorted(mixed[0]["findings"]) == sorted(plain[0]["findings"]) and mixed == T.training_pairs(df.repartition(3)).collect()
    turns = spark.createDataFrame(plain).select(T.prompt(F.col("findings"), "Write it up.").alias("p")).first()["p"]
    assert turns[0]["content"] == "Write it up." and turns[1]["content"].startswith("Findings:\n- The sinus is clear.\n- No lesion") and turns[1]["content"].endswith("\n\nReport:")


def test_clusters_by_component_match_the_whole_group(spark):
    rng = random.Random(31)
    stems = [" ".join(rng.choice("abcdefghijklmnopqrst") * 2 for _ in range(6)) for _ in range(9)]
    said = set()
    for stem in stems:
        for _ in range(7):
            words = stem.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(6)] = rng.choice("uvwxyz") * 3
            said.add(" ".join(words))
    said = sorted(said)
    df = spark.createDataFrame([("all", p, p) for p in said] + [("few", "one thing", "one thing"), ("few", "other matter", "other matter")], "grp string, phrase string, canonical string")
    vectors = bank.tfidf(df).join(df.select("phrase", "grp"), "phrase").cache()
    terms = {r["phrase"]: r["terms"] for r in vectors.where("grp = 'all'").collect()}
    names = {g: k for k, g in enumerate(sorted({g for t in terms.values() for g in t}))}
    x = np.zeros((len(said), len(names)), np.float32)
    for k, p in enumerate(said):
        for g, v in terms[p].items():
            x[k, names[g]] = v
    dots = x.astype(float) @ x.T
    near = {(said[i], said[j]) for i in range(len(said)) for j in range(i + 1, len(said)) if dots[i, j] >= 0.55}
    assert {(r["a"], r["b"]) for r in bank.near_pairs(vectors.where("grp = 'all'"), "grp", 0.55).collect()} == near
    for cut in (0.45, 0.7, 1.2):
        got = {}
        for r in bank.clusters(vectors, "grp", cut).collect():
            got.setdefault((r["grp"], r["cluster"]), set()).add(r["phrase"])
        want = {}
        for p, c in zip(said, bank.average_linkage(x, cut), strict=True):
            want.setdefault(c, set()).add(p)
        assert sorted(map(sorted, (v for (g, _), v in got.items() if g == "all"))) == sorted(map(sorted, want.values()))
        assert [v for (g, _), v in got.items() if g == "few"] == [{"one thing", "other matter"}]
    assert bank.clusters(vectors.where("false"), "grp", 0.45).count() == 0


def test_routing_by_clusters(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(at, 0.3, (20, 2)) for at in (0.0, 6.0, 12.0)])
    routed, cost = models.kmeans(spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "case_id int, f array<double>"), k=3)
    cluster = {r.case_id: r.cluster for r in routed.collect()}
    assert [len({cluster[k] for k in range(a, a + 20)}) for a in (0, 20, 40)] == [1, 1, 1]
    assert len(set(cluster.values())) == 3
    groups = [points[a : a + 20] for a in (0, 20, 40)]
    assert cost == pytest.approx(sum(((g - g.mean(0)) ** 2).sum() for g in groups))
    # each case is scored with the report of its cluster, and all cases are pooled
    said = {cluster[a]: f"the canal of group {a} is regular in its course" for a in (0, 20, 40)}
    references = spark.createDataFrame([(k, said[cluster[k]] if k % 20 else "nothing of that kind here") for k in range(60)], "case_id int, reference string")
    scores = models.mixture_scores(routed.select("case_id", "cluster"), spark.createDataFrame(list(said.items()), "cluster int, prediction string"), references).first()
    plain = metrics.caption_scores(references.join(spark.createDataFrame([(k, said[cluster[k]]) for k in range(60)], "case_id int, prediction string"), "case_id")).first()
    assert scores.cases == 60 and scores.bleu_4 == pytest.approx(plain.bleu_4) and scores.meteor == pytest.approx(plain.meteor)
    assert 0.9 < scores.bleu_4 < 1


def test_linked_clusters_hold_no_matrix(spark, monkeypatch):
    """One component of many phrases: neither its distances nor the pairs that only a word links are laid out, whether it is
    merged in tasks or by rounds of joins."""
    import numpy as np

    from scoreloom.operators import linkage

    rng = random.Random(5)
    said = sorted({" ".join(f"w{(k + j * (1 + rng.randrange(2))) % 90}" for j in range(5)) for k in range(90) for _ in range(3)})
    df = spark.createDataFrame([("all", p, p) for p in said], "grp string, phrase string, canonical string")
    vectors = bank.tfidf(df).join(df.select("phrase", "grp"), "phrase").cache()
    terms = {r["phrase"]: r["terms"] for r in vectors.collect()}
    names = {g: k for k, g in enumerate(sorted({g for t in terms.values() for g in t}))}
    x = np.zeros((len(said), len(names)))
    for k, p in enumerate(said):
        for g, v in terms[p].items():
            x[k, names[g]] = v
    want = {}
    for p, c in zip(said, bank.average_linkage(x, 0.6), strict=True):
        want.setdefault(c, set()).add(p)

    def whole(*_):
        raise AssertionError("a matrix of all distances")

    monkeypatch.setattr(bank, "average_linkage", whole)
    near = x @ x.T
    for component, window in ((1 << 16, 8), (8, 1)):
        monkeypatch.setattr(linkage, "COMPONENT", component)
        monkeypatch.setattr(linkage, "TASK_VECTORS", 16)
        monkeypatch.setattr(bank, "WINDOW", window)
        got = {}
        for r in bank.clusters(vectors, "grp", 0.6).collect():
            got.setdefault(r["cluster"], set()).add(r["phrase"])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        met = {(r["a"], r["b"]) for r in bank._candidates(vectors, "grp", 0.4, "phrase").collect()}
        assert met >= {(said[i], said[j]) for i in range(len(said)) for j in range(i + 1, len(said)) if near[i, j] >= 0.4}


def test_products_of_slices(monkeypatch):
    import numpy as np

    from scoreloom.operators import linkage

    rng = np.random.default_rng(2)
    x = rng.random((40, 30)) * (rng.random((40, 30)) < 0.3)
    rows, terms = np.nonzero(x)
    a, b = np.triu_indices(40, 1)
    monkeypatch.setattr(linkage, "SLICE_TERMS", 7)
    assert np.allclose(linkage._products(a, b, rows, terms, x[rows, terms], 30), (x @ x.T)[a, b])


def test_representatives_are_judged_against_all_members(spark, monkeypatch):
    """Clusters above any sample, by pairs of blocks: the choice of all pairs joined."""
    from scoreloom.operators import central, entail

    rng = random.Random(9)
    heads = ["No periapical lesion is seen", "A periapical lesion is seen at tooth", "The left maxillary sinus is clear", "The right maxillary sinus shows thickening", "Crowns on teeth 36 and", "An implant is placed at tooth 14 and", "Some words"]
    said = {"big": {f"{rng.choice(heads)} {rng.choice(['36', '46', 'in the left', 'on both sides', 'of the the'])} {' '.join(rng.choice('abcdef') * 2 for _ in range(rng.randint(0, 5)))}." for _ in range(130)}}
    said |= {f"c{k}": {f"{' '.join(rng.choice('abc') * 2 for _ in range(4))}." for _ in range(k)} for k in range(1, 6)}
    assert len(said["big"]) > 100
    members = spark.createDataFrame([(c, p) for c, ps in said.items() for p in ps], "cluster string, phrase string")
    sig = entail.signed(members)
    both = sig.alias("a").join(sig.alias("b"), F.expr("a.cluster = b.cluster and a.phrase <> b.phrase"))
    pairs = both.select("a.cluster", F.col("a.phrase").alias("prediction"), F.col("b.phrase").alias("reference"), entail.entailment(F.col("a.sig"), F.col("b.sig")).alias("e"))
    scored = metrics.meteor(pairs, ["cluster", "prediction", "e"]).groupBy("cluster", "prediction").agg((0.8 * F.avg("e") + 0.2 * F.avg("meteor")).alias("s"))
    scores = {}
    for r in scored.collect():
        scores.setdefault(r["cluster"], []).append((-round(r["s"], 9), r["prediction"]))
    want = {c: min(v)[1] for c, v in scores.items()} | {c: next(iter(ps)) for c, ps in said.items() if len(ps) == 1}
    assert {v[0] for v in scores["big"]} != {0.0} and len({e for r in pairs.where("cluster = 'big'").select("e").distinct().collect() for e in r}) > 20
    for block in (512, 16):
        monkeypatch.setattr(central, "MEMBERS", block)
        assert {r["cluster"]: r["text"] for r in bank.representatives(members).collect()} == want


def test_cosines_are_told_where_pairs_meet(spark, monkeypatch):
    """What windows tell in full needs no second meeting, whatever run a term's rows stand in."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(60)]
    said = sorted({" ".join(words[min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randint(2, 14))) for _ in range(400)})
    df = spark.createDataFrame([("all", p, p) for p in said], "grp string, phrase string, canonical string")
    vectors = bank.tfidf(df).join(df.select("phrase", "grp"), "phrase").cache()
    # lengths by all terms, the lone ones too
    grams = {p: Counter([*(w := p.split()), *zip(w, w[1:])]) for p in said}
    df_of = Counter(g for c in grams.values() for g in c)
    weigh = lambda g, n: (1 + np.log(n)) * (np.log((1 + len(said)) / (1 + df_of[g])) + 1)
    unit = {}
    for p, c in grams.items():
        v = {g: weigh(g, n) for g, n in c.items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        unit[p] = {g: x / norm for g, x in v.items()}
    for r in vectors.collect():
        shared = sorted(x for g, x in unit[r["phrase"]].items() if df_of[g] > 1)
        assert np.allclose(sorted(r["terms"].values()), shared) and sorted(r["counts"]) == r["counts"] and min(r["counts"], default=2) > 1
    cosine = {(a, b): sum(x * unit[b].get(g, 0.0) for g, x in unit[a].items()) for a in said for b in said if a < b}
    near = {pair for pair, s in cosine.items() if s >= 0.4}
    for window in (32, 4):
        monkeypatch.setattr(bank, "WINDOW", window)
        met = {(r["a"], r["b"]): r for r in bank._candidates(vectors, "grp", 0.4, "phrase").collect()}
        assert set(met) >= near and all(met[pair]["open"] or abs(met[pair]["s"] - cosine[pair]) < 1e-9 for pair in near)
        assert window < 32 or not any(r["open"] for r in met.values())
        assert {(r["a"], r["b"]) for r in bank.near_pairs(vectors, "grp", 0.4).collect()} == near


def test_long_runs_meet_in_blocks(monkeypatch):
    monkeypatch.setattr(bank, "MEET_PAIRS", 100)
    rng = np.random.default_rng(4)
    sides = rng.random((300, 2))
    start, size = np.array([0, 5, 105]), np.array([5, 100, 195])
    got = [(a, b) for x, y in bank._first_judged(start, size, sides, 0.7) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    want = {(a, b) for s, n in zip(start, size, strict=True) for a in range(s, s + n) for b in range(a + 1, s + n) if sides[a] @ sides[b] >= 0.7}
    assert len(got) == len(set(got)) and set(got) == want


def test_runs_are_never_cut():
    import pyarrow as pa

    values = [1, 1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 4, None, None, 5]
    for kind in (pa.int64(), pa.string()):
        column = pa.array([v if v is None or kind == pa.int64() else str(v) for v in values], kind)
        batches = pa.table({"k": column}).to_batches(max_chunksize=2)
        runs = []
        for table, start in bank._whole_runs(iter(batches), ["k"], 3):
            runs += [table.column("k").slice(i, j - i).to_pylist() for i, j in zip(start.tolist(), [*start.tolist()[1:], table.num_rows], strict=True)]
        assert sum(runs, []) == column.to_pylist() and len(runs) == 6 and all(len(set(r)) == 1 for r in runs)
