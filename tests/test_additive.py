"""Additive scores of selections against whole reports; searches against plain loops."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import concepts as C
from scoreloom.operators import additive, metrics, search, select

SAID = [
    "No periapical lesion is seen.", "A periapical lesion is visible at tooth 36.", "Impacted tooth 48 is present.", "No impacted teeth.", "The left maxillary sinus is clear.",
    "Composite fillings on teeth 36 and 46.", "The bone is fine. A crown is on tooth 11", "the patient was scanned twice", "Fine.", "A", "Composite fillings on teeth 36 and 46.",
]


@pytest.fixture(scope="module")
def study(spark):
    rng = random.Random(6)
    bank = spark.createDataFrame([(k, t, (k * 7) % 11, "other", 0.5 - k / 100) for k, t in enumerate(SAID)], "proto int, text string, position int, section string, prevalence double")
    cases = [(c, [" ".join(rng.sample(SAID, rng.randint(0, 5))) for _ in range(rng.randint(1, 2))], "ab"[c % 2]) for c in range(24)] + [(90, [""], "b"), (91, ["A fine crown of bone 36 is visible, visible."], "a")]
    refs = spark.createDataFrame(cases, "case_id int, references array<string>, centre string")
    return bank, refs, additive.case_table(bank, refs, keep=["centre"]), additive.statements_of(bank)


PARTS = ("bleu_4", "meteor", "logical_precision", "logical_recall", "clinical", "final", "captioning")


def whole_way(spark, bank, refs, chosen):
    """chosen: case to protos. The scores of the rendered reports."""
    rows = spark.createDataFrame([(c, p) for c, ps in chosen.items() for p in ps], "case_id int, proto int")
    return search.score_selection(rows, bank, refs.select("case_id", "references")).first().asDict()


def test_constant_trials_equal_whole_reports(spark, study):
    bank, refs, table, said = study
    rng = random.Random(3)
    trials = [tuple(rng.sample(range(len(SAID)), n)) for n in (1, 2, 4, 7, 11)] + [(9, 8), (9,)]
    got = {r["trial"]: r for r in additive.score_trials(table, said, [search.Trial(t) for t in trials]).collect()}
    ids = [r["case_id"] for r in refs.collect()]
    for k, t in enumerate(trials):
        want = whole_way(spark, bank, refs, dict.fromkeys(ids, t))
        assert got[k]["cases"] == len(ids) and got[k]["mean_sentences"] == len(t)
        assert {c: got[k][c] for c in PARTS} == pytest.approx({c: want[c] for c in PARTS}), t
    # with and without a group
    some = additive.score_trials(table, said, [search.Trial((1, 4), without="a"), search.Trial((1, 4), only="b"), search.Trial((2,), only="none")], "centre").collect()
    assert {r["trial"] for r in some} == {0, 1}
    want = whole_way(spark, bank, refs.where("centre = 'b'"), {c: (1, 4) for c in ids})
    for r in some:
        assert r["final"] == pytest.approx(want["final"])


def test_settings_equal_decoded_reports(spark, study):
    bank, refs, table, said = study
    rng = random.Random(8)
    ids = [r["case_id"] for r in refs.collect()]
    scores = spark.createDataFrame([(c, p, float(np.float32(rng.choice([0.1, 0.4, 0.4, 0.6, 0.9])))) for c in ids for p in range(len(SAID))], "case_id int, proto int, p double")
    foes = select.contradictions(C.with_mentions(bank.select("proto", "text")))
    settings = [dict.fromkeys(range(len(SAID)), t) for t in (0.2, 0.5, 0.95)] + [{p: rng.random() for p in range(len(SAID))}]
    decoding = additive.Decoding(list(range(len(SAID))), 2, 5, [tuple(r) for r in foes.collect()])
    got = {r["trial"]: r for r in additive.score_settings(additive.with_probabilities(table, scores), said, decoding, settings).collect()}
    for k, s in enumerate(settings):
        thresholds = spark.createDataFrame(list(s.items()), "proto int, thr double")
        decoded = select.decoded_reports(scores, thresholds, bank, foes, 2, 5)
        chosen = {r["case_id"]: r["protos"] or [] for r in decoded.collect()}
        want = whole_way(spark, bank, refs, chosen)
        assert {c: got[k][c] for c in PARTS} == pytest.approx({c: want[c] for c in PARTS})


def plain_greedy(value, candidates, most, refine, may_join):
    chosen, best, steps = [], 0.0, []
    for _ in range(most):
        options = [(value([*chosen, c]), c) for c in candidates if c not in chosen and may_join(c, chosen)]
        if not options or max(options)[0] <= best + 1e-9:
            break
        best, c = max(options)
        chosen.append(c)
        steps.append((len(chosen), c))
    for _ in range(refine):
        improved = False
        for c in candidates:
            if c not in chosen and not may_join(c, chosen):
                continue
            trial = [x for x in chosen if x != c] if c in chosen else [*chosen, c]
            if trial and (v := value(trial)) > best + 1e-9:
                chosen, best, improved = trial, v, True
                steps.append((len(chosen), c if c in chosen else None))
        if not improved:
            break
    return chosen, best, steps


def test_constrained_search_against_a_plain_loop(spark, study):
    bank, refs, table, said = study
    marked = C.with_mentions(bank.select(F.col("proto").alias("id"), "text"))
    foes = {(r["i"], r["j"]) for r in select.conflict_pairs(marked).collect()}
    keys = {r["id"]: r["key"] for r in marked.select("id", F.to_json(C.assertion_key(F.col("mentions"))).alias("key")).collect()}
    assert (0, 1) in foes and keys[5] == keys[10] is not None
    sets = [c for n in range(1, 7) for c in itertools.combinations(range(len(SAID)), n)]
    known = {sets[r["trial"]]: r["final"] for r in additive.score_trials(table, said, [search.Trial(c) for c in sets]).collect()}

    def value(chosen):
        return known[tuple(sorted(chosen))]

    def may_join(c, chosen):
        return all((min(c, x), max(c, x)) not in foes and (keys[c] is None or keys[c] != keys[x]) for x in chosen)

    want = plain_greedy(value, list(range(len(SAID))), 6, 2, may_join)
    got = search.lockstep({0: search.greedy_steps(list(range(len(SAID))), 6, refine=2, objective=search.final, rules=search.Rules(foes, keys))}, search.scorer(table, said))[0]
    assert (got.chosen, [(s["n"], s["added"]) for s in got.steps]) == (want[0], want[2]) and got.value == pytest.approx(want[1])
    free = search.greedy(bank, refs.drop("centre"), list(range(len(SAID))), most=6, refine=2, clinical=True, objective=search.final)
    assert free.value >= got.value and not all(may_join(c, [x for x in got.chosen if x != c]) is False for c in got.chosen)
    pinned = search.lockstep({0: search.greedy_steps([2, 3, 4], 1, refine=0, pinned=[1], objective=search.final)}, search.scorer(table, said))[0]
    assert pinned.chosen[0] == 1 and len(pinned.chosen) <= 2


def test_rules_follow_what_comes_and_goes():
    rng = random.Random(1)
    foes, keys = [(0, 1), (1, 2), (3, 4)], {0: "x", 5: "x", 6: None, 7: None}
    rules, chosen = search.Rules(foes, keys), []
    for _ in range(200):
        c = rng.randrange(8)
        if c in chosen:
            chosen.remove(c)
            rules.leave(c)
        elif rules.allow(c):
            assert not any({a, c} in ({*f} for f in foes) or (keys.get(c) and keys.get(a) == keys[c]) for a in chosen)
            chosen.append(c)
            rules.enter(c)
        else:
            assert any({a, c} in ({*f} for f in foes) or (keys.get(c) and keys.get(a) == keys[c]) for a in chosen)


def test_sweep_equals_one_search_a_fold(spark, study):
    bank, refs, table, said = study
    rows = search.held_out_sweep(table, said, list(range(6)), "centre", ["a", "b"], [0.5, 0.9], most=3)
    assert [(r["weight"], r["held_out"]) for r in rows] == [(0.5, "a"), (0.5, "b"), (0.9, "a"), (0.9, "b")]
    for r in rows:
        own = refs.where(F.col("centre") != r["held_out"]).drop("centre")
        alone = search.greedy(bank, own, list(range(6)), most=3, refine=2, objective=lambda m, w=r["weight"]: w * m["bleu_4"] + (1 - w) * m["meteor"])
        assert sorted(alone.chosen) == r["chosen"]
        pairs = search.rendered(bank, [r["chosen"]]).crossJoin(refs.where(F.col("centre") == r["held_out"]).select("case_id", metrics.first_reference(F.col("references")).alias("reference")))
        seen = metrics.caption_scores(pairs).first()
        assert (r["test_bleu_4"], r["test_meteor"]) == pytest.approx((seen["bleu_4"], seen["meteor"]))


@pytest.mark.parametrize("ahead", [1, 3, 50])
def test_ascent_ahead_equals_one_by_one(ahead):
    rng = random.Random(5)
    goal = {p: rng.choice([0.1, 0.3, 0.5, 0.7]) for p in range(12)}
    asked = []

    def score(s):
        return sum(1 - abs(s[p] - goal[p]) for p in goal) - 0.5 * abs(s[0] - s[11])

    def evaluate(settings):
        asked.append(len(settings))
        return [score(s) for s in settings]

    found, trace = search.calibrate(dict.fromkeys(goal, 0.5), evaluate, grid=[0.2, 0.4], local_grid=[0.1, 0.3, 0.5, 0.7], order=list(goal), rounds=4, ahead=ahead)
    current, value = dict.fromkeys(goal, 0.4), score(dict.fromkeys(goal, 0.4))
    for _ in range(4):
        before = value
        for p in goal:
            v, g = max((score({**current, p: g}), -g) for g in (0.1, 0.3, 0.5, 0.7))
            if v > value + 1e-9:
                current[p], value = next(x for x in (0.1, 0.3, 0.5, 0.7) if score({**current, p: x}) == v), v
        if value == before:
            break
    assert found == current and trace[-1] == pytest.approx(value)
