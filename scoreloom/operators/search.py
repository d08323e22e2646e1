"""Searches for a report or for thresholds: loops on the driver, each step of which scores all candidates in one job.

A search is a generator that gives the trials of its next step and is sent their scores, so many searches (over folds,
weights, clusters) can take their steps together: `lockstep` scores the trials of all of them in one job.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Generator, Hashable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.written import materialize
from . import additive, metrics
from .additive import Trial


@dataclass
class Trace:
    chosen: list[int] = field(default_factory=list)
    value: float = 0.0
    steps: list[dict] = field(default_factory=list)


Objective = Callable[[dict], float]
#: Gives trials, is sent a dict of scores for each (None: no case), returns its trace.
Search = Generator[list[Trial], list[dict | None], Trace]


def captioning(m: dict) -> float:
    return m["captioning"]


def final(m: dict) -> float:
    return m["final"]


def score_reports(reports: DataFrame, references: DataFrame) -> DataFrame:
    """reports: trial, prediction; references: case_id, reference. Per trial bleu_4, meteor and captioning of that one
    report given to every case. Trials are a list of a search's own making and go to every reference."""
    pairs = references.crossJoin(reports)
    return metrics.caption_scores(pairs, ["trial"])


def rendered(bank: DataFrame, trials: list[list[int]]) -> DataFrame:
    """trial, prediction: each trial's statements in the bank's order as one report. bank: proto, text, position."""
    rows = bank.sparkSession.createDataFrame([(k, p) for k, t in enumerate(trials) for p in t], "trial int, proto int")
    placed = rows.join(bank, "proto").groupBy("trial").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("s"))
    return placed.select("trial", T.join_report(F.col("s.text")).alias("prediction"))


class Rules:
    """Which statements may join a selection: none that conflicts with one of it or repeats what one asserts. Kept up to date
    as statements come and go, so asking costs a look-up."""

    def __init__(self, conflicts: Iterable[tuple[int, int]] = (), keys: dict[int, Hashable] | None = None) -> None:
        """conflicts: pairs of statements; keys: what each asserts, null for nothing."""
        self.foes: dict[int, set[int]] = {}
        for i, j in conflicts:
            self.foes.setdefault(i, set()).add(j)
            self.foes.setdefault(j, set()).add(i)
        self.keys = keys or {}
        #: By statement how many foes of it are chosen, by key how many chosen statements have it.
        self.against: Counter[int] = Counter()
        self.asserted: Counter[Hashable] = Counter()

    def _count(self, proto: int, by: int) -> None:
        for foe in self.foes.get(proto, ()):
            self.against[foe] += by
        if (key := self.keys.get(proto)) is not None:
            self.asserted[key] += by

    def enter(self, proto: int) -> None:
        self._count(proto, 1)

    def leave(self, proto: int) -> None:
        self._count(proto, -1)

    def allow(self, proto: int) -> bool:
        key = self.keys.get(proto)
        return not self.against[proto] and (key is None or not self.asserted[key])


def greedy_steps(candidates: list[int], most: int, *, refine: int = 1, objective: Objective = captioning, rules: Rules | None = None, allowed: Callable[[list[int]], bool] | None = None, floors: dict[str, float] | None = None, pinned: list[int] | None = None, without: Hashable = None) -> Search:
    """Adds the statement that raises the objective most (of equals the largest number), then toggles single ones while
    that helps. rules: statements that may not join; allowed: leaves out inadmissible sets; floors: least metrics; pinned:
    statements that it begins with and never takes out; without: a group of cases that is held out."""
    trace, rules = Trace(), rules or Rules()
    candidates = [c for c in candidates if c not in (pinned or [])]
    good = lambda m: m is not None and all(m[k] >= v for k, v in (floors or {}).items())

    def values(trials: list[list[int]]) -> Generator[list[Trial], list[dict | None], list[float]]:
        got = yield [Trial(tuple(t), without) for t in trials]
        return [objective(m) if good(m) else float("-inf") for m in got]

    for p in pinned or []:
        rules.enter(p)
    if pinned:
        trace.chosen = list(pinned)
        (value,) = yield from values([trace.chosen])
        trace.value = max(value, 0.0)
    while len(trace.chosen) < most + len(pinned or []):
        options = [[*trace.chosen, c] for c in candidates if c not in trace.chosen and rules.allow(c)]
        options = [o for o in options if allowed is None or allowed(o)]
        if not options:
            break
        found = yield from values(options)
        value, added = max((v, o[-1]) for v, o in zip(found, options, strict=True))
        if value <= trace.value + 1e-9:
            break
        trace.chosen, trace.value = [*trace.chosen, added], value
        rules.enter(added)
        trace.steps.append({"n": len(trace.chosen), "added": added, "value": value})
    toggled = lambda c: [x for x in trace.chosen if x != c] if c in trace.chosen else [*trace.chosen, c]
    for _ in range(refine):
        # every toggle that helps is taken, in the candidates' order; a step tries all that are left to try
        rest, before = list(candidates), len(trace.steps)
        while rest:
            trials = [(c, t) for c in rest if (c in trace.chosen or rules.allow(c)) and (t := toggled(c)) and (allowed is None or allowed(t))]
            found = (yield from values([t for _, t in trials])) if trials else []
            hit = next((k for k, v in enumerate(found) if v > trace.value + 1e-9), None)
            if hit is None:
                break
            c, trace.chosen = trials[hit]
            trace.value = found[hit]
            (rules.enter if c in trace.chosen else rules.leave)(c)
            trace.steps.append({"n": len(trace.chosen), "added": c if c in trace.chosen else None, "value": trace.value})
            rest = rest[rest.index(c) + 1 :]
        if len(trace.steps) == before:
            break
    return trace


def local_steps(candidates: list[int], start: list[int], *, floors: dict[str, float], rounds: int = 10, objective: Objective = captioning, rules: Rules | None = None, allowed: Callable[[list[int]], bool] | None = None) -> Search:
    """From `start`, the best of all additions, removals and swaps of one statement, as long as it raises the objective and no
    metric falls below its floor."""
    rules = rules or Rules()

    def values(trials: list[list[int]]) -> Generator[list[Trial], list[dict | None], list[float]]:
        got = yield [Trial(tuple(t)) for t in trials]
        return [objective(m) if m is not None and all(m[k] >= v for k, v in floors.items()) else float("-inf") for m in got]

    trace = Trace(chosen=sorted(start))
    for p in trace.chosen:
        rules.enter(p)
    (trace.value,) = yield from values([trace.chosen])
    for _ in range(rounds):
        inside, outside = trace.chosen, [c for c in candidates if c not in trace.chosen]
        moves = [[*inside, c] for c in outside if rules.allow(c)]
        for a in inside:
            rules.leave(a)
            left = [x for x in inside if x != a]
            moves += [left, *([*left, b] for b in outside if rules.allow(b))]
            rules.enter(a)
        moves = [sorted(m) for m in moves if m and (allowed is None or allowed(m))]
        if not moves:
            break
        found = yield from values(moves)
        value, best = max(zip(found, moves, strict=True))
        if value <= trace.value + 1e-9:
            break
        for p in set(inside) ^ set(best):
            (rules.enter if p in best else rules.leave)(p)
        trace.chosen, trace.value = best, value
        trace.steps.append({"n": len(best), "added": None, "value": value})
    return trace


def lockstep(searches: dict[Hashable, Search], score: Callable[[list[Trial]], list[dict | None]]) -> dict[Hashable, Trace]:
    """Runs searches together: a step scores the trials of all that still go on, in one job."""
    asked: dict[Hashable, list[Trial]] = {}
    done: dict[Hashable, Trace] = {}

    def advance(name: Hashable, answer: list[dict | None] | None) -> None:
        try:
            asked[name] = searches[name].send(answer)
        except StopIteration as end:
            asked.pop(name, None)
            done[name] = end.value

    for name in searches:
        advance(name, None)
    while asked:
        turn = dict(asked)
        got = score([t for trials in turn.values() for t in trials])
        for name, trials in turn.items():
            mine, got = got[: len(trials)], got[len(trials) :]
            advance(name, mine)
    return {name: done[name] for name in searches}


def scorer(table: DataFrame, bank: additive.Statements, group: str | None = None) -> Callable[[list[Trial]], list[dict | None]]:
    """Scores trials over a case table, for `lockstep`. Equal cases are put together once, for all steps."""
    table = materialize(additive.equal_cases(table, group), "equal_cases")

    def score(trials: list[Trial]) -> list[dict | None]:
        got = {r["trial"]: r.asDict() for r in additive.score_trials(table, bank, trials, group).collect()}
        return [got.get(k) for k in range(len(trials))]

    return score


def _alone(bank: DataFrame, references: DataFrame, search: Search, clinical: bool) -> Trace:
    if "references" not in references.columns:
        references = references.select("case_id", F.array("reference").alias("references"))
    table = additive.case_table(bank, references, clinical=clinical)
    return lockstep({0: search}, scorer(table, additive.statements_of(bank)))[0]


def greedy(bank: DataFrame, references: DataFrame, candidates: list[int], *, most: int, clinical: bool = False, **options) -> Trace:
    """`greedy_steps` by itself. bank: proto, text, position; references: case_id and reference, or references (several).
    clinical: the objective or a floor needs the clinical part, so statements are judged first."""
    return _alone(bank, references, greedy_steps(candidates, most, **options), clinical)


def local_search(bank: DataFrame, references: DataFrame, candidates: list[int], start: list[int], *, clinical: bool = False, **options) -> Trace:
    """`local_steps` by itself, as `greedy`."""
    return _alone(bank, references, local_steps(candidates, start, **options), clinical)


def held_out_sweep(table: DataFrame, bank: additive.Statements, candidates: list[int], group: str, groups: list, weights: list[float], *, most: int, refine: int = 2) -> list[dict]:
    """For each weight of BLEU against METEOR and each group: weight, held_out, n, chosen, train and test BLEU-4 and METEOR of
    the one report that is found without the group. All searches take a step at once, group and weight being part of the
    trial; a last job scores each report on the group that it hasn't seen."""
    blend = lambda w: lambda m: w * m["bleu_4"] + (1 - w) * m["meteor"]
    score = scorer(table, bank, group)
    found = lockstep({(w, g): greedy_steps(candidates, most, refine=refine, objective=blend(w), without=g) for w in weights for g in groups}, score)
    seen = score([Trial(tuple(t.chosen), without=g) for (_, g), t in found.items()] + [Trial(tuple(t.chosen), only=g) for (_, g), t in found.items()])
    train, test = seen[: len(found)], seen[len(found) :]
    part = lambda m, name: {f"{name}_{k}": m[k] if m else None for k in ("bleu_4", "meteor")}
    return [{"weight": w, "held_out": g, "n": len(t.chosen), "chosen": sorted(t.chosen), **part(a, "train"), **part(b, "test")} for ((w, g), t), a, b in zip(found.items(), train, test, strict=True)]


def convert_gates(core: list[int], candidates: list[int], thresholds: list[float], evaluate: Callable[[list[tuple[frozenset[int], dict[int, float]]]], list[float]], *, rounds: int = 1) -> tuple[set[int], dict[int, float], float]:
    """Turns statements that every report has into ones that a gate lets in: each candidate in turn takes the threshold that
    scores best, if one beats the arrangement so far. evaluate scores a list of (core, gates) in one job.

    Returns the core that is left, the gates with their thresholds, and the score."""
    stays, gates = set(core), {}
    (best,) = evaluate([(frozenset(stays), dict(gates))])
    for _ in range(rounds):
        moved = False
        for c in candidates:
            trials = [(frozenset(stays - {c}), {**gates, c: t}) for t in thresholds]
            for trial, value in zip(trials, evaluate(trials), strict=True):
                if value > best + 1e-6:
                    best, moved = value, True
                    stays, gates = set(trial[0]), dict(trial[1])
        if not moved:
            break
    return stays, gates, best


def gated_selection(cases: DataFrame, oof: DataFrame, core: frozenset[int], gates: dict[int, float]) -> DataFrame:
    """case_id, proto: the core in every case, and each gated statement where its out-of-fold probability reaches its gate.
    oof: case_id, proto, p. Core and gates are a model's short lists."""
    opened = F.coalesce(*[F.when(F.col("proto") == p, F.col("p") >= t) for p, t in gates.items()], F.lit(False))
    always = cases.select("case_id", F.explode(F.array(*[F.lit(p) for p in sorted(core)]).cast("array<int>")).alias("proto"))
    return always.unionByName(oof.where(opened).select("case_id", F.col("proto").cast("int").alias("proto"))).distinct()


def selection_reports(selection: DataFrame, bank: DataFrame) -> DataFrame:
    """case_id, prediction, n: each case's statements (case_id, proto) in the bank's order (proto, text, position)."""
    placed = selection.join(bank, "proto").groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("s"))
    return placed.select("case_id", T.join_report(F.col("s.text")).alias("prediction"), F.size("s").alias("n"))


def score_selection(selection: DataFrame, bank: DataFrame, references: DataFrame) -> DataFrame:
    """Final score of a selection with its parts and mean length; a case without a statement has an empty report.
    references: case_id, references."""
    reports = references.select("case_id").join(selection_reports(selection, bank), "case_id", "left").fillna("", ["prediction"]).fillna(0, ["n"])
    return metrics.challenge_scores(reports, references).crossJoin(reports.groupBy().agg(F.avg("n").alias("mean_sentences")))


def compacted(core: DataFrame, conditional: DataFrame) -> DataFrame:
    """proto, compact, core: statements that a submission uses, numbered from 0 in order of proto. A short list."""
    from pyspark.sql import Window as W

    used = core.select("proto", F.lit(True).alias("core")).unionByName(conditional.select("proto", F.lit(False).alias("core"))).groupBy("proto").agg(F.max("core").alias("core"))
    return used.withColumn("compact", F.row_number().over(W.orderBy("proto")) - 1).select("proto", "compact", "core")


def calibrate(thresholds: dict[int, float], evaluate: Callable[[list[dict[int, float]]], list[float]], *, grid: list[float], local_grid: list[float], order: list[int], rounds: int = 1, initial: dict[int, float] | None = None, ahead: int = 16) -> tuple[dict[int, float], list[float]]:
    """Coordinate ascent over thresholds: the best one value for all, or `initial` if better, then each statement of
    `order` in turn over local_grid, until a round moves nothing. evaluate scores a list of settings in one job.

    Most statements move nothing, so a job tries several of them from where the ascent stands, twice as many (up to `ahead`)
    each time that none moved; what comes after the first that moves is tried anew, and the result is that of one
    statement after another."""
    flat = [{p: g for p in thresholds} for g in grid]
    scores = evaluate(flat)
    best = max(range(len(flat)), key=lambda k: scores[k])
    current, value = flat[best], scores[best]
    if initial is not None and (v := evaluate([initial])[0]) > value:
        current, value = dict(initial), v
    trace = [value]
    for _ in range(rounds):
        moved, at, wide = 0, 0, 1
        while at < len(order):
            some = order[at : at + wide]
            wide = min(ahead, 2 * wide)
            trials = [(k, {**current, p: g}) for k, p in enumerate(some) for g in local_grid if abs(g - current[p]) > 1e-9]
            found = evaluate([t for _, t in trials]) if trials else []
            at += len(some)
            for k in range(len(some)):
                own = [i for i, (j, _) in enumerate(trials) if j == k]
                top = max(own, key=lambda i: found[i], default=None)
                if top is not None and found[top] > value + 1e-9:
                    current, value, moved = trials[top][1], found[top], moved + 1
                    at, wide = at + k + 1 - len(some), 1
                    break
        trace.append(value)
        if not moved:
            break
    return current, trace


def selection_scores(settings: DataFrame, oof: DataFrame, bank: DataFrame, references: DataFrame, least: int, most: int) -> DataFrame:
    """settings: trial, proto, thr. Per trial the caption scores of the reports that its thresholds choose, and their
    mean length: all trials in one job, the trial being part of every key."""
    from pyspark.sql import Window as W

    m = oof.join(settings, "proto").withColumn("margin", F.col("p").cast("float") - F.col("thr").cast("float"))
    case = W.partitionBy("trial", "case_id")
    ranked = m.withColumn("rn", F.row_number().over(case.orderBy(F.desc("margin"), "proto"))).withColumn("n", F.sum((F.col("margin") >= 0).cast("int")).over(case))
    chosen = ranked.where(((F.col("margin") >= 0) & (F.col("rn") <= most)) | ((F.col("n") < least) & (F.col("rn") <= min(least, most))))
    reports = chosen.join(bank, "proto").groupBy("trial", "case_id").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("s"))
    every = settings.select("trial").distinct().crossJoin(references)
    pairs = every.join(reports, ["trial", "case_id"], "left").select("trial", "case_id", F.coalesce(T.join_report(F.col("s.text")), F.lit("")).alias("prediction"), "reference", F.coalesce(F.size("s"), F.lit(0)).alias("n"))
    return metrics.caption_scores(pairs, ["trial"]).join(pairs.groupBy("trial").agg(F.avg(F.greatest("n", F.lit(0))).alias("mean_sentences")), "trial")
