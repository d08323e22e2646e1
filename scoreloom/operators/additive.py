"""Scores of selections of statements by counts that are taken once, so that no trial is rendered, tokenised or judged anew.

`case_table` has a row for each case: its reference's tokens, which statements of the bank its reference statements support,
and which statements of the bank support each of these. A trial, a list of statements, is then scored by sums: n-grams
within a statement are counted once for the bank, those that straddle neighbours are added, and what a case has of them
is clipped to its reference. Trials go to the tasks as a short list, a task adds up its cases, and what comes back is one
row of sums a trial, however many cases there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..sources.written import materialize
from . import entail, metrics
from .metrics import ORDERS

SUMS = ["cases", *(f"n{n}" for n in ORDERS), *(f"d{n}" for n in ORDERS), "hyp_len", "ref_len", "meteor", "logical_precision", "logical_recall", "sentences"]
Gram = tuple[int, ...]


@dataclass(frozen=True)
class Trial:
    """Statements that every case gets. without: the group whose cases are left out; only: the group that is scored."""

    protos: tuple[int, ...]
    without: Hashable = None
    only: Hashable = None


class Statements:
    """The bank as trials are made of it, a short list: tokens of each statement, its place and its n-grams."""

    def __init__(self, rows: Iterable[tuple[int, int, list[int], int]]) -> None:
        """rows: proto, position, tokens, number of phrases."""
        given = {p: (at, tuple(tokens), pieces) for p, at, tokens, pieces in rows}
        self.place = {p: (at, p) for p, (at, _, _) in given.items()}
        self.tokens = {p: t for p, (_, t, _) in given.items()}
        self.pieces = {p: n for p, (_, _, n) in given.items()}
        self.grams = {p: [Counter(t[i : i + n] for i in range(len(t) - n + 1)) for n in ORDERS] for p, t in self.tokens.items()}

    def ordered(self, protos: Iterable[int]) -> tuple[int, ...]:
        return tuple(sorted(protos, key=self.place.__getitem__))

    def straddling(self, ordered: tuple[int, ...]) -> Counter[Gram]:
        """N-grams that begin in a statement and end in one after it."""
        out: Counter[Gram] = Counter()
        longest = max(ORDERS)
        for k, p in enumerate(ordered[:-1]):
            after: list[int] = []
            for other in ordered[k + 1 :]:
                after += self.tokens[other]
                if len(after) >= longest - 1:
                    break
            tail = self.tokens[p][1 - longest :]
            for i in range(len(tail)):
                own = tail[i:]
                out.update((*own, *after[: n - len(own)]) for n in ORDERS if 0 < n - len(own) <= len(after))
        return out

    def counts(self, ordered: tuple[int, ...]) -> Counter[Gram]:
        """All n-grams of the trial, as often as it has them."""
        out = self.straddling(ordered)
        for p in ordered:
            for c in self.grams[p]:
                out.update(c)
        return out

    def sequence(self, ordered: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(t for p in ordered for t in self.tokens[p])


def statements_of(bank: DataFrame) -> Statements:
    """bank: proto, text, position. A short list, brought to the driver."""
    said = bank.select("proto", "position", T.join_report(F.array("text")).alias("report"))
    rows = said.select("proto", "position", F.transform(T.tokens(F.col("report")), lambda t: F.xxhash64(t)).alias("tokens"), F.size(F.filter(T.phrases(F.col("report")), T.is_verifiable)).alias("pieces"))
    return Statements((r["proto"], r["position"], r["tokens"], r["pieces"]) for r in rows.collect())


def case_table(bank: DataFrame, references: DataFrame, *, keep: list[str] | None = None, clinical: bool = True, threshold: float = V.ENTAILED_FROM) -> DataFrame:
    """A row for each case of references (case_id, references and the columns of keep): tokens of the first reference,
    statements (how many all references have), supported (proto, how many of its phrases they support), covers (for each
    of the references' statements the protos that support it). Without clinical the last three are empty.

    Phrases repeat over cases, so each is judged against the bank once and joined back."""
    tokens = references.select("case_id", *(keep or []), F.transform(T.tokens(metrics.first_reference(F.col("references"))), lambda t: F.xxhash64(t)).alias("tokens"))
    if not clinical:
        return materialize(tokens.select("*", F.lit(0).alias("statements"), F.expr("cast(array() as array<struct<proto:int,n:int>>)").alias("supported"), F.expr("cast(array() as array<array<int>>)").alias("covers")), "case_table")
    said = references.select("case_id", F.posexplode(T.phrases(metrics.joined_references(F.col("references")))).alias("seq", "phrase"))
    said = materialize(said.where(T.is_verifiable(F.col("phrase"))), "reference_phrases")
    pieces = bank.select(F.col("proto").cast("int").alias("proto"), F.explode(T.phrases(T.join_report(F.array("text")))).alias("phrase")).where(T.is_verifiable(F.col("phrase")))
    sides = materialize(entail.signed(said.select("phrase").distinct()), "reference_signs"), materialize(entail.signed(pieces.select("phrase").distinct()), "bank_signs")
    known, told = sides
    backed = entail.entailed_pairs(told, known, threshold).select(F.col("a").alias("piece"), F.col("b").alias("phrase"))
    backed = said.select("case_id", "phrase").join(backed, "phrase").select("case_id", "piece").distinct().join(pieces.withColumnRenamed("phrase", "piece"), "piece")
    backed = backed.groupBy("case_id", "proto").agg(F.count("*").cast("int").alias("n")).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("proto", "n"))).alias("supported"))
    covering = entail.entailed_pairs(known, told, threshold).select(F.col("a").alias("phrase"), F.col("b").alias("piece")).join(pieces.withColumnRenamed("phrase", "piece"), "piece")
    covering = covering.groupBy("phrase").agg(F.sort_array(F.collect_set("proto")).alias("protos"))
    covers = said.join(covering, "phrase", "left").groupBy("case_id").agg(F.count("*").cast("int").alias("statements"), F.collect_list("protos").alias("covers"))
    whole = tokens.join(backed, "case_id", "left").join(covers, "case_id", "left").fillna(0, ["statements"])
    return materialize(whole.select("case_id", *(keep or []), "tokens", "statements", *[F.coalesce(c, F.expr(f"cast(array() as {k})")).alias(c) for c, k in (("supported", "array<struct<proto:int,n:int>>"), ("covers", "array<array<int>>"))]), "case_table")


class _Laid:
    """Trials laid out as arrays: n-grams as differences from the first trial, tokens with their occurrence numbers."""

    def __init__(self, bank: Statements, trials: list[tuple[int, ...]]) -> None:
        counted = [bank.counts(t) for t in trials]
        base = counted[0] if trials else Counter()
        self.number: dict[Gram, int] = {g: i for i, g in enumerate(dict.fromkeys(g for c in counted for g in c))}
        order = lambda g: len(g) - 1
        self.base = np.array([base[g] for g in self.number], np.int64)
        self.order = np.array([order(g) for g in self.number], np.int64)
        changed = [(k, self.number[g], c[g], order(g)) for k, c in enumerate(counted) for g in {**base, **c} if c[g] != base[g]]
        self.trial, self.gram, self.count, self.gram_order = (np.array(x, np.int64) for x in zip(*changed, strict=True)) if changed else (np.zeros(0, np.int64) for _ in range(4))
        said = [bank.sequence(t) for t in trials]
        self.tokens = np.array([len(s) for s in said], np.int64)
        self.owner = np.repeat(np.arange(len(trials)), self.tokens)
        # the k-th occurrence of a token in a trial, as one number that a reference's k-th occurrence has too
        nth, seen = [], [Counter() for _ in trials]
        for k, s in enumerate(said):
            for t in s:
                nth.append((t, seen[k][t]))
                seen[k][t] += 1
        self.places = {x: i for i, x in enumerate(dict.fromkeys(nth))}
        self.place = np.array([self.places[x] for x in nth], np.int64)
        self.protos = sorted({p for t in trials for p in t})
        at = {p: i for i, p in enumerate(self.protos)}
        self.has = np.zeros((len(trials), len(self.protos)), bool)
        for k, t in enumerate(trials):
            self.has[k, [at[p] for p in t]] = True
        self.at = at
        self.pieces = self.has @ np.array([bank.pieces[p] for p in self.protos], np.int64)
        self.sentences = self.has.sum(1)
        self.size = len(trials)

    def scored(self, tokens: list[int], statements: int, supported: list[dict], covers: list[list[int]]) -> np.ndarray:
        """trials x SUMS of one case."""
        have = np.zeros(len(self.number), np.int64)
        for n in ORDERS:
            for g, c in Counter(zip(*(tokens[i:] for i in range(n)), strict=False)).items():
                if (i := self.number.get(g)) is not None:
                    have[i] = c
        out = np.zeros((self.size, len(SUMS)))
        column = {c: out[:, i] for i, c in enumerate(SUMS)}
        common = np.bincount(self.order, np.minimum(self.base, have), len(ORDERS))
        moved = np.minimum(self.count, have[self.gram]) - np.minimum(self.base[self.gram], have[self.gram])
        moved = np.bincount(self.trial * len(ORDERS) + self.gram_order, moved, self.size * len(ORDERS)).reshape(-1, len(ORDERS))
        for i, n in enumerate(ORDERS):
            column[f"n{n}"][:] = common[i] + moved[:, i]
            column[f"d{n}"][:] = np.maximum(1, self.tokens - n + 1)
        spot = np.full(len(self.places), -1, np.int64)
        seen: Counter[int] = Counter()
        for i, t in enumerate(tokens):
            if (k := self.places.get((t, seen[t]))) is not None:
                spot[k] = i
            seen[t] += 1
        found = spot[self.place]
        owner, found = self.owner[found >= 0], found[found >= 0]
        matches = np.bincount(owner, minlength=self.size)
        new = np.ones(len(found), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1] + 1)
        chunks = np.bincount(owner, new, self.size)
        some = np.maximum(matches, 1)
        precision, recall = matches / np.maximum(self.tokens, 1), matches / max(len(tokens), 1)
        mean = 10 * precision * recall / np.where(matches > 0, recall + 9 * precision, 1)
        column["meteor"][:] = np.where(matches > 0, mean * (1 - 0.5 * (chunks / some) ** 3), (self.tokens == 0) & (len(tokens) == 0))
        backed = np.zeros(len(self.protos), np.int64)
        for s in supported:
            if (i := self.at.get(s["proto"])) is not None:
                backed[i] = s["n"]
        column["logical_precision"][:] = (self.has @ backed) / np.maximum(self.pieces, 1)
        covered = np.zeros(self.size, np.int64)
        for protos in covers:
            own = [self.at[p] for p in protos if p in self.at]
            if own:
                covered += self.has[:, own].any(1)
        column["logical_recall"][:] = covered / max(statements, 1)
        column["cases"][:], column["hyp_len"][:], column["ref_len"][:], column["sentences"][:] = 1, self.tokens, len(tokens), self.sentences
        return out


def _summed(table: DataFrame, trials: int, of_case: Callable[[dict], np.ndarray], columns: list[str]) -> DataFrame:
    """Scores of each trial: of_case gives trials x SUMS of a case, a task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trials, len(SUMS)))
        for b in batches:
            for row in b.to_pylist():
                total += of_case(row)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(trials)), *(pa.array(total[:, i]) for i in range(len(SUMS)))], ["trial", *SUMS])

    parts = table.select(*columns).mapInArrow(run, "trial long, " + ", ".join(f"{c} double" for c in SUMS))
    sums = parts.groupBy("trial").agg(*[F.sum(c).alias(c) for c in SUMS])
    bleu = metrics.bleu_from_sums([F.col(f"n{n}") for n in ORDERS], [F.col(f"d{n}") for n in ORDERS], F.col("ref_len"), F.col("hyp_len"))
    means = {c: F.try_divide(c, "cases") for c in ("meteor", "logical_precision", "logical_recall")}
    out = sums.where("cases > 0").select("trial", F.col("cases").cast("long").alias("cases"), bleu.alias("bleu_4"), *[m.alias(c) for c, m in means.items()], F.try_divide("sentences", "cases").alias("mean_sentences"))
    out = out.withColumn("captioning", (F.col("bleu_4") + F.col("meteor")) / 2).withColumn("clinical", metrics.f1(F.col("logical_precision"), F.col("logical_recall")))
    return out.withColumn("final", metrics.final_score(F.col("clinical"), F.col("bleu_4"), F.col("meteor")))


CASE = ["tokens", "statements", "supported", "covers"]


def equal_cases(table: DataFrame, group: str | None = None) -> DataFrame:
    """A row for each distinct case of a case table, with its p if the table has it, and groups: name and n, how many equal
    cases each group has. They score alike, so they are scored once. Dealt to as many tasks as a shuffle has, however short
    the rows are, since scoring is what costs."""
    case = {c: F.col(c) for c in CASE}
    if "p" in table.columns:
        # maps can't be grouped by
        case["p"] = F.array_sort(F.map_entries("p"))
    counted = table.groupBy(*[v.alias(c) for c, v in case.items()], (F.col(group) if group else F.lit(None).cast("string")).alias("name")).agg(F.count("*").alias("n"))
    once = counted.groupBy(*case).agg(F.collect_list(F.struct("name", "n")).alias("groups"))
    return once.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def score_trials(table: DataFrame, bank: Statements, trials: list[Trial], group: str | None = None) -> DataFrame:
    """trial (place in the list), cases, bleu_4, meteor, captioning, logical_precision, logical_recall, clinical, final,
    mean_sentences: each trial's statements given to every case (of those of its groups). A trial of no case has no row."""
    laid = _Laid(bank, [bank.ordered(t.protos) for t in trials])

    # which trials count a case of each group that some trial names, and of any other
    counts = lambda name: np.array([t.without != name and (t.only is None or t.only == name) if name is not None else t.only is None for t in trials], np.int64)[:, None]
    counted = {name: counts(name) for name in {None, *(t.without for t in trials), *(t.only for t in trials)}}

    def of_case(row: dict) -> np.ndarray:
        times = sum(g["n"] * (counted.get(g["name"], counted[None]) if group else 1) for g in row["groups"])
        return laid.scored(*(row[c] for c in CASE)) * times

    return _summed(table if "groups" in table.columns else equal_cases(table, group), len(trials), of_case, [*CASE, "groups"])


#: Lists of probabilities whose selections a task holds laid out.
LAID_OUT = 256


class Decoding:
    """How probabilities become a selection: thresholds within floor and cap, then conflicts, as `select.threshold_select` and
    `select.resolve` have it. foes: pairs of protos."""

    def __init__(self, protos: list[int], least: int, most: int, foes: Iterable[tuple[int, int]] = ()) -> None:
        self.protos, self.least, self.most = sorted(protos), least, most
        self.foes: dict[int, list[int]] = {}
        for i, j in {tuple(sorted(x)) for x in foes if x[0] != x[1]}:
            self.foes.setdefault(i, []).append(j)

    def selections(self, p: np.ndarray, thresholds: np.ndarray) -> list[tuple[int, ...]]:
        """p: probability of each proto (NaN: none); thresholds: settings x protos (NaN: not part of the setting)."""
        p = p.astype(np.float32)
        margins = p[None, :] - thresholds.astype(np.float32)
        part = ~np.isnan(margins)
        order = np.argsort(np.where(part, -margins, np.inf), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
        passed = (margins >= 0).sum(1)
        chosen = (rank < np.where(passed >= self.least, np.minimum(passed, self.most), min(self.least, self.most))[:, None]) & part
        # settings mostly choose alike: conflicts are settled once for each choice
        found: dict[bytes, tuple[int, ...]] = {}
        return [found.get(key := row.tobytes()) or found.setdefault(key, self._settled(np.flatnonzero(row), p)) for row in chosen]

    def _settled(self, chosen: np.ndarray, p: np.ndarray) -> tuple[int, ...]:
        held = {self.protos[k]: p[k] for k in chosen}
        for a in list(held):
            for b in sorted(self.foes.get(a, ())):
                if a in held and b in held:
                    del held[b if held[a] >= held[b] else a]
        return tuple(held)


def with_probabilities(table: DataFrame, scores: DataFrame) -> DataFrame:
    """The case table with p (proto to probability). scores: case_id, proto, p."""
    held = scores.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("proto").cast("int").alias("proto"), F.col("p").cast("float").alias("p")))).alias("p"))
    return table.join(held, "case_id", "left")


def score_settings(table: DataFrame, bank: Statements, decoding: Decoding, settings: list[dict[int, float]]) -> DataFrame:
    """The columns of `score_trials`, a row for each setting (proto to threshold) of a table `with_probabilities`: all
    settings in one job. Settings mostly choose alike, so a case is scored once for each distinct selection; selections are laid
    out once for cases of the same probabilities."""
    thresholds = np.array([[s.get(p, np.nan) for p in decoding.protos] for s in settings], np.float64)

    known: dict[tuple, tuple[_Laid, list[int]]] = {}

    def laid_out(held: tuple) -> tuple[_Laid, list[int]]:
        """The distinct selections of a case's probabilities, and each setting's among them."""
        if held not in known:
            if len(known) >= LAID_OUT:
                known.clear()
            p = dict(held)
            chosen = decoding.selections(np.array([p.get(x, np.nan) for x in decoding.protos]), thresholds)
            distinct = {s: k for k, s in enumerate(dict.fromkeys(chosen))}
            known[held] = _Laid(bank, [bank.ordered(s) for s in distinct]), [distinct[s] for s in chosen]
        return known[held]

    def of_case(row: dict) -> np.ndarray:
        laid, at = laid_out(tuple((e["key"], e["value"]) for e in row["p"] or ()))
        return laid.scored(*(row[c] for c in CASE))[at] * sum(g["n"] for g in row["groups"])

    return _summed(table if "groups" in table.columns else equal_cases(table), len(settings), of_case, [*CASE, "p", "groups"])
