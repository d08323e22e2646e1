"""Repair of conversation structure: the cheapest edits that give roles an order, found on a graph of tight arcs.

A conversation's rows are states of an automaton to walk: nothing yet, system, user, assistant. Keep, rerole and delete
lead past a row, insert stays before it. Minimum costs from the start (forward) and to the end (backward) tell for every
arc whether it lies on a cheapest walk; those arcs form a graph without cycles, on which a set of states takes the least
letter that leads on, step by step.

Texts never meet in one place. Rows are sorted by conversation and turn over ranges, so a long conversation is many
ranges; what the walk needs of a row is one letter, and the letters of a conversation become one text, as its audit does.
Only the hash of the repaired rows has to see them in order: rows stream through it one by one, headed by their audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, materialize

BLANK, DUPLICATE, TRUNCATED, SOUND = range(4)
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, system, user, assistant. Which role initial leads on from each, and to where.
ONWARD = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: The role that a rerole or an insert can have in each state.
ROLE = ("user", "user", "assistant", "user")
FAR = 1 << 60
#: Rows whose costs are held at a time; of longer conversations only every so many rows' costs are kept.
BLOCK = 4096
#: Letters for each pair of role initial (s, u, a, another or none) and fault.
LETTERS = "ABCDEFGHIJKLMNOP"


def letter_of(initial: Column, fault: Column) -> Column:
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) * 4 + fault
    return F.substring(F.lit(LETTERS), place + 1, F.lit(1))


def _known(letter: str) -> tuple[str, int]:
    k = LETTERS.index(letter)
    return "sua-"[k // 4], k % 4


def _arcs(letter: str) -> list[tuple[int, str, int, int]]:
    """Arcs past a row: from state, edit, to state, cost."""
    initial, fault = _known(letter)
    out = [(s, "D", s, DELETE) for s in range(4)]
    if fault in (SOUND, TRUNCATED):
        more = LEFT_TRUNCATED if fault == TRUNCATED else 0
        out += [(s, "K", to[initial], KEEP + more) for s, to in enumerate(ONWARD) if initial in to]
        out += [(s, "R", ONWARD[s][ROLE[s][0]], REROLE + more) for s in range(4)]
    return out


ARCS = {letter: _arcs(letter) for letter in LETTERS}
INSERTS = [(s, "I", ONWARD[s][ROLE[s][0]], INSERT) for s in range(4)]


def _relaxed(costs: list[int], back: bool) -> tuple[int, ...]:
    """Costs at a place once inserts are taken there; no cheapest walk has more than two in a place."""
    for _ in range(2):
        for s, _letter, to, cost in INSERTS:
            a, b = (to, s) if back else (s, to)
            costs[b] = min(costs[b], costs[a] + cost)
    return tuple(costs)


def _forward(at: tuple[int, ...], letters: str) -> list[tuple[int, ...]]:
    out = [at]
    for x in letters:
        costs = [FAR] * 4
        for s, _letter, to, cost in ARCS[x]:
            costs[to] = min(costs[to], out[-1][s] + cost)
        out.append(_relaxed(costs, back=False))
    return out


def _backward(at: tuple[int, ...], letters: str) -> list[tuple[int, ...]]:
    out = [at]
    for x in reversed(letters):
        costs = [FAR] * 4
        for s, _letter, to, cost in ARCS[x]:
            costs[s] = min(costs[s], out[-1][to] + cost)
        out.append(_relaxed(costs, back=True))
    return out[::-1]


def _walk(letters: str, fore: list[tuple[int, ...]], back: list[tuple[int, ...]], total: int, front: set[int], last: bool) -> tuple[str, set[int]]:
    """The least edits along tight arcs from a set of states before the first letter to those after all of them. (An edit
    leads from a state to one other, so the set that starts with one state stays one; inserts after the last letter are
    the next block's.)"""
    edits, states = [], {(0, s) for s in front}
    while not all(i == len(letters) and (not last or s in ENDS and fore[i][s] == total) for i, s in states):
        steps: dict[str, set[tuple[int, int]]] = {}
        for i, s in states:
            past = [(letter, (i + 1, to), cost) for a, letter, to, cost in ARCS[letters[i]] if a == s] if i < len(letters) else []
            stay = [(letter, (i, to), cost) for a, letter, to, cost in INSERTS if a == s and (i < len(letters) or last)]
            for letter, (j, to), cost in past + stay:
                if fore[i][s] + cost + back[j][to] == total:
                    steps.setdefault(letter, set()).add((j, to))
        least = min(steps)
        edits.append(least)
        states = steps[least]
    return "".join(edits), {s for _, s in states}


def cheapest_edits(letters: str) -> tuple[int, str]:
    """Cost and audit of a conversation. Conversations beyond BLOCK rows keep the costs of a row in every BLOCK and find
    those between again, block by block, so memory stays near a byte a row."""
    blocks = [letters[i : i + BLOCK] for i in range(0, max(len(letters), 1), BLOCK)]
    fore = [_relaxed([0, FAR, FAR, FAR], back=False)]
    back = [_relaxed([0 if s in ENDS else FAR for s in range(4)], back=True)]
    for b in blocks[:-1]:
        fore.append(_forward(fore[-1], b)[-1])
    for b in blocks[:0:-1]:
        back.append(_backward(back[-1], b)[0])
    back.reverse()
    total, edits, front = _backward(back[0], blocks[0])[0][0], [], {0}
    for k, b in enumerate(blocks):
        more, front = _walk(b, _forward(fore[k], b), _backward(back[k], b), total, front, k == len(blocks) - 1)
        edits.append(more)
    return total, "".join(edits)


_of_short = lru_cache(1 << 16)(cheapest_edits)


def _figures(letters: str) -> tuple[int, int, int, int, int, str]:
    """blank, duplicate, truncated, illegal, cost, audit."""
    faults = [sum(letters.count(LETTERS[4 * r + f]) for r in range(4)) for f in (BLANK, DUPLICATE, TRUNCATED)]
    initials = letters.translate({ord(x): _known(x)[0] for x in LETTERS})
    fine = sum(initials.count(p) for p in ("su", "ua", "au"))  # no two places of one pair overlap
    return (*faults, max(len(letters) - 1, 0) - fine, *(_of_short(letters) if len(letters) <= 64 else cheapest_edits(letters)))


def damaged(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, gone: rows after damage by crc32(conv:turn) % 20, of which 0 marks the row gone, 1 empties
    its text, 2 removes its [.!?], 3 repeats it, 4 sets role user. Null role and text, and null keys where they are hashed,
    are one space."""
    c, t = F.col(f"`{conv}`"), F.col(f"`{turn}`")
    space = lambda x: F.coalesce(x.cast("string"), F.lit(" "))
    said = space(F.col(f"`{text}`"))
    rows = df.select(c.alias("conv_id"), t.cast("long").alias("turn"), space(F.col(f"`{role}`")).alias("role"), said.alias("text"), (F.crc32(F.concat(space(c), F.lit(":"), space(t))) % 20).alias("kind"))
    kind = F.col("kind")
    rows = rows.withColumn("text", F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(kind == 4, "user").otherwise(F.col("role"))).withColumn("gone", kind == 0)
    return rows.withColumn("copy", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def repair_conversations(df: DataFrame, **columns: str) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged as `damaged` says and taken by turn, null turns first, then role, then text (equal rows are adjacent
    and alike). gaps = greatest - least turn + 1 - distinct turns, nulls left out, 0 without turns. A row's fault is blank
    (nothing but ASCII white space), duplicate (role and text seen earlier in the conversation) or truncated (last other
    character not . ! or ?), the first that holds; illegal counts adjacent role initials that are not su, ua or au. Edits
    (K, R, D, I) and their costs are the constants above; the audit is the least of the cheapest. A conversation whose rows
    are all gone has zeros, an empty audit and the hash of an empty text. The null conv_id is a conversation; repeated rows
    are rows like any other; an empty table gives no rows; columns of other names are not read.

    A long conversation's rows are spread over ranges for damage, faults and sorting. Two things are one value a
    conversation by their nature: the audit, a letter a row, and SHA-256, which is a chain; for the latter its rows stream
    through a task that holds one of them at a time."""
    rows = damaged(df, **columns).withColumn("twin", F.monotonically_increasing_id())
    # the start of a text and its hash order it, so that no long texts are sampled for the ranges; twins differ by a number
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64).alias("start"), F.xxhash64("text").alias("rest"), F.xxhash64("twin").alias("lot")]
    names = ["conv_id", "turn", "role", "start", "rest", "lot"]
    rows = rows.select("*", *order[3:]).repartitionByRange(*[F.col(c).asc_nulls_first() for c in names]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in names])
    bare = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    placed = rows.select(F.monotonically_increasing_id().alias("seq"), "conv_id", "turn", "role", "text", "gone", fault.alias("fault"), F.md5(F.concat("role", F.lit("\0"), "text")).alias("digest"))
    placed = materialize(placed, "repair_rows")
    there = placed.where("not gone")
    # the first row of each role and text: found by a sum over equal ones, marked by number, which no row shares
    firsts = there.groupBy("conv_id", "digest").agg(F.min("seq").alias("first"))
    seen = placed.select("seq", "conv_id", "role", "fault", "gone").join(firsts.select("first"), F.col("seq") == F.col("first"), "left")
    kind = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    letter = F.when(F.col("gone"), "").otherwise(letter_of(F.left("role", F.lit(1)), kind))
    lettered = seen.select("conv_id", F.shiftright("seq", 12).alias("piece"), F.struct("seq", letter.alias("x")).alias("at"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda r: r["x"]), "")
    pieces = lettered.groupBy("conv_id", "piece").agg(joined("at").alias("x"))  # 4,096 letters at most
    heads = pieces.groupBy("conv_id").agg(joined(F.struct("piece", "x")).alias("letters"))
    turns = there.groupBy(F.col("conv_id").alias("c")).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    heads = heads.join(turns, F.col("conv_id").eqNullSafe(F.col("c")), "left")

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_figures(x or "") for x in b.column("letters").to_pylist()]
            columns = [pa.array(list(c), pa.int64()) for c in zip(*(f[:5] for f in found), strict=True)] if found else [pa.array([], pa.int64())] * 5
            gaps = pa.array([g or 0 for g in b.column("gaps").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), gaps, *columns, pa.array([f[5] for f in found], pa.string())], FIGURES)

    kind = placed.schema["conv_id"].dataType.simpleString()
    figures = arrow_map(heads, audits, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in FIGURES[1:7]) + ", audit string")
    headed = figures.select(*FIGURES, F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    stream = headed.unionByName(there.select("conv_id", "seq", "role", "text"), allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seq")
    return arrow_map(stream, _hashed, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in FIGURES[1:7]) + ", audit string, repaired_sha256 string")


FIGURES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


class _Repaired:
    """Hashes a conversation's repaired rows as they come."""

    def __init__(self, head: tuple):
        self.head, self.sum, self.state, self.place, self.lines = head, hashlib.sha256(), 0, 0, 0

    def _line(self, role: str, text: str, to: int) -> None:
        self.sum.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
        self.lines, self.state = self.lines + 1, to

    def _inserts(self) -> None:
        audit = self.head[-1]
        while self.place < len(audit) and audit[self.place] == "I":
            self._line(ROLE[self.state], "", ONWARD[self.state][ROLE[self.state][0]])
            self.place += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.head[-1][self.place]
        self.place += 1
        if edit == "K":
            self._line(role, text, ONWARD[self.state][role[0]])
        elif edit == "R":
            self._line(ROLE[self.state], text, ONWARD[self.state][ROLE[self.state][0]])

    def end(self) -> tuple:
        self._inserts()
        return (*self.head, self.sum.hexdigest())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, now = [*FIGURES, "repaired_sha256"], None
    for b in batches:
        kinds = [b.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
        out, columns = [], [b.column(c).to_pylist() for c in (*FIGURES, "seq", "role", "text")]
        for *head, seq, role, text in zip(*columns, strict=True):
            if seq < 0:
                out += [now.end()] if now else []
                now = _Repaired(tuple(head))
            else:
                now.row(role, text)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)
    if now:
        last = now.end()
        yield pa.RecordBatch.from_arrays([pa.array([last[k]], kind) for k, kind in enumerate(kinds)], names)
