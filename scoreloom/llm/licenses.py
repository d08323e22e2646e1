"""License scans: an Aho-Corasick automaton finds phrases and identifier tags, a shunting-yard parser reads expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import arrow_map, texts_of

#: Phrases (words in lower case, a space between) and the labels that they stand for.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICE_PHRASES = {
    "apache license": "apache-2.0",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl-2.0",
    "eclipse public license": "epl",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "unlicense": "unlicense",
}
TAG = "spdx license identifier"
#: How far a licence binds: 0 free, 1 weak copyleft, 2 strong copyleft, 3 use restricted, 4 nothing granted.
BINDING = {
    "mit": 0, "apache-2.0": 0, "bsd": 0, "isc": 0, "cc0": 0, "public-domain": 0, "unlicense": 0, "cc-by": 0,
    "mpl-2.0": 1, "lgpl": 1, "epl": 1, "gpl": 2, "agpl": 2, "cc-by-sa": 2,
    "cc-by-nc": 3, "cc-by-nd": 3, "cc-by-nc-sa": 3, "cc-by-nc-nd": 3, "reserved": 4,
}
UNKNOWN_BINDING = 3

#: UTF-8 bytes to words: A-Z to lower case; digits, a-z and bytes from 128 stay; all else parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_ORDER = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Terms:
    """What an expression comes to: the licences named, and how far its mildest permitted reading binds."""

    labels: frozenset[str]
    binding: int


def _identifier(name: str) -> Terms:
    key = name.lower().rstrip("+")
    for suffix in ("-or-later", "-only"):
        key = key.removesuffix(suffix)
    family = next((f for f in sorted(BINDING, key=len, reverse=True) if key == f or re.fullmatch(re.escape(f) + r"[-.0-9a-z]*[0-9][-.0-9a-z]*", key)), None)
    return Terms(frozenset([family or key]), BINDING.get(family or key, UNKNOWN_BINDING))


def parse_expression(text: str) -> tuple[Terms | None, int]:
    """Evaluates a licence expression by shunting-yard: the longest sound beginning's terms, and its length in tokens.

    OR leaves the choice (the milder binds), AND adds up (the stricter binds), WITH takes an exception, which makes
    strong copyleft weak. WITH binds tighter than AND, AND than OR. None where no sound expression begins.
    """
    best: tuple[Terms | None, int] = None, 0
    values: list[Terms] = []
    stack: list[str] = []
    wants_value, exception = True, False

    def apply(values: list[Terms], op: str) -> None:
        b, a = values.pop(), values.pop()
        if op == "with":
            values.append(Terms(a.labels, 1 if a.binding == 2 else a.binding))
        else:
            values.append(Terms(a.labels | b.labels, min(a.binding, b.binding) if op == "or" else max(a.binding, b.binding)))

    for n, token in enumerate(_TOKEN.findall(text), 1):
        word = token.lower()
        if word in _ORDER:
            if wants_value:
                break
            while stack and stack[-1] != "(" and _ORDER[stack[-1]] >= _ORDER[word]:
                apply(values, stack.pop())
            stack.append(word)
            wants_value, exception = True, word == "with"
        elif token == "(":
            if not wants_value or exception:
                break
            stack.append(token)
        elif token == ")":
            if wants_value or "(" not in stack:
                break
            while stack[-1] != "(":
                apply(values, stack.pop())
            stack.pop()
        else:
            if not wants_value:
                break
            values.append(Terms(frozenset(), 0) if exception else _identifier(token))
            wants_value = exception = False
        if not wants_value and "(" not in stack:
            trial, left = values.copy(), stack.copy()
            while left:
                apply(trial, left.pop())
            best = trial[-1], n
    return best


def automaton(phrases: dict[str, str]):
    """Of ' phrase ' with its label and length in words; found in text of words with single spaces around each."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in phrases.items():
        found.add_word(f" {phrase} ", (phrase, label, len(phrase) + 2))
    found.make_automaton()
    return found


@dataclass
class Scan:
    n_words: int
    base: list[int]  # starts of base phrases, in words
    base_labels: set[str]
    notices: list[tuple[int, str, str]]  # start in words, phrase, label
    expressions: list[tuple[str, Terms]]

    @property
    def labels(self) -> set[str]:
        return self.base_labels | {label for _, _, label in self.notices} | {x for _, t in self.expressions for x in t.labels}

    @property
    def score(self) -> float:
        """Confidence that the text states a licence: a parsed tag 1, a notice 0.9, a base phrase alone 0.6, else 0."""
        return 1.0 if self.expressions else 0.9 if self.notices else 0.6 if self.base else 0.0

    @property
    def binding(self) -> int | None:
        """The strictest of what the text states."""
        stated = [t.binding for _, t in self.expressions] + [BINDING.get(x, UNKNOWN_BINDING) for x in self.base_labels | {n[2] for n in self.notices}]
        return max(stated, default=None)


def scan_text(text: str, phrases) -> Scan:
    words = text.encode().translate(_FOLD).split()
    base, base_labels, notices, expressions = [], set(), [], []
    tagged = False
    if words:
        joined = f" {b' '.join(words).decode()} "
        hits = [(end + 1 - length[2], *length[:2]) for end, length in phrases.iter(joined)]
        if hits:
            # the k-th space of joined stands before word k
            spaces = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), "<u4") == 32)
            starts = np.searchsorted(spaces, [h[0] for h in hits]).tolist()
            for at, (_, phrase, label) in zip(starts, hits, strict=True):
                if phrase == TAG:
                    tagged = True
                elif phrase in BASE_PHRASES:
                    base.append(at)
                    base_labels.add(label)
                else:
                    notices.append((at, phrase, label))
    if tagged:
        for m in _EXPRESSION.finditer(text):
            terms, _ = parse_expression(m[1])
            if terms:
                expressions.append((m[1].strip(), terms))
    return Scan(len(words), base, base_labels, notices, expressions)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, binding int, expressions array<string>, notices array<struct<word: long, phrase: string, label: string>>"


def scan_licenses(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: words, places of base phrases, labels, score, how far it binds, expressions, notices.

    A null text counts as empty: no words, empty label lists, score 0, null places. Keys go along, null or repeated;
    an empty table gives no rows; further columns are not read. Every phrase's every place counts, overlaps too.
    """
    phrases = BASE_PHRASES | NOTICE_PHRASES | {TAG: ""}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(phrases)
        types = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("binding", pa.int32()), ("expressions", pa.list_(pa.string())), ("notices", pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string()), ("label", pa.string())])))])
        for batch in batches:
            rows = []
            for name, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                s = scan_text(t, found)
                rows.append((name, s.n_words, len(s.base), min(s.base, default=None), max(s.base, default=None), ",".join(sorted(s.base_labels)), ",".join(sorted(s.labels)), s.score, s.binding, [e for e, _ in s.expressions], [{"word": a, "phrase": b, "label": c} for a, b, c in s.notices]))
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    return arrow_map(docs.selectExpr(f"cast({key} as long) as doc_id", f"cast({text} as string) as text"), scan, SCHEMA)
