"""Benchmark decontamination: a BM25 index of test items, queried by every passage of every document.

Scores are divided by the score that an item's own text gets, so they run from 0 to 1 and one threshold fits all
items. Retrieval is exact: block-max WAND returns every item at or above the threshold. A document's passages are
windows of words that overlap by half. Their length goes by the item's own: items are dealt into classes by `window_of`,
each of which is searched with windows of its own, at least twice as long as its items, so each item that a document
holds lies in one of them, and what is found of an item depends on no other item's length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, materialize, texts_of

K1, B = 1.2, 0.75
#: Share of its own score that an item must reach to be retrieved.
THRESHOLD = 0.6
#: Verification: share of the item's five-word shingles found near the passage, in all, and in question and answer each.
SHINGLE, IN_ALL, IN_EACH = 5, 0.75, 0.5
BLOCK = 16
LEAST_WINDOW = 128
#: Characters of items in one broadcast index; more items make more indexes, each a further pass over the documents.
INDEX_CHARS = 32_000_000

#: UTF-8 bytes of lower-case text to words: ASCII letters and digits and bytes from 128 stay, all else parts words.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_FOLD).split()


def window_of(words: int) -> int:
    """Words of a passage for items of so many words: LEAST_WINDOW doubled until it holds two of them."""
    window = LEAST_WINDOW
    while window < 2 * words:
        window *= 2
    return window


def shingles(words: list[bytes], n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """Runs of n words; with fewer, the whole as one; none of no words."""
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


#: Number of items with words, their mean length, and in how many each term stands.
Whole = tuple[int, float, dict[bytes, int]]


def _worded(items: list[tuple[int | None, str]]) -> list[tuple[int | None, list[bytes]]]:
    return [(i, w) for i, t in sorted(items, key=lambda x: (x[0] is not None, x[0] or 0, x[1])) if (w := words_of(t))]


def _counts_of(held: list[list[bytes]]) -> Whole:
    return len(held), float(np.mean([len(w) for w in held] or [1])), Counter(t for w in held for t in set(w))


class BlockMaxIndex:
    """Postings in item order with impacts (shares of the item's own score), cut into blocks with their maxima. The items
    should be of one class of `window_of`."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float = THRESHOLD, whole: Whole | None = None) -> None:
        """whole: counts over all items, of which these may be a part; left out, these are all."""
        held = _worded(items)
        self.ids = [i for i, _ in held]
        self.words = [w for _, w in held]
        self.threshold = threshold
        self.window = window_of(max((len(w) for w in self.words), default=0))
        counts = [Counter(w) for w in self.words]
        n, mean, df = whole or _counts_of(self.words)
        postings: dict[bytes, list[tuple[int, float]]] = {}
        #: Term to (item, impact) for a rare part of each item, and what of it a passage above the threshold must hold.
        self.rare: dict[bytes, list[tuple[int, float]]] = {}
        self.need: list[float] = []
        for d, c in enumerate(counts):
            size = sum(c.values())
            own = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for t, f in c.items()}
            total = sum(own.values())
            for t, v in own.items():
                postings.setdefault(t, []).append((d, float(v / total)))
            # a passage may miss 1 - threshold of the item at most, so it holds at least part - (1 - threshold) of any part
            part = 0.0
            for t in sorted(own, key=lambda t: (df[t], -len(t), t)):
                if part >= 1 - threshold + 0.3:
                    break
                self.rare.setdefault(t, []).append((d, float(own[t] / total)))
                part += own[t] / total
            self.need.append(part - (1 - threshold) - 1e-9)
        self.rare_words = frozenset(self.rare)
        self.items = {t: [d for d, _ in p] for t, p in postings.items()}
        self.impacts = {t: [v for _, v in p] for t, p in postings.items()}
        self.most = {t: max(v) for t, v in self.impacts.items()}
        #: Per term the last item and the largest impact of each block.
        self.blocks = {t: [(self.items[t][min(k + BLOCK, len(v)) - 1], max(v[k : k + BLOCK])) for k in range(0, len(v), BLOCK)] for t, v in self.impacts.items()}

    def may_hold(self, words: list[bytes]) -> frozenset[bytes]:
        """The rare terms among the words of items that they may reach the threshold for; lossless, mostly empty.

        What scores at the threshold or above holds its due of the item's rare part: the first bound of the search,
        taken over a whole document and then over each passage (no passage scores above the whole)."""
        found = self.rare_words.intersection(words)
        sums: dict[int, float] = {}
        for t in found:
            for d, v in self.rare[t]:
                sums[d] = sums.get(d, 0.0) + v
        good = {d for d, v in sums.items() if v >= self.need[d]}
        return frozenset(t for t in found if any(d in good for d, _ in self.rare[t])) if good else frozenset()

    def query(self, words: list[bytes]) -> list[tuple[int, float]]:
        """Every item whose score for the passage is at or above the threshold, by block-max WAND: (place, score)."""
        threshold = self.threshold - 1e-9
        # a cursor: [current item, term, place in its postings]
        cursors = [[self.items[t][0], t, 0] for t in set(words) if t in self.items]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.most[c[1]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            d = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == d:
                pivot += 1
            # block maxima of the terms up to the pivot, in the blocks where d would be
            shallow, last = 0.0, None
            for c in cursors[: pivot + 1]:
                blocks = self.blocks[c[1]]
                b = c[2] // BLOCK
                while b < len(blocks) and blocks[b][0] < d:
                    b += 1
                if b < len(blocks):
                    shallow += blocks[b][1]
                    last = blocks[b][0] if last is None else min(last, blocks[b][0])
            if shallow < threshold:
                # nothing until the first of these blocks ends, or the next cursor's item, can reach it
                target = (last if last is not None else d) + 1
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                moved = cursors[: pivot + 1]
                target = max(target, d + 1)
            elif cursors[0][0] == d:
                score = sum(self.impacts[c[1]][c[2]] for c in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((d, min(1.0, score)))
                moved, target = cursors[: pivot + 1], d + 1
            else:
                moved, target = [c for c in cursors[:pivot] if c[0] < d], d
            for c in moved:
                c[2] = bisect_left(self.items[c[1]], target, c[2])
                c[0] = self.items[c[1]][c[2]] if c[2] < len(self.items[c[1]]) else -1
            if any(c[0] < 0 for c in moved):
                cursors = [c for c in cursors if c[0] >= 0]
        return found

    def overlaps(self, d: int, words: list[bytes]) -> tuple[float, float, float]:
        """Shares of the item's shingles among those of the words: in all, in its question (first half), in its answer."""
        own, near = self.words[d], shingles(words)
        half = (len(own) + 1) // 2
        shares = []
        for part in (own, own[:half], own[half:]):
            has = shingles(part)
            # a part too short for a shingle is looked for as it is
            short = 0 < len(part) < SHINGLE
            hits = sum(any(tuple(words[k : k + len(part)]) == tuple(part) for k in range(len(words) - len(part) + 1)) for _ in range(1)) if short else len(has & near)
            shares.append(hits / len(has) if has else 1.0)
        return shares[0], shares[1], shares[2]

    def matches(self, words: list[bytes]) -> list[tuple[int, float, int, float, float, float]]:
        """Verified items of a text: (item, best score, that passage's first word, overlaps in all, question, answer)."""
        rare = self.may_hold(words)
        if not rare:
            return []
        best: dict[int, tuple] = {}
        step = self.window // 2
        for at in range(0, max(1, len(words) - step), step):
            passage = words[at : at + self.window]
            if rare.isdisjoint(passage) or not self.may_hold(passage):
                continue
            for d, score in self.query(passage):
                near = words[max(0, at - step) : at + self.window + step]
                every, question, answer = self.overlaps(d, near)
                if every >= IN_ALL and question >= IN_EACH and answer >= IN_EACH and (d not in best or score > best[d][1]):
                    best[d] = (self.ids[d], score, at, every, question, answer)
        return [best[d] for d in sorted(best)]


class ItemIndex:
    """Items of any length: an index for each class of `window_of`."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float = THRESHOLD, whole: Whole | None = None) -> None:
        classes: dict[int, list[tuple[int | None, str]]] = {}
        for i, t in items:
            if n := len(words_of(t)):
                classes.setdefault(window_of(n), []).append((i, t))
        whole = whole or _counts_of([w for _, w in _worded(items)])
        self.classes = [BlockMaxIndex(classes[w], threshold, whole) for w in sorted(classes)]

    def matches(self, text: str) -> list[tuple[int, float, int, float, float, float]]:
        """Verified items of a text, as `BlockMaxIndex.matches`."""
        words = words_of(text) if self.classes else []
        return [m for c in self.classes for m in c.matches(words)]


def indexes(items: DataFrame, *, item_text: str = "text", item_key: str = "item_id", threshold: float = THRESHOLD) -> Iterator[ItemIndex]:
    """Indexes of all items, each of INDEX_CHARS characters at most (or one item); one empty index if there are none.

    Numbers of items, lengths and term frequencies are always those of all items, and passages go by an item's own length,
    so results don't depend on how many indexes there are or what else is in one. Null ids are ids like any other, null texts are no items."""
    given = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    chars = given.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    whole = _term_counts(given) if chars > INDEX_CHARS else None
    group: list[tuple[int | None, str]] = []
    size = 0
    for r in given.orderBy("i", "t").toLocalIterator():
        if group and size + len(r["t"]) > INDEX_CHARS:
            yield ItemIndex(group, threshold, whole and whole(group))
            group, size = [], 0
        group.append((r["i"], r["t"]))
        size += len(r["t"])
    yield ItemIndex(group, threshold, whole and whole(group))


def _term_counts(given: DataFrame) -> Callable[[list[tuple[int | None, str]]], Whole]:
    """Counts over all items, kept in Spark; the function returned brings those of a group's terms, bounded as the group is."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [words_of(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in held], pa.int64()), pa.array([list(set(w)) for w in held], pa.list_(pa.binary()))], ["n", "terms"])

    found = materialize(arrow_map(given.select("t"), terms, "n long, terms array<binary>").where("n > 0"), "bm25_terms")
    n, mean = found.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(1.0))).first()
    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    def of(group: list[tuple[int | None, str]]) -> Whole:
        asked = given.sparkSession.createDataFrame([(t,) for t in {w for _, x in group for w in words_of(x)}], "term binary")
        return n, mean, {bytes(r["term"]): r["df"] for r in df.join(asked, "term", "left_semi").collect()}

    return of


def leaks(docs: DataFrame, items: DataFrame, *, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, score, passage, overlap, question_overlap,
    answer_overlap. A map over the documents, without a shuffle; the index is broadcast, its size bounded by INDEX_CHARS.

    Null or wordless texts on either side match nothing; repeated documents each give their rows, repeated items too;
    empty tables give no rows; further columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    schema = "doc_id long, item_id long, score double, passage int, overlap double, question_overlap double, answer_overlap double"
    out = None
    for index in indexes(items, **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            names = ["doc_id", "item_id", "score", "passage", "overlap", "question_overlap", "answer_overlap"]
            for batch in batches:
                found = [(name, *m) for name, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True) for m in shared.value.matches(t)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), types, strict=True)], names)

        one = arrow_map(rows, search, schema)
        out = one if out is None else out.union(one)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs, all columns, without the rows that hold a benchmark item; a filter in place, nothing is moved or joined.

    Null and wordless texts hold none and stay, repeated rows are judged alike; empty tables on either side take nothing out;
    further columns of any name go along."""
    for index in indexes(items, **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.matches(t) for t in texts_of(batch, text)], pa.bool_()))

        docs = arrow_map(docs, keep, docs.schema)
    return docs
