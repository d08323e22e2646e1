"""From candidate edges to exact components: families of candidates are verified where their sets lie together.

A family is a component of the candidates. A task reads one family at a time, or, if a family's sets together pass
FAMILY_TOKENS, one pair of its blocks, so no task holds an unbounded group and no pair is ever a row. Each pair of a
family that passes the filters of several token orders is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Forest, arrow_map, components, materialize, mix64

#: Hashes of one family (or of two blocks of it) that a task holds at a time: 8 bytes each.
FAMILY_TOKENS = 3_000_000
#: Token orders that candidates must agree in: by frequency in the family, and by two random permutations.
ORDERS = 3


def overlap_due(n, per_cent: int):
    """Least overlap of a set of n with any set at least so similar."""
    return -(-per_cent * n // 100)


#: Documents times shared tokens up to which a family is compared as a bit matrix; beyond it by postings.
DENSE = 64_000_000


def _prefixes(tokens: np.ndarray, starts: np.ndarray, rank: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one token order: tokens and owners of all documents' prefixes, n - due + 1 tokens of each."""
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((rank[tokens], owner))
    inside = np.arange(len(tokens)) - starts[owner] < (sizes - overlap_due(sizes, per_cent) + 1)[owner]
    return tokens[order][inside], owner[inside]


class _Bits:
    """Rows of shared tokens as bits: which earlier rows meet a row, and in how many tokens."""

    def __init__(self, docs: int, place: np.ndarray, tokens: np.ndarray, owner: np.ndarray) -> None:
        at = place[tokens]
        rows = np.zeros((docs, -(-int(place.max() + 1) // 64) * 64 or 64), bool)
        rows[owner[at >= 0], at[at >= 0]] = True
        self.rows = np.packbits(rows, axis=1).view(np.uint64)

    def partners(self, d: int) -> np.ndarray:
        return (self.rows[:d] & self.rows[d]).any(1)

    def common(self, d: int, found: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.rows[found] & self.rows[d]).sum(1, dtype=np.int64)


class _Postings:
    """The same by lists of each token's documents, for families of many documents with little in common."""

    def __init__(self, docs: int, distinct: int, tokens: np.ndarray, owner: np.ndarray) -> None:
        self.tokens = tokens
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=docs))])
        by = np.argsort(tokens, kind="stable")
        self.docs = owner[by]
        self.of = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=distinct))])
        self.mark = np.zeros(distinct, np.uint8)

    def partners(self, d: int) -> np.ndarray:
        out = np.zeros(d + 1, bool)
        for t in self.tokens[self.starts[d] : self.starts[d + 1]].tolist():
            at = self.docs[self.of[t] : self.of[t + 1]]
            out[at[at <= d]] = True
        return out[:d]

    def common(self, d: int, found: np.ndarray) -> np.ndarray:
        own = self.tokens[self.starts[d] : self.starts[d + 1]]
        self.mark[own] = 1
        sizes = self.starts[found + 1] - self.starts[found]
        at = np.repeat(self.starts[found] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        out = np.add.reduceat(self.mark[self.tokens[at]].astype(np.int64), np.cumsum(sizes) - sizes)
        self.mark[own] = 0
        return out


def verify(sets: list[np.ndarray], block: np.ndarray | None, per_cent: int, dense: int = DENSE) -> Iterator[tuple[int, np.ndarray]]:
    """For each set the earlier sets that it links to: 100 * |a and b| >= per_cent * |a or b|. No set is empty.

    block: with it, only pairs of different blocks count (those within a block are another task's)."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    values, tokens, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df > 1
    place = np.where(shared, np.cumsum(shared) - 1, -1)
    if not shared.any():
        return
    if len(sets) * int(shared.sum()) <= dense:
        make = lambda t, o: _Bits(len(sets), place, t, o)
    else:
        make = lambda t, o: _Postings(len(sets), len(values), t, o)
    orders = []
    for by in (np.lexsort((values, df)), np.argsort(values), np.argsort(mix64(values ^ np.uint64(0x1234567))))[:ORDERS]:
        rank = np.empty(len(values), np.int64)
        rank[by] = np.arange(len(values))
        orders.append(make(*_prefixes(tokens, starts, rank, per_cent)))
    whole = make(tokens, np.repeat(np.arange(len(sets)), sizes))
    for d in range(1, len(sets)):
        near = 100 * np.minimum(sizes[:d], sizes[d]) >= per_cent * np.maximum(sizes[:d], sizes[d])
        if block is not None:
            near &= block[:d] != block[d]
        for o in orders:
            if not near.any():
                break
            near &= o.partners(d)
        found = np.flatnonzero(near)
        if len(found):
            common = whole.common(d, found)
            linked = found[100 * common >= per_cent * (sizes[found] + sizes[d] - common)]
            if len(linked):
                yield d, linked


def link_families(sets: DataFrame, edges: DataFrame, per_cent: int, tag: str, family_tokens: int = FAMILY_TOKENS) -> DataFrame:
    """sets: cls long, copies long, tokens binary (sorted uint64), one row a class; edges: a, b between classes, such that
    linked classes are connected. Returns cls, root (least class of its exact component), links (copies of the classes
    that it links to); only classes with a link have a row."""
    found = components(edges, f"{tag}_candidates")
    family = found.select(F.col("node").alias("cls"), "root").union(found.select(F.col("root").alias("cls"), "root")).distinct()
    members = sets.join(family, "cls").withColumn("n", F.expr("cast(length(tokens) div 8 as long)"))
    members = materialize(members, f"{tag}_members")
    weights = members.groupBy("root").agg(F.ceil(F.sum("n") * 2 / family_tokens).cast("int").alias("blocks"))
    # two blocks fit a task; a family of up to two blocks is one
    weights = weights.withColumn("blocks", F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks")))
    dealt = members.join(weights, "root").withColumn("block", F.expr("cast(pmod(hash(cls, 17), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = dealt.select("root", "blocks", "low", "high", "block", "cls", "copies", "tokens")
    streams = dealt.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "cls")

    def solve(key: tuple, rows: list[tuple]) -> tuple[list, list, list, list]:
        root, blocks, low, high = key
        names = [r[0] for r in rows]
        got = [np.frombuffer(r[2], "<u8").astype(np.uint64) for r in rows]
        block = np.array([r[3] for r in rows]) if low != high else None
        trees, links = Forest(len(rows)), np.zeros(len(rows), np.int64)
        copies = np.array([r[1] for r in rows])
        for d, linked in verify(got, block, per_cent) if len(rows) > 1 else ():
            links[d] += copies[linked].sum()
            links[linked] += copies[d]
            for x in linked.tolist():
                trees.join(d, x)
        keep = [k for k in range(len(rows)) if links[k]]
        return [names[k] for k in keep], [names[trees.root(k)] for k in keep], [int(links[k]) for k in keep], [blocks > 1] * len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        pack = lambda got: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["cls", "root", "links", "split"])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "blocks", "low", "high", "cls", "copies", "tokens", "block")]
            for root, blocks, low, high, *row in zip(*columns, strict=True):
                if (root, blocks, low, high) != key:
                    if key:
                        yield pack(solve(key, rows))
                    key, rows = (root, blocks, low, high), []
                rows.append(tuple(row))
        if key:
            yield pack(solve(key, rows))

    solved = materialize(arrow_map(streams, run, "cls long, root long, links long, split boolean"), f"{tag}_solved")
    links = solved.groupBy("cls").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("split").alias("split"))
    whole = links.where("not split").select("cls", "root", "links")
    if weights.where("blocks > 1").isEmpty():
        return whole
    joined = components(solved.where("split").select(F.col("cls").alias("a"), F.col("root").alias("b")), f"{tag}_split")
    names = joined.union(joined.select(F.col("root").alias("node"), "root")).distinct()
    return whole.union(links.where("split").join(names, F.col("cls") == F.col("node")).select("cls", names["root"], "links"))
