"""Connected components of links held as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.written import discard, materialize


class Forest:
    """Union-find over small integers; the smallest member is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch's edges a spanning forest, each edge (node, root of its tree in the batch)."""
    for batch in batches:
        a, b = (np.asarray(batch.column(c)) for c in ("a", "b"))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        trees = Forest(len(nodes))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            trees.join(x, y)
        roots = np.fromiter((trees.root(i) for i in range(len(nodes))), np.int64, len(nodes))
        keep = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[roots[keep]])], ["a", "b"])


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (node, root), root the smallest node.

    Alternating large-star and small-star steps (public MapReduce algorithm). A step's groups are only aggregated by
    minimum, in part before the shuffle, and joined back; where a hub's rows make that join uneven, AQE splits them. Each
    round is written to the shared folder, the one before deleted. Rounds grow with the logarithm of the longest path.
    """
    pairs = materialize(edges.where("a <> b").select("a", "b").mapInArrow(_local_forest, "a long, b long"), tag)
    while True:
        # large star: every neighbour above the node is tied to the smallest neighbour (or the node itself)
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: node and its smaller neighbours are tied to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        ties = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = down.join(low, "a").select(F.explode(ties).alias("e")).select("e.*").where("a <> b").distinct()
        last, pairs = pairs, materialize(small, tag)
        discard(last)
        # each node hangs on one root, and no root hangs on another: done
        rows, nodes = pairs.agg(F.count("*"), F.countDistinct("a")).first()
        if rows == nodes and pairs.join(pairs.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
