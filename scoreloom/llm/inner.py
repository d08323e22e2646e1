"""Exact top-k inner products: vectors by descending length, partial sums after an SVD rotation, Cauchy-Schwarz bounds.

Vectors become integers and are written as a table in order of descending length, cut into blocks. They are searched in
levels of ever more blocks, the longest first. Before a level each query has the k-th best score so far; divided by the
query's length it is the least length of a vector that can still enter, and blocks whose longest vector is shorter are
left out for it. Queries are blocked by that least length, so what a block of vectors needs is a prefix of the query
blocks and only those meet. Where a block of queries meets a block of vectors, both are rotated so that the leading
coordinates hold most of the length: the partial sum over these plus the product of the residual lengths bounds the score
from above. Pairs whose bound reaches the threshold get a second, longer partial sum, and those left an exact product of
integers. Bounds are widened beyond rounding; thresholds let ties pass; so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import vectors
from .base import arrow_map, discard, materialize

#: Rows of a block of vectors or of queries at most, on average: bounds a task's memory.
BLOCK_ROWS = 32768
#: Vectors from which the rotation is fitted, on average. Any rotation gives exact results; this one gives good bounds.
FIT_ROWS = 8192
#: A level has so many times the blocks of all before it.
GROWTH = 8
#: Vectors that meet a block of queries at a time.
SLAB = 1024
#: Far more than float64 rounding of rotation and sums can add to a score, as a share of the lengths' product.
SLACK = 1e-9
#: An id that sorts after all others stands for null.
LAST = np.iinfo(np.int64).max


def _rotation(table: DataFrame, rows: int, dim: int) -> np.ndarray:
    """Singular vectors of a sample (each row by a hash of its number, FIT_ROWS on average), by falling share."""
    part = table.where(F.expr(f"pmod(xxhash64(row), {1 << 32}) < {min(1 << 32, (FIT_ROWS << 32) // max(rows, 1))}")).select("ints").toArrow()
    sample = np.frombuffer(b"".join(part.column("ints").to_pylist()), np.int32).reshape(-1, dim).astype(np.float64)
    return np.linalg.svd(sample.T @ sample)[0]


def _merged_parts(parts: list[tuple[float, int, int]], rows: int) -> dict[int, int]:
    """Numbers of the parts (order, name, rows), taken in order; neighbours share one until it has so many rows."""
    out, held, number = {}, 0, 0
    for _, name, n in sorted(parts):
        if held and held + n / 2 > rows:
            held, number = 0, number + 1
        out[name] = number
        held += n
    return out


class _Side:
    """Vectors of one side of a meeting, rotated: lengths, head and residuals after one and two cuts."""

    def __init__(self, ints: np.ndarray, turn: np.ndarray):
        self.ints, self.length = ints, np.sqrt((ints.astype(np.float64) ** 2).sum(1))
        rotated, dim = ints.astype(np.float64) @ turn, ints.shape[1]
        self.near, self.far = max(1, dim // 4), max(1, dim // 2)
        self.head, self.middle = rotated[:, : self.near], rotated[:, self.near : self.far]
        tail = np.cumsum((rotated**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = np.sqrt(tail[:, self.near]) if self.near < dim else np.zeros(len(ints))
        self.last = np.sqrt(tail[:, self.far]) if self.far < dim else np.zeros(len(ints))


def _merged(held: tuple[np.ndarray, ...], more: tuple[np.ndarray, ...], k: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The k best of both for each query, in order, and where the k-th of a query stands. Columns: query, row, id, score."""
    held = tuple(np.concatenate(x) for x in zip(held, more, strict=True))
    order = np.lexsort((held[1], held[2], -held[3], held[0]))
    held = tuple(x[order] for x in held)
    begins = np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    held, rank = tuple(x[rank < k] for x in held), rank[rank < k]
    return held, np.flatnonzero(rank == k - 1)


def best_of(q: np.ndarray, q_row: np.ndarray, floor: np.ndarray, floor_id: np.ndarray, v: np.ndarray, v_row: np.ndarray, v_id: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best vectors of each query among v (by score, then id, then row): places in q, rows, ids and scores of v.

    floor and floor_id have for each query a score, and an id at it, that k other vectors are known to reach (-inf: none
    known); a vector that has its query's row is the query itself."""
    order = np.argsort(-(v.astype(np.float64) ** 2).sum(1), kind="stable")
    V, v_row, v_id, out = _Side(v[order], turn), v_row[order], v_id[order], []
    floor, floor_id = floor.astype(np.float64), floor_id.copy()
    for begin in range(0, len(q), SLAB):
        Q = _Side(q[begin : begin + SLAB], turn)
        own, least, least_id = q_row[begin : begin + SLAB], floor[begin : begin + SLAB], floor_id[begin : begin + SLAB]
        held = tuple(np.zeros(0, np.int64) for _ in range(4))
        for at in range(0, len(v), SLAB):
            s = slice(at, at + SLAB)
            live = np.flatnonzero(Q.length * V.length[at] * (1 + SLACK) >= least)
            if not len(live):  # all that follow are shorter
                break
            bound = Q.head[live] @ V.head[s].T
            bound += np.multiply.outer(Q.rest[live], V.rest[s])
            bound += np.multiply.outer(Q.length[live] * SLACK, V.length[s])
            i, j = np.nonzero(bound >= least[live, None])
            if 16 * len(i) > bound.size:  # hardly pruned: a whole product costs less than its pairs
                exact = Q.length.max() * V.length[at] < 2**52  # sums of integers below 2**53 are exact in float64
                score = (Q.ints[live].astype(np.float64) @ V.ints[s].T.astype(np.float64)).astype(np.int64) if exact else Q.ints[live] @ V.ints[s].T
                if score.shape[1] > k + 1:  # one of these may be the query itself
                    top = np.partition(score, -(k + 1), axis=1)[:, -(k + 1)]
                    i, j = np.nonzero(score >= np.maximum(top, np.where(np.isfinite(least[live]), least[live], top))[:, None])
                else:
                    i, j = np.nonzero(score >= least[live, None])
                score, i, j = score[i, j], live[i], at + j
            else:
                i, j = live[i], at + j
                closer = np.einsum("nd,nd->n", Q.head[i], V.head[j]) + np.einsum("nd,nd->n", Q.middle[i], V.middle[j])
                closer += Q.last[i] * V.last[j] + Q.length[i] * V.length[j] * SLACK
                left = closer >= least[i]
                i, j = i[left], j[left]
                score = np.einsum("nd,nd->n", Q.ints[i], V.ints[j])
            even = (score == least[i]) & ((v_id[j] <= least_id[i]) | (np.abs(score) >= 2**53))  # beyond, float64 can't tell neighbours
            enters = (own[i] != v_row[j]) & ((score > least[i]) | even)
            i, j, score = i[enters], j[enters], score[enters]
            if len(i):
                held, kth = _merged(held, (i, v_row[j], v_id[j], score), k)
                better = kth[(held[3][kth] > least[held[0][kth]]) | (held[3][kth] == least[held[0][kth]]) & (held[2][kth] < least_id[held[0][kth]])]
                least[held[0][better]], least_id[held[0][better]] = held[3][better], held[2][better]
        out.append((held[0] + begin, *held[1:]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def _decoded(part: pa.Table, dim: int) -> tuple[np.ndarray, ...]:
    ints = np.frombuffer(b"".join(part.column("ints").to_pylist()), np.int32).reshape(-1, dim).astype(np.int64)
    return ints, part.column("row").to_numpy(), part.column("vec_id").fill_null(int(LAST)).to_numpy()


def top_products(df: DataFrame, *, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose key is divisible by every, the k rows of greatest inner
    product with it, all others being candidates (all of them if there are fewer); ties go to the smaller key, null last.

    Components x count as floor(256 x); vectors shorter than the longest as if zeros followed. Vectors that are null or
    hold a component that is null, not finite, or of 65,536 or more either way take no part. A null key is a candidate,
    never a query; repeated rows are rows like any other, each a candidate of the other and, if divisible, a query with
    rows of its own; an empty table gives no rows; columns of other names are not read."""
    spark = df.sparkSession
    rows = vectors.selected(df, key, vector)
    dim = max(vectors.longest(rows), 1)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, ints = vectors.integers(b.column("embedding"), dim)
            width = dim * 4
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(kept), [None, pa.py_buffer(np.ascontiguousarray(ints.astype(np.int32)))])
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(kept)), pa.array((ints**2).sum(1)), packed.cast(pa.binary())], ["vec_id", "square", "ints"])

    packed = materialize(arrow_map(rows, clean, "vec_id long, square long, ints binary").withColumn("row", F.monotonically_increasing_id()), "inner_rows")
    count = packed.count()
    blocks = max(1, -(-count // BLOCK_ROWS), min(-(-count // 2048), 4 * spark.sparkContext.defaultParallelism))
    # the row's number decides between equal lengths, so one length in a third of all rows is many blocks
    ranged = packed.repartitionByRange(blocks, F.col("square").desc(), F.xxhash64("row")).withColumn("block", F.spark_partition_id())
    table = materialize(ranged, "inner_blocks")
    discard(packed)
    turn = _rotation(table, count, dim)
    tops = table.groupBy("block").agg(F.max("square").alias("top"), F.count("*").alias("n")).collect()  # two numbers a block
    block_of = _merged_parts([(-r["top"], r["block"], r["n"]) for r in tops], -(-count // blocks))
    longest = np.sqrt([float(max(r["top"] for r in tops if block_of[r["block"]] == b)) for b in range(len(set(block_of.values())))])
    queries = table.where(F.col("vec_id") % every == 0).select("row", "vec_id", "square", "ints")
    def meet(q: pa.Table, v: pa.Table) -> pa.Table:
        place, *rest = (np.zeros(0, np.int64) for _ in range(4))
        q_row = place
        if q.num_rows and v.num_rows:
            (q_ints, q_row, _), (v_ints, v_row, v_id) = _decoded(q, dim), _decoded(v, dim)
            known = q.column("floor").combine_chunks()
            score, behind = (known.field(c).fill_null(0).to_numpy() for c in ("score", "behind"))
            place, *rest = best_of(q_ints, q_row, np.where(known.is_null(), -np.inf, score), ~behind, v_ints, v_row, v_id, turn, k)
        return pa.table([pa.array(q_row[place]), *map(pa.array, rest)], ["row", "v_row", "v_id", "score"])

    first = W.partitionBy("row").orderBy(F.col("score").desc(), "v_id", "v_row")
    best, done, found = None, 0, spark.createDataFrame([], "row long, v_row long, v_id long, score long")
    while done < len(longest):
        upto = min(len(longest), done + max(1, GROWTH * done))
        # a score that k others reach, and so the least length that matters
        asked = queries.withColumn("floor", F.lit(None).cast("struct<score:long,behind:long>"))
        if best is not None:
            asked = queries.join(best, "row", "left")
        needs = F.when(F.col("floor").isNull() | (F.col("floor.score") <= 0), F.lit(float("-inf"))).otherwise(F.col("floor.score") / F.sqrt("square") * (1 - SLACK))
        asked = asked.withColumn("needs", needs).where(F.col("needs") <= float(longest[done]))
        asks = asked.count()
        if not asks:
            break
        cores = spark.sparkContext.defaultParallelism
        lots = max(1, -(-asks // BLOCK_ROWS), min(-(-asks // 512), -(-cores // (upto - done))))
        asked = materialize(asked.repartitionByRange(lots, "needs", F.xxhash64("row")).withColumn("lot", F.spark_partition_id()), "inner_asked")
        least = asked.groupBy("lot").agg(F.min("needs").alias("needs"), F.count("*").alias("n")).collect()  # two numbers a block
        lot_of = _merged_parts([(r["needs"], r["lot"], r["n"]) for r in least], -(-asks // lots))
        # the blocks of this level that are long enough for a lot are its first ones, and the lots that need a block are the first ones too
        needed = [min(r["needs"] for r in least if lot_of[r["lot"]] == g) for g in range(len(set(lot_of.values())))]
        reach = [int(np.searchsorted(-longest[done:upto], -n, side="right")) for n in needed]
        lot_reach = spark.createDataFrame([(lot, g, reach[g]) for lot, g in lot_of.items()], "lot int, g int, blocks int")
        block_reach = spark.createDataFrame([(block, b - done, sum(n > b - done for n in reach)) for block, b in block_of.items() if done <= b < upto], "block int, b int, lots int")
        meets = lambda n, name: F.explode(F.expr(f"sequence(0, {n} - 1)")).alias(name)
        left = asked.join(lot_reach, "lot").where("blocks > 0").select("row", "vec_id", "ints", "floor", "g", meets("blocks", "b"))
        right = table.join(block_reach, "block").where("lots > 0").select("row", "vec_id", "ints", "b", meets("lots", "g"))

        fresh = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(meet, "row long, v_row long, v_id long, score long")
        merged = found.unionByName(fresh).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("rank")
        found = materialize(merged, "inner_found")
        discard(asked)
        best = found.groupBy("row").agg(F.min(F.struct("score", F.bitwise_not("v_id").alias("behind"))).alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
        done = upto
    ranked = found.withColumn("rank", F.row_number().over(first).cast("int"))
    own = queries.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"))
    return ranked.join(own, F.col("row") == F.col("q")).select("query_id", "rank", F.when(F.col("v_id") != int(LAST), F.col("v_id")).alias("vec_id"), "score")
