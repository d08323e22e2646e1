"""What the training-data operators share: written tables and components (of the library), Arrow maps, bit maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Forest, components  # noqa: F401
from ..sources.written import discard, drop, materialize, owned, settled, shared_dir  # noqa: F401

#: Rows of an Arrow batch sent to Python; long texts make larger batches needlessly big.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows, unless the session has a smaller bound already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bitmap_of(df: DataFrame, place: str, bits: int) -> np.ndarray:
    """Bits set at place (an SQL expression, its low bits count) of every row: uint64 words, 2**bits bits whatever the
    rows. A pre-filter that loses nothing; what passes it is still joined exactly."""
    words = (
        df.select(F.expr(f"({place}) & {(1 << bits) - 1}L").alias("p"))
        .groupBy(F.shiftrightunsigned("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
        .toArrow().to_pandas()
    )
    out = np.zeros(1 << max(bits - 6, 0), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the bit of each place (int64 or uint64) is set."""
    p = places.astype(np.int64).view(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
