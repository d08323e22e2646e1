"""Vectors of floats as exact integer matrices inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components become integers below this size, so that float32 holds each exactly and float64 their products.
LARGEST = 1 << 24
#: Integers a unit.
SCALE = 256


def selected(df: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """The columns that are read, the vector as one of float or double."""
    kind = df.schema[vector].dataType.simpleString()
    values = F.col(f"`{vector}`") if kind in ("array<float>", "array<double>") else F.col(f"`{vector}`").cast("array<double>")
    return df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), values.alias("embedding"), *[F.col(f"`{c}`") for c in more])


def longest(rows: DataFrame) -> int:
    """Components of the longest vector that takes part, 0 for none."""
    amiss = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | ~(F.abs(F.floor(x.cast("double") * SCALE)) < LARGEST))
    return rows.where(~amiss).agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that take part, and floor(256 * component) of each in a row of dim, zeros after its end.

    Null vectors and those that hold a null or non-finite component take no part; neither do those with a component of
    65,536 or more either way, whose squares and products a long can't hold."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
    scaled = np.floor(values * SCALE)
    fits = np.abs(scaled) < LARGEST
    row = np.repeat(np.arange(len(lengths)), lengths)
    good = ~np.asarray(column.is_null()) & (np.bincount(row[~fits], minlength=len(lengths)) == 0)
    kept = np.flatnonzero(good)
    inside = good[row]
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(kept), dim), np.int64)
    out[(np.cumsum(good) - 1)[row[inside]], place[inside]] = scaled[inside].astype(np.int64)
    return kept, out
