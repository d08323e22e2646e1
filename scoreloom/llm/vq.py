"""Product codes of vectors: exact nearest entries by float32 products with error intervals, decided in int64.

Squared distances to all entries of a codebook rank as |c|^2 - 2 v.c does. A float32 matrix product gives that value for
every vector and entry, and an interval that surely holds the exact one. Entries whose interval meets the best one's are
measured again in int64; the least distance wins, equal ones by the lower index. So codes never depend on how a
processor rounds or orders sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .base import arrow_map, materialize

#: Half the distance of neighbouring float32 numbers at 1.
UNIT = 2.0**-24
#: Vectors that are screened at a time: bounds a task's matrices.
SCREEN_ROWS = 4096


def nearest(block: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of block (int64, all below vectors.LARGEST) the index of the nearest entry and its squared distance.

    With m components and u = UNIT, a float32 inner product of exact inputs errs by g |v||c| at most, g = m u / (1 - m u),
    in whatever order it is summed (Cauchy-Schwarz on the sum of |v_i c_i|); rounding |c|^2 adds u |c|^2, and the last
    subtraction u times its result, which is at most |c|^2 + 2 |v||c| but for these errors. Twice the sum of all covers
    the rounding of the bound itself."""
    m = block.shape[1]
    v, c = block.astype(np.float32), entries.astype(np.float32)
    norms = (entries * entries).sum(1)
    score = norms.astype(np.float32) - np.float32(2) * (v @ c.T)
    g = m * UNIT / (1 - m * UNIT)
    lengths, sizes = np.sqrt((block.astype(np.float64) ** 2).sum(1)), np.sqrt(norms.astype(np.float64))
    error = np.multiply.outer(2 * lengths, 2 * (g + UNIT) * sizes) + 4 * UNIT * norms.astype(np.float64)
    low, high = score - error, score + error
    row, entry = np.nonzero(low <= high.min(1, keepdims=True))  # in order of row, then entry
    exact = ((block[row] - entries[entry]) ** 2).sum(1)
    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(exact, begins) if len(row) else exact
    hit = np.flatnonzero(exact == least[row])
    first = hit[np.unique(row[hit], return_index=True)[1]]
    return entry[first], exact[first]


def _assigned(ints: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, a column a part. books: parts x entries x components."""
    parts, _, m = books.shape
    codes, errors = np.zeros((len(ints), parts), np.int64), np.zeros((len(ints), parts), np.int64)
    for at in range(0, len(ints), SCREEN_ROWS):
        for p in range(parts):
            rows = slice(at, at + SCREEN_ROWS)
            codes[rows, p], errors[rows, p] = nearest(ints[rows, p * m : (p + 1) * m], books[p])
    return codes, errors


def _first_books(rows: DataFrame, dim: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the smallest keys, keys and then components ascending; null keys come last."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, ints = vectors.integers(b.column("embedding"), dim)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * dim, pa.int32()), pa.array(ints.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(kept)), flat], ["vec_id", "ints"])

    ranked = arrow_map(rows.select("vec_id", "embedding"), clean, "vec_id long, ints array<long>").orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries)
    found = sorted(materialize(ranked, "vq_first").collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["ints"]))
    return np.array([r["ints"] for r in found], np.int64).reshape(len(found), parts, dim // parts).transpose(1, 0, 2)


def _moved_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries replaced by the floor of the mean of the parts nearest to them. A task adds up its own rows, so
    what is shuffled is parts x entries rows a task, whatever the vectors."""
    parts, entries, m = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, m), np.int64)
        for b in batches:
            _, ints = vectors.integers(b.column("embedding"), parts * m)
            codes, _ = _assigned(ints, books)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(total[p], codes[:, p], ints[:, p * m : (p + 1) * m])
        p, e = np.nonzero(count)
        columns = [pa.array(p), pa.array(e), pa.array(count[p, e]), *[pa.array(total[p, e, j]) for j in range(m)]]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *[f"s{j}" for j in range(m)]])

    names = ["n", *[f"s{j}" for j in range(m)]]
    partial = arrow_map(rows.select("embedding"), sums, "part long, entry long, " + ", ".join(f"{c} long" for c in names))
    out = books.copy()
    for r in partial.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names]).collect():  # parts x entries rows
        out[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(m)]
    return out


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def fit(rows: DataFrame, *, parts: int, entries: int, rounds: int, dim: int) -> np.ndarray:
    """Codebooks (parts x entries x components) after so many rounds over all vectors."""
    books = _first_books(rows, dim, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        books = _moved_books(rows, books)
    return books


def encode(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Product codes of all vectors: vec_id, code, error, label_error, codebooks_sha256, a row for each vector kept.

    Vectors are cut into equal consecutive parts, those shorter than the longest, or than a multiple of parts, as if
    zeros followed. Each part position has a codebook of so many entries (256 at most), at first the parts of the vectors
    of the smallest keys (fewer if there are fewer vectors), then moved in rounds as `fit` does. code has two hex digits a
    part; error sums the squared distances of a vector's parts to their entries; label_error sums errors over equal
    labels, null being one.

    Rows go whose vector is null or holds a component that is null, not finite, or of 65,536 or more either way. Null
    keys sort last and are kept; repeated rows are rows like any other; an empty table, or one without a vector to keep,
    gives no rows; columns of other names are not read."""
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name up to 256 entries")
    rows = vectors.selected(df, key, vector, label).withColumnRenamed(label, "label")
    dim = -(-max(vectors.longest(rows), 1) // parts) * parts
    books = fit(rows, parts=parts, entries=entries, rounds=rounds, dim=dim)
    digits = np.array([f"{k:02x}" for k in range(256)])

    def codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, ints = vectors.integers(b.column("embedding"), dim)
            if len(kept):
                codes, errors = _assigned(ints, books)
                at = pa.array(kept)
                columns = [b.column("vec_id").take(at), b.column("label").take(at), pa.array(["".join(x) for x in digits[codes]]), pa.array(errors.sum(1))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    coded = materialize(arrow_map(rows, codes_of, f"vec_id long, label {kind}, code string, error long"), "vq_codes")
    # the sums are a written table, so Spark knows its size when it chooses how to join; a hot label's rows stay split
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "vq_labels").withColumnRenamed("label", "l")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
