"""Language identification: nearest of several centroids per language, by cosine, with rejection by distance.

A text's vector counts its byte trigrams, folded to lower case, in DIMENSIONS hashed places; it is weighted by inverse
document frequency and normalised. Document frequencies are those of all training documents; the centroids are those
of spherical k-means within each language, fitted on a bounded sample.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import arrow_map, texts_of

DIMENSIONS = 4096
#: Training texts of a language that the centroids are fitted on, at most (document frequencies take all).
SAMPLE_PER_LANGUAGE = 600
CENTROIDS = 6
ROUNDS = 12
#: A text is rejected if its similarity is below this share of the one that all but LOW_SHARE of a centroid's own training
#: texts have. The fewer trigrams a text has, the lower its similarity is by chance: it is taken as if of FULL_TRIGRAMS.
REJECT_BELOW = 0.65
LOW_SHARE = 0.02
FULL_TRIGRAMS = 200
UNKNOWN = "und"

_A, _B, _C = (np.uint32(v) for v in (2654435761, 2246822519, 3266489917))  # public multiplicative hash constants
_SHIFT = np.uint32(32 - 12)
assert DIMENSIONS == 1 << 12


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the hashed byte trigrams of the whole text in lower case, one space around."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    places = (raw[:-2] * _A ^ raw[1:-1] * _B ^ raw[2:] * _C) * _A >> _SHIFT
    counts = np.bincount(places, minlength=DIMENSIONS)
    where = np.flatnonzero(counts)
    return where, counts[where].astype(np.float32)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # rows of unit length
    idf: np.ndarray
    floor: np.ndarray  # of each centroid: similarity below which a text is rejected

    def vector(self, text: str) -> tuple[np.ndarray, int]:
        where, counts = trigram_counts(text)
        v = np.zeros(DIMENSIONS, np.float32)
        v[where] = (1 + np.log(counts)) * self.idf[where]
        norm = float(np.linalg.norm(v))
        return v / norm if norm else v, len(where)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, similarity (0 to 1) and rejection of each text."""
        if not texts:
            return [], np.zeros(0), np.zeros(0, bool)
        vectors, lengths = zip(*(self.vector(t) for t in texts), strict=True)
        near = np.stack(vectors) @ self.centroids.T
        best = near.argmax(1)
        score = np.clip(near[np.arange(len(best)), best], 0, 1).astype(np.float64)
        return [self.languages[b] for b in best], score, as_full(score, np.array(lengths)) < self.floor[best]


def as_full(similarity: np.ndarray, trigrams: np.ndarray) -> np.ndarray:
    """Similarities as texts of FULL_TRIGRAMS different trigrams would have them; a tenth of those count for the shortest."""
    return similarity / np.sqrt(np.clip(trigrams / FULL_TRIGRAMS, 0.1, 1))


def cluster(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spherical k-means begun at far-apart rows (each the least similar to those before); empty clusters go.

    Returns unit centroids, each row's own one and its similarity to that."""
    chosen = [0]
    near = vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        far = int(near.argmin())
        if near[far] > 0.999:
            break
        chosen.append(far)
        near = np.maximum(near, vectors @ vectors[far])
    centroids = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(1)
        sums = np.stack([vectors[own == j].sum(0) for j in range(len(centroids)) if (own == j).any()])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    near = vectors @ centroids.T
    return centroids, near.argmax(1), near.max(1)


def held_out(key: Column) -> Column:
    """Documents that no model may learn from: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(training: DataFrame, *, sample: int = SAMPLE_PER_LANGUAGE, k: int = CENTROIDS) -> Model | None:
    """training: text, lang, turn (a hash that orders the sample), without nulls. None if there is nothing to learn from."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for t in texts_of(batch):
                df[trigram_counts(t)[0]] += 1
                n += 1
        where = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*where.tolist(), -1], pa.int32()), pa.array([*df[where].tolist(), n], pa.int64())], ["place", "n"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [trigram_counts(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("turn"), pa.array([w.astype("<u2").tobytes() for w, _ in got], pa.binary()), pa.array([c.astype("<f4").tobytes() for _, c in got], pa.binary())], ["lang", "turn", "where", "counts"])

    # at most DIMENSIONS + 1 rows, summed where they are made and again on the way
    counted = arrow_map(training.select("text"), frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    if counted.empty or not (n := int(counted.loc[counted["place"] == -1, "n"].sum())):
        return None
    idf = np.zeros(DIMENSIONS, np.float32)
    seen = counted[counted["place"] >= 0]
    idf[:] = np.log(1 + n)
    idf[seen["place"].to_numpy()] = np.log((1 + n) / (1 + seen["n"].to_numpy(np.float64)))
    idf += 0.05  # what every text has still counts a little
    # a threshold on the hash (uniform over 0 .. 2**32) thins each language to about twice the sample before its texts are
    # moved or sorted; one job for all languages
    sizes = {r["lang"]: r["n"] for r in training.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    bound = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int(min(1.0, 2 * sample / size + 20 / size) * 2**32))) for lang, size in sizes.items()])
    thinned = training.where(F.col("turn") <= bound).withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("turn", "text")))
    rows = arrow_map(thinned.where(F.col("nth") <= sample).select("text", "lang", "turn"), vectors, "lang string, turn long, where binary, counts binary").collect()
    languages, centroids, floors = [], [], []
    for lang in sorted(sizes):
        own = sorted((r["turn"], bytes(r["where"]), bytes(r["counts"])) for r in rows if r["lang"] == lang)
        made = np.zeros((len(own), DIMENSIONS), np.float32)
        for v, (_, where, counts) in zip(made, own, strict=True):
            at = np.frombuffer(where, "<u2")
            v[at] = (1 + np.log(np.frombuffer(counts, "<f4"))) * idf[at]
        norms = np.linalg.norm(made, axis=1)
        made = made[norms > 0] / norms[norms > 0, None]
        if not len(made):
            continue
        found, which, near = cluster(made, k)
        full = as_full(near, (made > 0).sum(1))
        languages += [lang] * len(found)
        centroids.append(found)
        # a centroid of few texts is held to all of its language
        floors += [float(np.quantile(full[which == j] if (which == j).sum() >= 1 / LOW_SHARE else full, LOW_SHARE)) * REJECT_BELOW for j in range(len(found))]
    return Model(languages, np.concatenate(centroids), idf, np.array(floors)) if languages else None


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs' doc_id, held_out, lang_pred, score and rejected.

    A null text, or one without any letter, is `und` with score 0 and rejected; so is every text if nothing could be
    learned. An empty text has no letter. Repeated keys and rows are judged each by itself; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                given = batch.column("text").to_pylist()
                known = [t for t in given if t is not None] if m else []
                found = iter(zip(*m.predict(known), strict=True)) if known else iter(())
                got = [next(found) if m and t is not None else (UNKNOWN, 0.0, True) for t in given]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got]), pa.array([float(g[1]) for g in got]), pa.array([bool(g[2]) for g in got])], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return arrow_map(rows, judge, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def training_rows(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """What may be learned from: text and lang of rows that are not held out, in an order that the key's hash gives."""
    turn = F.xxhash64(F.col(key)).bitwiseAND(F.lit((1 << 32) - 1))
    return docs.where(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), turn.alias("turn"))


def keep_identified(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose language is rejected; a filter in place, nothing is moved or joined.

    Null, empty and letterless texts go; so does every row if nothing could be learned. Repeated rows are judged alike, an
    empty table stays empty, further columns of any name go along."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mark = f"letters_{uuid.uuid4().hex}"
    marked = docs.withColumn(mark, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                lettered = np.array(batch.column(mark).to_pylist(), bool)
                good = lettered & (m is not None)
                if good.any():
                    texts = batch.column(text).filter(pa.array(good)).to_pylist()
                    good[good] = ~m.predict(texts)[2]
                yield batch.filter(pa.array(good)).drop_columns([mark])

    return arrow_map(marked, keep, docs.schema)
