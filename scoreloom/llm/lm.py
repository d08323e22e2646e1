"""Language-model scoring by cross-entropy difference: how much better a target model foretells a text than a background one.

Both models are interpolated word bigrams, counted over all documents (background) and over those of the target. Every
word and every pair of words is counted exactly, by a 64-bit hash, so what is counted grows with the corpus: documents are
packed into chunks of some CHUNK_WORDS words, a chunk's distinct words and pairs are sent by ranges of their keys, a task
sums a range and answers each chunk with the sums that it asked for. No table of counts is ever whole in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, bitmap_of, in_bitmap, materialize, mix64, texts_of
from .shingles import CHUNK, word_hashes

#: Words (one document's at least) that a task holds at a time; all of a chunk's documents are scored together.
CHUNK_WORDS = 1 << 19
#: Words of the corpus for each range of keys: bounds what a task sums at a time.
RANGE_WORDS = 1 << 21
#: Bits of the pre-filter for the target's keys (4 MB), whatever the input.
KEY_BITS = 25
#: Weight of the unigram model in a bigram's probability, as so many further words after each word.
PRIOR = 20.0
#: Stands before each text; never an outcome.
START = np.uint64(0x5354415254)

_CHUNKS = "chunk long, doc_ids array<long>, mine binary, sizes binary, hashes binary, words binary, n long, t long"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _pack(values: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes, so that small ones take little."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], n * 8, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<i8").astype(np.int64)


def _hashed(texts: list[list[str]]) -> np.ndarray:
    """The hash of each word of all texts."""
    out, held, size = [np.zeros(0, np.uint64)], [], 0
    for words in texts:
        for k in range(0, len(words), CHUNK // 8):
            held.append(" ".join(words[k : k + CHUNK // 8]).encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size > CHUNK:
                out.append(word_hashes(np.frombuffer(b"\n".join(held), np.uint8))[0])
                held, size = [], 0
    out.append(word_hashes(np.frombuffer(b"\n".join(held), np.uint8))[0])
    return np.concatenate(out)


def _word_keys(hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(mix64(first) * np.uint64(0x9E3779B97F4A7C15) + second) & ~np.uint64(1)


class _Chunk:
    """The words of a chunk's documents, START before each, and the chunk's distinct words and pairs, sorted by key."""

    def __init__(self, sizes: np.ndarray, hashes: np.ndarray, words: np.ndarray) -> None:
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.cumsum(sizes) - sizes
        full = np.insert(words, starts[sizes > 0], len(hashes))
        is_start = full == len(hashes)
        at = np.flatnonzero(~is_start)
        self.first, self.second = full[at - 1], words
        known = np.append(hashes, START)
        pairs, self.pair = np.unique(self.first << 32 | self.second, return_inverse=True)
        keys = np.concatenate([_word_keys(known), _pair_keys(known[pairs >> 32], known[pairs & 0xFFFFFFFF])])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.n_words = len(known)

    def counts(self, mine: np.ndarray) -> np.ndarray:
        """By key: of the words and pairs in all rows, in the target's, and the same of words as first of a pair."""
        own = mine[self.doc]
        rest = len(self.keys) - self.n_words
        out = np.zeros((4, len(self.keys)), np.int64)
        for row, of in ((0, slice(None)), (1, own)):
            out[row] = np.concatenate([np.bincount(self.second[of], minlength=self.n_words), np.bincount(self.pair[of], minlength=rest)])[self.order]
            out[row + 2] = np.concatenate([np.bincount(self.first[of], minlength=self.n_words), np.zeros(rest, np.int64)])[self.order]
        return out

    def losses(self, answers: np.ndarray, mine: np.ndarray, total: tuple[int, int], outcomes: int) -> list[np.ndarray]:
        """Of each document the sum of its words' losses in nats, under the target model (without the document's own counts
        where it is of the target) and under the background model without them. A model that has counted a text foretells
        it too well, so a text that a model has counted is scored by what the others alone say."""
        by = np.empty_like(answers)
        by[:, self.order] = answers
        sizes = np.bincount(self.doc, minlength=len(mine))
        own = [np.unique(self.doc << 32 | v, return_inverse=True, return_counts=True)[1:] for v in (self.second, self.pair, self.first)]
        own_second, own_pair, own_first = (c[at] for at, c in own)
        out = []
        for row, less in ((1, mine[self.doc]), (0, np.ones(len(self.doc), bool))):
            # every word counts once more than seen, so that none is impossible
            word = np.maximum(by[row, self.second] - less * own_second, 0) + 1
            p1 = word / (np.maximum(total[row] - less * sizes[self.doc], 0) + outcomes)
            pair = np.maximum(by[row, self.n_words + self.pair] - less * own_pair, 0)
            context = np.maximum(by[row + 2, self.first] - less * own_first, pair)
            out.append(np.bincount(self.doc, -np.log((pair + PRIOR * p1) / (context + PRIOR)), len(mine)))
        return out


def _read(row: dict) -> tuple[_Chunk, np.ndarray]:
    """Chunk of a row of the table of chunks, and which of its documents are of the target."""
    hashes = np.cumsum(_unpack(row["hashes"]).view(np.uint64), dtype=np.uint64)
    return _Chunk(_unpack(row["sizes"]), hashes, _unpack(row["words"])), _unpack(row["mine"]) > 0


def _chunks(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """Every row of docs in one chunk. Only texts that are likely of the target are moved, to the exact join with its keys."""
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("k"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keys = wanted.select(F.col(key).alias("w")).distinct()
    marks = spark.sparkContext.broadcast(bitmap_of(keys, "xxhash64(w)", KEY_BITS))

    def marked(batch: pa.RecordBatch) -> np.ndarray:
        return in_bitmap(marks.value, np.asarray(batch.column("place")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(batch))).drop_columns(["place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mine, texts, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            # a name for the chunk; the table is written, so it stays
            name = int.from_bytes(np.random.default_rng().bytes(8), "little", signed=True)
            hashes, words = np.unique(_hashed(texts), return_inverse=True)
            flags = np.array(mine, np.int64)
            sizes = np.array([len(t) for t in texts], np.int64)
            packed = [_pack(flags), _pack(sizes), _pack(np.diff(hashes, prepend=np.uint64(0)).view(np.int64)), _pack(words)]
            columns = [pa.array([name], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *(pa.array([p], pa.binary()) for p in packed)]
            columns += [pa.array([int(c)], pa.int64()) for c in (sizes.sum(), sizes[flags > 0].sum())]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "doc_ids", "mine", "sizes", "hashes", "words", "n", "t"])

        for batch in batches:
            if "place" in batch.schema.names:
                batch = batch.filter(pa.array(~marked(batch)))
                flags = [False] * len(batch)
            else:
                flags = batch.column("target").to_pylist()
            for name, flag, t in zip(batch.column("doc_id").to_pylist(), flags, texts_of(batch), strict=True):
                ids.append(name)
                mine.append(flag)
                texts.append(words_of(t))
                held += len(texts[-1])
                if held >= CHUNK_WORDS:
                    yield row()
                    ids, mine, texts, held = [], [], [], 0
        if ids:
            yield row()

    placed = own.withColumn("place", F.xxhash64("k"))
    likely = arrow_map(placed, near, own.schema).join(keys, F.col("k") == F.col("w"), "left")
    likely = likely.select("doc_id", "text", F.col("w").isNotNull().alias("target"))
    rest = arrow_map(placed.select("doc_id", "text", "place"), pack, _CHUNKS)
    return materialize(rest.union(arrow_map(likely, pack, _CHUNKS)), "lm_chunks")


def _answers(counted: DataFrame, asked: DataFrame | None, ranges: int) -> DataFrame:
    """chunk, range, counts: the sums over all counted chunks of each chunk's keys in a range, in their order. asked: chunks
    that only ask (those counted do not, then). Of each range one row more, of no chunk, has the number of its words."""

    def send(counts: bool, asks: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    chunk, mine = _read(row)
                    table = chunk.counts(mine) if counts else np.zeros((4, len(chunk.keys)), np.int64)
                    table[2:] -= table[:2] * (chunk.keys & np.uint64(1)).astype(np.int64)
                    at = ((chunk.keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                    found, begins = np.unique(at, return_index=True)
                    packed: list[list] = [[], [], []]
                    for k, a, b in zip(found.tolist(), begins.tolist(), [*begins[1:].tolist(), len(at)], strict=True):
                        packed[0].append(k)
                        packed[1].append(_pack(np.diff(chunk.keys[a:b], prepend=np.uint64(0)).view(np.int64)))
                        packed[2].append(_pack(table[:, a:b].reshape(-1)))
                    n = len(packed[0])
                    columns = [pa.array(packed[0], pa.int32()), pa.array([row["chunk"]] * n, pa.int64()), pa.array([asks] * n, pa.bool_()), pa.array(packed[1], pa.binary()), pa.array(packed[2], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["range", "chunk", "asks", "keys", "counts"])

        return run

    def solve(rows: list[tuple]) -> Iterator[tuple]:
        keys = [np.cumsum(_unpack(r[3]).view(np.uint64), dtype=np.uint64) for r in rows]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        word = (distinct & np.uint64(1)).astype(np.int64)
        sums = np.zeros((4, len(distinct)), np.int64)
        begins = np.cumsum([0, *(len(k) for k in keys)])
        for r, a, b in zip(rows, begins, begins[1:], strict=False):
            sums[:, at[a:b]] += _unpack(r[4]).reshape(4, -1)
        yield rows[0][0], None, None, int((sums[0] > 0) @ word)
        for r, a, b in zip(rows, begins, begins[1:], strict=False):
            if r[2]:
                yield r[0], r[1], _pack(sums[:, at[a:b]].reshape(-1)), None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for got in solve(rows):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(got, (pa.int32(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["range", "chunk", "counts", "words"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("range", "chunk", "asks", "keys", "counts")), strict=True):
                if held and held[0][0] != row[0]:
                    yield from out(held)
                    held = []
                held.append(row)
        if held:
            yield from out(held)

    schema = "range int, chunk long, asks boolean, keys binary, counts binary"
    sent = arrow_map(counted, send(True, asked is None), schema)
    if asked is not None:
        sent = sent.union(arrow_map(asked, send(False, True), schema))
    dealt = sent.repartition("range").sortWithinPartitions("range")
    return materialize(arrow_map(dealt, add, "range int, chunk long, counts binary, words long"), "lm_answers")


@dataclass
class Models:
    """The chunks of the documents that both models count, on disk."""

    docs: DataFrame
    wanted: DataFrame
    names: tuple[str, str]
    chunks: DataFrame

    def total(self) -> tuple[int, int]:
        """Words of all documents and of the target's."""
        r = self.chunks.agg(F.sum("n"), F.sum("t")).first()
        return r[0] or 0, r[1] or 0

    def ranges(self) -> int:
        return max(1, -(-self.total()[0] // RANGE_WORDS))

    @cached_property
    def _gathered(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for row in self.chunks.toLocalIterator():
            chunk, mine = _read(row.asDict())
            for k, c in zip(chunk.keys.tolist(), chunk.counts(mine).T, strict=True):
                sums[k] = sums.get(k, 0) + c
        texts = [words_of(r[0] or "") for r in self.docs.select(F.col(self.names[0]).cast("string")).toLocalIterator()]
        words = sorted({w for t in texts for w in t})
        found = [sums[k] for k in _word_keys(_hashed([words])).tolist()]
        unigram = np.array([[c[1], c[0]] for c in found]).reshape(-1, 2).T
        pairs = np.array([[c[1], c[0]] for k, c in sums.items() if not k & 1]).reshape(-1, 2).T
        return {w: k for k, w in enumerate(words)}, unigram, pairs

    # all counts (target, background) on the driver: to look into the models of a small corpus; scoring never reads them
    number = property(lambda self: self._gathered[0])
    unigram = property(lambda self: self._gathered[1])
    pairs = property(lambda self: self._gathered[2])


def fit(docs: DataFrame, wanted: DataFrame, *, text: str = "text", key: str = "doc_id") -> Models:
    """Background counts over all docs, target counts over those whose key is among wanted's."""
    return Models(docs, wanted, (text, key), _chunks(docs, wanted, text, key))


def score(docs: DataFrame, models: Models, wanted: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, in_target, loss_target, loss_background (nats per word) and difference (target less background:
    the lower, the more like the target). wanted: the target's keys, as given to fit.

    A null or wordless text has no words and 0 everywhere; repeated rows score alike; null keys are in no target; an
    empty table gives no rows; further columns are not read. A word that no model has counted is one outcome more.
    """
    same = (text, key) == models.names and docs.sameSemantics(models.docs) and wanted.sameSemantics(models.wanted)
    chunks = models.chunks if same else _chunks(docs, wanted, text, key)
    answers = _answers(models.chunks, None if same else chunks, models.ranges())
    total = models.total()
    outcomes = (answers.agg(F.sum("words")).first()[0] or 0) + 1
    names = ["doc_id", "n_words", "in_target", "loss_target", "loss_background"]

    def judge(row: dict, counts: list[bytes]) -> pa.RecordBatch:
        chunk, mine = _read(row)
        found = [_unpack(c).reshape(4, -1) for c in counts]
        sums = np.concatenate(found, axis=1)
        sums[2:] += sums[:2] * (chunk.keys & np.uint64(1)).astype(np.int64)
        sizes = _unpack(row["sizes"])
        target, background = (x / np.maximum(sizes, 1) for x in chunk.losses(sums, mine, total, outcomes))
        return pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(sizes), pa.array(mine), pa.array(target), pa.array(background)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, counts = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["range"] < 0:
                    if row:
                        yield judge(row, counts)
                    row, counts = r, []
                else:
                    counts.append(r["counts"])
        if row:
            yield judge(row, counts)

    both = chunks.drop("n", "t").withColumn("range", F.lit(-1)).unionByName(answers.where("chunk is not null").select("chunk", "range", "counts"), allowMissingColumns=True)
    streams = both.repartition("chunk").sortWithinPartitions("chunk", "range")
    judged = arrow_map(streams, run, "doc_id long, n_words long, in_target boolean, loss_target double, loss_background double")
    return judged.select(*names, (F.col("loss_target") - F.col("loss_background")).alias("difference"))
