"""Substring dedup by paragraphs: MinHash banding finds candidates, exact Jaccard verifies, components are removed but one.

Passages of at least MIN_WORDS words that do not keep to lines are found by winnowed windows of half as many words: a run
that stands in two places has a window in common, whatever stands around it (see `repeated_passages`).

A paragraph is a line of at least MIN_WORDS words; its set is its five-word shingles. Paragraphs of equal sets are one
class. BANDS bands of ROWS rows are tuned for recall: a pair of similarity 0.75 shares a band with probability
1 - (1 - 0.75**4)**16 = 0.998, one of 0.8 with 0.9998; what shares a band is verified exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .base import arrow_map, bitmap_of, discard, in_bitmap, materialize, mix64, settled, texts_of
from .families import link_families
from .shingles import CHUNK, WORDS, digest, shingle_sets, word_hashes

MIN_WORDS = 50
PER_CENT = 75
BANDS, ROWS = 16, 4
CLASS_BITS = 26

_FACTORS = mix64(np.arange(31, 31 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix64(np.arange(9031, 9031 + BANDS * ROWS, dtype=np.uint64))
#: A window that stands in more than one of so many places is hot.
HOT_SHARES = 1000
#: Shingles whose permutations are computed in one go.
_CHUNK = 1 << 17


def paragraphs_of(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, str]]:
    """Place of the first and after the last character, and the line, of each paragraph."""
    out, at = [], 0
    for line in text.split("\n"):
        # a line of n words has n - 1 spaces between at least
        if len(line) >= 2 * min_words - 1 and len(line.encode().split()) >= min_words:
            out.append((at, at + len(line), line))
        at += len(line) + 1
    return out


def _line_hashes(lines: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines)).view(np.int64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of each set's (not empty) every band, that of the band's number in it."""
    out = np.empty((len(sets), BANDS), np.uint64)
    a = 0
    while a < len(sets):
        b, size = a, 0
        while b < len(sets) and (b == a or size + len(sets[b]) <= _CHUNK):
            size += len(sets[b])
            b += 1
        flat = np.concatenate(sets[a:b])
        starts = np.cumsum([0, *(len(s) for s in sets[a:b])])[:-1]
        for band in range(BANDS):
            key = np.full(b - a, band + 1, np.uint64)
            for r in range(band * ROWS, (band + 1) * ROWS):
                low = np.minimum.reduceat((flat * _FACTORS[r] + _SHIFTS[r]) >> np.uint64(24), starts)
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + low)
            out[a:b, band] = key
        a = b
    return out


def repeated_lines(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, per_cent: int = PER_CENT, tag: str = "paragraphs", family_tokens: int | None = None) -> DataFrame:
    """One row per place of a line of min_words words that stands, exactly or nearly, in more than one place: doc_id,
    text_hash (of the whole text), begin and end (characters), n_words, cluster (names the component), places (of the
    cluster), keep (true for its first place by doc_id, text_hash and begin, which stays; the others are to be removed).

    Null texts have no paragraphs. Null keys come first among places. Rows that repeat key and text are one document, whose
    places come once; equal keys with different texts are told apart by text_hash. An empty table gives no rows, very long
    paragraphs are compared whole, further columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 100):
                batch = whole.slice(k, 100)
                found = [(n, *p) for n, t in enumerate(texts_of(batch)) for p in paragraphs_of(t, min_words)]
                if not found:
                    continue
                owner, begins, ends, lines = zip(*found, strict=True)
                coded = [x.encode() for x in lines]
                hashed = list(shingle_sets(coded))
                keys = band_keys([h for _, h in hashed]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (len(found) + 1), BANDS), pa.int32()), pa.array(keys.reshape(-1)))
                numbers = [pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array([n for n, _ in hashed], pa.int32()), pa.array([digest(h) for _, h in hashed], pa.int64()), pa.array(_line_hashes(coded))]
                at = pa.array(owner, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_hash").take(at), *numbers, lists], ["doc_id", "text_hash", "begin", "end", "n_words", "cls", "line", "bands"])

    places = materialize(arrow_map(rows, find, "doc_id long, text_hash long, begin int, end int, n_words int, cls long, line long, bands array<long>"), f"{tag}_places")
    classes = places.groupBy("cls").agg(F.count("*").alias("copies"), F.min("line").alias("line"), F.first("bands").alias("bands"))
    classes = materialize(classes, f"{tag}_classes")
    banded = classes.select("cls", F.explode("bands").alias("band"))
    lead = banded.groupBy("band").agg(F.min("cls").alias("b"), F.max("cls").alias("high")).where("b <> high").select("band", "b")
    edges = materialize(banded.join(lead, "band").where("cls <> b").select(F.col("cls").alias("a"), "b").distinct(), f"{tag}_edges")
    wanted = edges.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    # of each class one line is fetched, known by the hash of its bytes, so that no other line's shingles are made
    fetched = classes.join(wanted, "cls", "left_semi").select("cls", "copies", "line")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(fetched, "line", CLASS_BITS))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            lines = [p[2].encode() for t in texts_of(batch) for p in paragraphs_of(t, min_words)]
            names = _line_hashes(lines)
            # a copy that this task has sent need not go again; the list only spares work, so it may be forgotten
            new = {n: x for n, x, yes in zip(names.tolist(), lines, in_bitmap(shared.value, names), strict=True) if yes and n not in seen}
            if len(seen) > 500_000:
                seen.clear()
            seen.update(new)
            hashes = [h for _, h in shingle_sets(list(new.values()))]
            yield pa.RecordBatch.from_arrays([pa.array([digest(h) for h in hashes], pa.int64()), pa.array([h.astype("<u8").tobytes() for h in hashes], pa.binary())], ["cls", "tokens"])

    sets = arrow_map(rows.select("text"), fetch, "cls long, tokens binary").groupBy("cls").agg(F.first("tokens").alias("tokens"))
    sets = sets.join(fetched.select("cls", "copies"), "cls")
    linked = link_families(sets.select("cls", "copies", "tokens"), edges, per_cent, tag, **({"family_tokens": family_tokens} if family_tokens else {}))
    labels = linked.select(F.col("cls").alias("c"), "root")
    named = places.drop("bands", "line").join(labels, F.col("cls") == F.col("c"), "left").withColumn("cluster", F.coalesce("root", "cls")).drop("c", "root", "cls")
    named = materialize(named.dropDuplicates(["doc_id", "text_hash", "begin"]), f"{tag}_named")
    # the first place of a cluster by an aggregate, not a window, so that a cluster of very many places is no one task's
    place = F.struct("doc_id", "text_hash", "begin")
    first = named.groupBy("cluster").agg(F.count("*").alias("places"), F.min(place).alias("first")).where("places > 1").withColumnRenamed("cluster", "k")
    out = named.join(first, F.col("cluster") == F.col("k"))
    return out.select("doc_id", "text_hash", "begin", "end", "n_words", "cluster", "places", place.eqNullSafe(F.col("first")).alias("keep"))


#: Base of the rolling hash over words, and its inverse modulo 2**64 (an odd number has one).
_BASE = int(mix64(np.array([7001], np.uint64))[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Windows:
    """Words of some texts laid end to end and their winnowed windows of `size` words, each the least by hash of `width`
    neighbours that lie in one text. What is chosen in a stretch of text depends on its words alone."""

    def __init__(self, texts: list[str], size: int, width: int) -> None:
        coded = [t.encode() for t in texts]
        raw = np.frombuffer(b"\n".join(coded), np.uint8)
        self.size, self.width = size, width
        self.words, starts, ends = word_hashes(np.frombuffer(raw.tobytes().lower(), np.uint8))
        # characters before each byte; only differences within a text are asked for
        chars = np.cumsum((raw & 0xC0) != 0x80)
        self.begins, self.ends = chars[starts] - 1, chars[ends - 1]
        offsets = np.cumsum([0, *(len(t) + 1 for t in coded)])
        self.bounds = np.searchsorted(starts, offsets)
        self.zero = np.concatenate([chars, [0]])[np.minimum(offsets[:-1], len(raw))] - 1
        owner = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.zero[np.diff(self.bounds) == 0] = 0
        n = len(self.words)
        reach = size + width - 1
        self.at = np.zeros(0, np.int64)
        if n >= reach:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * _powers(_BASE, n), dtype=np.uint64)])
            hashes = mix64((sums[size:] - sums[:-size]) * _powers(_INVERSE, n - size + 1))
            # the window's place in the low bits, so that the least hash names it and of equals the first is taken
            low = np.uint64(n.bit_length())
            least = (hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64)
            span = 1
            while 2 * span <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < width:
                least = np.minimum(least[: -(width - span)], least[width - span :])
            inside = owner[: n - reach + 1] == owner[reach - 1 :]
            chosen = (least[inside] & np.uint64((1 << int(low)) - 1)).astype(np.int64)
            self.at = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])] if len(chosen) else chosen
            self.hashes = hashes[self.at].view(np.int64)
        else:
            self.hashes = np.zeros(0, np.int64)
        self.owner = owner[self.at]

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window: its first word in its text, first and last character."""
        zero = self.zero[self.owner]
        return self.at - self.bounds[self.owner], self.begins[self.at] - zero, self.ends[self.at + self.size - 1] - zero

    def around(self, chosen: np.ndarray, side: int) -> tuple[pa.Array, pa.Array]:
        """Of the chosen windows the words next to them, nearest first and as many as `width` in the text, by the low half
        of their hashes, and how many characters further the text goes with each."""
        a = self.at[chosen]
        steps = np.arange(1, self.width + 1)
        if side == 0:
            words = a[:, None] - steps
            held = words >= self.bounds[self.owner[chosen]][:, None]
            far = self.begins[a][:, None] - self.begins[np.where(held, words, 0)]
        else:
            last = a + self.size - 1
            words = last[:, None] + steps
            held = words < self.bounds[self.owner[chosen] + 1][:, None]
            far = self.ends[np.where(held, words, 0)] - self.ends[last][:, None]
        ends = pa.py_buffer(np.concatenate([[0], np.cumsum(held.sum(1)) * 4]).astype(np.int32))
        return tuple(pa.BinaryArray.from_buffers(pa.binary(), len(a), [None, ends, pa.py_buffer(np.ascontiguousarray(v[held]))]) for v in (self.words.astype("<u4")[np.where(held, words, 0)], far.astype("<i4")))


def _windows_of(batch: pa.RecordBatch, size: int, width: int) -> Iterator[tuple[int, _Windows]]:
    """The windows of a batch's texts, some CHUNK bytes of text at a time, with the row that they begin at."""
    texts = texts_of(batch)
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= CHUNK):
            held += len(texts[end])
            end += 1
        yield at, _Windows(texts[at:end], size, width)
        at = end


def _agreement(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (hash, side, uid, pos, near, far) in order of hash, side, near: of each place, how many words the neighbours agree
    that agree furthest (the next in order do), and how many characters that is. Equal places (of equal rows) are one."""
    names = ["uid", "pos", "side", "more", "chars"]
    held: pa.RecordBatch | None = None
    most = 0

    def out(rows: pa.RecordBatch, more: np.ndarray) -> pa.RecordBatch:
        found = np.flatnonzero(more)
        at = np.frombuffer(rows.column("far").buffers()[1], np.int32)[rows.column("far").offset :][found] // 4 + more[found] - 1
        chars = np.frombuffer(rows.column("far").buffers()[2] or b"", "<i4")[at]
        some = rows.take(pa.array(found))
        return pa.RecordBatch.from_arrays([some.column("uid"), some.column("pos"), some.column("side"), pa.array(more[found], pa.int32()), pa.array(chars, pa.int32())], names)

    for batch in batches:
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        h, side, uid, pos = (np.asarray(rows.column(c)) for c in ("hash", "side", "uid", "pos"))
        group = (h[1:] == h[:-1]) & (side[1:] == side[:-1])
        twin = group & (uid[1:] == uid[:-1]) & (pos[1:] == pos[:-1])
        if twin.any():
            rows = rows.filter(pa.array(np.concatenate([[True], ~twin])))
            h, side = np.asarray(rows.column("hash")), np.asarray(rows.column("side"))
            group = (h[1:] == h[:-1]) & (side[1:] == side[:-1])
        near = rows.column("near")
        ends = np.frombuffer(near.buffers()[1], np.int32)[near.offset : near.offset + len(rows) + 1] // 4
        words = np.frombuffer(near.buffers()[2] or b"", "<u4")
        size = np.diff(ends)
        inside = np.arange(width) < size[:, None]
        laid = np.zeros(inside.shape, np.uint32)
        laid[inside] = words[ends[0] : ends[-1]]
        same = (laid[1:] == laid[:-1]) & inside[1:] & inside[:-1] & group[:, None]
        agree = np.logical_and.accumulate(same, 1).sum(1)
        before = np.concatenate([[most if held is not None else 0], agree])
        more = np.maximum(before, np.concatenate([agree, [0]]))
        if len(rows) > 1:
            yield out(rows.slice(0, len(rows) - 1), more[:-1])
        held, most = rows.slice(len(rows) - 1), int(before[-1])
    if held is not None:
        yield out(held, np.array([most]))


def repeated_passages(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, tag: str = "passages") -> DataFrame:
    """Runs of min_words words or more that stand elsewhere too, word for word but for white space and A-Z: the columns of
    `repeated_paragraphs`. A run is made of windows that repeat, each at most a word from the next, and goes on at both ends
    as far as any other place of its outer window agrees. It is cut where the first places of its windows change, so that a
    cluster is a stretch of the text that has it first (kept) and its copies; parts of a long run may be short.

    Null texts and an empty table give no rows; null keys come first; rows that repeat key and text are one document; equal
    keys with different texts are told apart; very long texts are read whole, in pieces; further columns are not read."""
    size = min_words // 2
    width = min_words - size + 1
    uid = F.xxhash64(F.col(key), F.col(text))
    rows = docs.select(uid.alias("uid"), F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text")).where("text is not null")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, w in _windows_of(batch, size, width):
                if len(w.at):
                    owner = pa.array(w.owner + at)
                    pos, cb, ce = (pa.array(v.astype(np.int32)) for v in w.places())
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(owner) for c in ("uid", "doc_id", "text_hash")), pos, cb, ce, pa.array(w.hashes)], ["uid", "doc_id", "text_hash", "pos", "cb", "ce", "hash"])

    windows = materialize(arrow_map(rows, find, "uid long, doc_id long, text_hash long, pos int, cb int, ce int, hash long"), f"{tag}_windows")
    place = F.struct("doc_id", "uid", "pos")
    counted = windows.groupBy("hash").agg(F.min(place).alias("f"), F.max(place).alias("last"), F.count("*").alias("n")).where("f <> last")
    first = materialize(counted.select("hash", F.col("f.uid").alias("fuid"), F.col("f.pos").alias("fpos"), "n"), f"{tag}_first")
    # a window in more than a share of all places would be one task's; there are fewer of those than shares, so they go to all
    hot = F.broadcast(first.where(F.col("n") * HOT_SHARES > windows.count()).drop("n"))
    cold = windows.join(hot.select("hash"), "hash", "left_anti").join(first.drop("n"), "hash")
    found = windows.join(hot, "hash").unionByName(cold).dropDuplicates(["uid", "pos"])
    text_order = Window.partitionBy("uid").orderBy("pos")
    step, after = F.col("pos") - F.lag("pos").over(text_order), F.lead("pos").over(text_order) - F.col("pos")
    found = found.withColumn("left", F.coalesce(step > width, F.lit(True))).withColumn("right", F.coalesce(after > width, F.lit(True)))
    turns = F.col("left") | (F.lag("fuid").over(text_order) != F.col("fuid")) | (F.col("fpos") - F.lag("fpos").over(text_order) != step)
    found = found.withColumn("turn", turns).withColumn("run", F.sum(F.col("left").cast("int")).over(text_order)).withColumn("piece", F.sum(F.col("turn").cast("int")).over(text_order)).drop("turn")
    found = materialize(found, f"{tag}_found")
    marks = docs.sparkSession.sparkContext.broadcast([bitmap_of(found.where(side), "hash", CLASS_BITS) for side in ("left", "right")])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, w in _windows_of(batch, size, width):
                for side in (0, 1):
                    chosen = np.flatnonzero(in_bitmap(marks.value[side], w.hashes))
                    if len(chosen):
                        near, far = w.around(chosen, side)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(w.hashes[chosen]), pa.array(np.full(len(chosen), side, np.int32)), batch.column("uid").take(pa.array(w.owner[chosen] + at)), pa.array(w.places()[0][chosen].astype(np.int32)), near, far],
                            ["hash", "side", "uid", "pos", "near", "far"],
                        )

    sent = arrow_map(rows.select("uid", "text"), around, "hash long, side int, uid long, pos int, near binary, far binary")
    # places of one window whose next words differ agree no further, so the next word parts those of a window that many have
    streams = sent.repartition("hash", "side", F.substring("near", 1, 4)).sortWithinPartitions("hash", "side", "near", "uid", "pos")
    more = arrow_map(streams, lambda batches: _agreement(batches, width), "uid long, pos int, side int, more int, chars int")
    both = more.groupBy("uid", "pos").agg(*(F.max(F.expr(f"if(side = {k}, {c}, 0)")).alias(f"{c[0]}{k}") for k in (0, 1) for c in ("more", "chars")))
    told = found.join(both, ["uid", "pos"], "left").fillna(0, ["m0", "c0", "m1", "c1"])
    told = told.withColumn("a", F.expr("pos - if(left, m0, 0)")).withColumn("b", F.expr(f"pos + {size} + if(right, m1, 0)"))
    told = told.withColumn("begin", F.expr("cb - if(left, c0, 0)")).withColumn("end", F.expr("ce + if(right, c1, 0)"))
    pieces = told.groupBy("uid", "run", "piece").agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("a").alias("a"), F.max("b").alias("b"), F.min(F.struct("pos", "fuid", "fpos")).alias("f"))
    pieces = materialize(pieces, f"{tag}_pieces")
    whole = pieces.groupBy("uid", "run").agg((F.max("b") - F.min("a") >= min_words).alias("long"))
    source = found.select(F.col("uid").alias("fuid"), F.col("pos").alias("fpos"), F.xxhash64("uid", "piece").alias("cluster"))
    keep = (F.col("uid") == F.col("f.fuid")) & (F.col("f.pos") == F.col("f.fpos"))
    named = pieces.join(whole, ["uid", "run"]).withColumn("keep", keep).withColumn("fuid", F.col("f.fuid")).withColumn("fpos", F.col("f.fpos")).join(source, ["fuid", "fpos"])
    clusters = named.groupBy("cluster").agg(F.count("*").alias("places"), F.max("long").alias("long")).where("long and places > 1").drop("long")
    return named.drop("long").join(clusters, "cluster").select("doc_id", "text_hash", "begin", "end", (F.col("b") - F.col("a")).alias("n_words"), "cluster", "places", "keep")


def repeated_paragraphs(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, per_cent: int = PER_CENT, tag: str = "paragraphs", family_tokens: int | None = None) -> DataFrame:
    """The rows of `repeated_lines`, and those of `repeated_passages` of which WORDS words or more stand outside them. Rows of
    one text may overlap; places counts a cluster's rows here.

    One place of each passage stays, chosen once the lines are known: the first (by doc_id, text_hash, begin) of those that lie
    in a line that is kept, else of those that no line to be removed touches, else of those that one touches in part. What
    is kept is never cut by what is not (see `without_repeats`), so a passage of the first two kinds stands whole in what is
    left. The kept place of a passage has no row of its own where it lies in a line that is kept.

    Null texts have no paragraphs, an empty table gives no rows, further columns are not read, very long texts are compared
    whole. Rows that repeat key and text are one document, whose places come once; equal keys with different texts are told
    apart by text_hash."""
    lines = settled(lambda: repeated_lines(docs, text=text, key=key, min_words=min_words, per_cent=per_cent, tag=tag, family_tokens=family_tokens), f"{tag}_lines")
    passages = settled(lambda: repeated_passages(docs, text=text, key=key, min_words=min_words), f"{tag}_passages")
    return lines.unionByName(_beside_lines(passages, lines).select(*lines.columns))


def _beside_lines(passages: DataFrame, lines: DataFrame) -> DataFrame:
    """The passages' rows that stand beside the lines', with the places that stay."""
    held = lines.select(F.col("doc_id").alias("k"), F.col("text_hash").alias("h"), F.col("begin").alias("lb"), F.col("end").alias("le"), F.col("keep").alias("stays"))
    meet = F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")) & (F.col("lb") < F.col("end")) & (F.col("le") > F.col("begin"))
    shared = F.least("end", "le") - F.greatest("begin", "lb")
    part = lambda stays: F.sum(F.when(F.col("stays") == stays, shared).otherwise(0))
    own = passages.drop("keep", "places").join(held, meet, "left").groupBy("doc_id", "text_hash", "begin", "end", "n_words", "cluster").agg(part(True).alias("kept"), part(False).alias("removed"))
    chars = F.col("end") - F.col("begin")
    beside = lambda within: (chars - within) * F.col("n_words") >= WORDS * chars
    kind = F.when((F.col("removed") == 0) & ~beside(F.col("kept")), 0).when(F.col("removed") == 0, 1).when(beside(F.col("removed")), 2).otherwise(3)
    own = materialize(own.withColumn("place", F.struct(kind.alias("kind"), "doc_id", "text_hash", "begin")), "passages_placed")
    discard(passages)
    # the place that stays, by an aggregate, so that a cluster of very many places is no one task's
    stays = own.groupBy("cluster").agg(F.min("place").alias("stays"))
    rest = own.where(beside(F.col("kept") + F.col("removed")))
    counts = rest.groupBy("cluster").agg(F.count("*").alias("places"))
    chosen = stays.join(counts, "cluster").select(F.col("cluster").alias("c"), "stays", "places")
    return rest.join(chosen, F.col("cluster") == F.col("c")).withColumn("keep", F.col("place").eqNullSafe(F.col("stays")))


def without_repeats(docs: DataFrame, repeats: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, all columns, with every paragraph that is not kept cut out of its text but for what also belongs to one that is
    kept, and with the line break after it. Rows without such a paragraph, null texts among them, stay as they are; an empty
    table on either side changes nothing."""
    made = {n: f"{n}_{uuid.uuid4().hex}" for n in ("key", "hash", "cut", "kept", "whole", "marks")}
    spans = repeats.groupBy(F.col("doc_id").alias(made["key"]), F.col("text_hash").alias(made["hash"])).agg(*[F.collect_set(F.when(side, F.struct("begin", "end"))).alias(made[n]) for n, side in (("cut", ~F.col("keep")), ("kept", F.col("keep")))])
    joined = docs.join(spans.where(F.size(made["cut"]) > 0), F.col(key).cast("long").eqNullSafe(F.col(made["key"])) & (F.xxhash64(F.col(text)) == F.col(made["hash"])), "left")
    # the text from each mark to the next stays if a kept span holds it or no other does; a span goes with the white space after it
    marks = F.expr("array_sort(array_distinct(concat(array(0, length({whole})), transform({cut}, s -> s.begin), transform({cut}, s -> least(s.end + 1, length({whole}))), transform({kept}, s -> s.begin), transform({kept}, s -> least(s.end + 1, length({whole}))))))".format(**made))
    stays = "exists({kept}, s -> s.begin <= {whole_a} and s.end + 1 > {whole_a}) or not exists({cut}, s -> s.begin <= {whole_a} and s.end + 1 > {whole_a})"
    stays = stays.format(whole_a="a", **{n: made[n] for n in ("kept", "cut")})
    piece = f"if({stays}, substring({{whole}}, a + 1, b - a), '')".format(**made)
    left = F.expr("array_join(zip_with(slice({marks}, 1, size({marks}) - 1), slice({marks}, 2, size({marks}) - 1), (a, b) -> {piece}), '')".format(piece=piece, **made))
    cut = joined.withColumn(made["whole"], F.col(text)).withColumn(made["marks"], F.when(F.col(made["cut"]).isNotNull(), marks))
    return cut.withColumn(text, F.when(F.col(made["cut"]).isNull(), F.col(text)).otherwise(F.rtrim(left))).select(*docs.columns)
