"""Token-id files coded with a static range asymmetric numeral system (rANS).

A file is a row of a Parquet table (column `data`), a self-contained segment of consecutive documents:

    magic "RNS1" | u32 documents, ids, symbols, block_steps, lanes, checkpoint_steps, blocks
    doc_id (i64, null as the flag array says) | null flag (u8) | ids per document (u32)
    symbols (u32 ascending) | their frequencies (u32, sum 2**20): the table that all blocks of the file share
    per block: word count u32, crc32 of its ids u32
    per checkpoint of each block: word position u32, then one u64 state per lane
    words (u32) of block 0, 1, ...
    crc32 of all before it

A block holds block_steps * lanes ids, dealt to `lanes` interleaved coders (id i to lane i mod lanes), the last block
padded with its file's most frequent symbol. Blocks are independent, and each checkpoint within a block has all that a
decoder needs to start there, so that a decoder runs every (block, checkpoint) side by side.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, materialize

MAGIC = b"RNS1"
PRECISION = 20
LOW = np.uint64(1 << 31)
_32, _P = np.uint64(32), np.uint64(PRECISION)
_MASK = np.uint64((1 << PRECISION) - 1)
HEAD = struct.Struct("<4s7I")


class CorruptFile(ValueError):
    """The bytes are no such file, or a checksum doesn't hold."""


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of sum 2**20, each at least 1, near to the counts' shares (all counts are above 0)."""
    total = 1 << PRECISION
    if len(counts) > total // 2:
        raise ValueError("too many distinct ids for the precision")
    f = np.maximum(1, (counts * (total / counts.sum())).astype(np.int64))
    over = int(f.sum()) - total
    if over <= 0:
        f[np.argmax(f)] -= over
        return f
    order = np.argsort(-f, kind="stable")
    while over:  # taken from the largest, in proportion, so that no frequency falls below 1
        give = np.minimum(f[order] - 1, np.maximum(1, f[order] * over // total))
        give = give[: np.searchsorted(np.cumsum(give), over, "left") + 1]
        give[-1] -= max(0, int(give.sum()) - over)
        f[order[: len(give)]] -= give
        over -= int(give.sum())
    return f


def encode(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, *, block_steps: int = 2048, lanes: int = 8, checkpoint_steps: int = 512) -> bytes:
    """One file of the documents' ids, laid end to end."""
    n, per = len(ids), block_steps * lanes
    blocks = -(-n // per)
    counts = np.bincount(ids, minlength=1)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[symbols] = np.arange(len(symbols))
    inverse, counts = place[ids], counts[symbols]
    freq = scaled(counts) if n else counts
    start = np.concatenate([[0], np.cumsum(freq)])[:-1].astype(np.uint64)
    fill = np.full(blocks * per - n, int(np.argmax(counts)) if n else 0, inverse.dtype)
    x_ids = np.concatenate([inverse, fill]).reshape(blocks, block_steps, lanes).transpose(1, 0, 2)  # step, block, lane
    f64, top = freq.astype(np.uint64), (freq.astype(np.uint64) << np.uint64(63 - PRECISION))
    x = np.full((blocks, lanes), LOW, np.uint64)
    words = np.zeros((block_steps, blocks, lanes), np.uint32)
    sent = np.zeros((block_steps, blocks, lanes), bool)
    states = []
    for t in range(block_steps - 1, -1, -1):
        s = x_ids[t]
        f = f64[s]
        out = x >= top[s]
        sent[t], words[t] = out, x.astype(np.uint32)
        x = np.where(out, x >> _32, x)
        q = x // f
        x = (q << _P) + (x - q * f) + start[s]
        if t % checkpoint_steps == 0:
            states.append(x)
    marks = len(states)
    states_a = np.stack(states[::-1], 1)  # block, checkpoint, lane
    stream = words.transpose(1, 0, 2)[(mask := sent.transpose(1, 0, 2))]
    per_step = mask.sum(2)
    before = np.concatenate([np.zeros((blocks, 1), np.int64), np.cumsum(per_step, 1)], 1)
    at = before[:, : block_steps : checkpoint_steps].astype(np.uint32)
    crcs = [zlib.crc32(ids[b * per : (b + 1) * per].astype("<u4").tobytes()) for b in range(blocks)]
    info = np.empty(blocks, [("words", "<u4"), ("crc", "<u4")])
    info["words"], info["crc"] = before[:, -1], crcs
    checks = np.empty((blocks, marks), [("at", "<u4"), ("x", "<u8", (lanes,))])
    checks["at"], checks["x"] = at, states_a
    body = b"".join((
        HEAD.pack(MAGIC, len(doc_ids), n, len(symbols), block_steps, lanes, checkpoint_steps, blocks),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), lengths.astype("<u4").tobytes(),
        symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), info.tobytes(), checks.tobytes(), stream.astype("<u4").tobytes(),
    ))
    return body + struct.pack("<I", zlib.crc32(body))


def decode(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids end to end, ids per document. Raises CorruptFile if a checksum doesn't hold."""
    if len(data) < HEAD.size + 4 or data[:4] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(memoryview(data)[:-4]):
        raise CorruptFile("bad magic or checksum")
    _, docs, n, distinct, block_steps, lanes, checkpoint_steps, blocks = HEAD.unpack_from(data)
    place = HEAD.size

    def take(count: int, kind) -> np.ndarray:
        nonlocal place
        got = np.frombuffer(data, kind, count, place)
        place += got.nbytes
        return got

    doc_ids, null, lengths = take(docs, "<i8"), take(docs, "u1"), take(docs, "<u4")
    symbols, freq = take(distinct, "<u4"), take(distinct, "<u4").astype(np.uint64)
    info = take(blocks, [("words", "<u4"), ("crc", "<u4")])
    marks = -(-block_steps // checkpoint_steps)
    checks = take(blocks * marks, [("at", "<u4"), ("x", "<u8", (lanes,))]).reshape(blocks, marks)
    names = [None if z else int(d) for d, z in zip(doc_ids, null, strict=True)]
    if not n:
        return names, np.zeros(0, np.uint32), lengths
    words = np.concatenate([take(int(info["words"].sum(dtype=np.int64)), "<u4"), [0]]).astype(np.uint64)
    base = np.concatenate([[0], np.cumsum(info["words"], dtype=np.int64)])[:-1]
    start = np.concatenate([[0], np.cumsum(freq)])[:-1].astype(np.uint64)
    slot = np.repeat(np.arange(distinct, dtype=np.int32), freq.astype(np.int64))
    x = checks["x"].reshape(-1, lanes).astype(np.uint64)
    at = (base[:, None] + checks["at"]).reshape(-1)
    out = np.empty((checkpoint_steps, blocks * marks, lanes), np.int32)
    for t in range(checkpoint_steps):
        low = x & _MASK
        s = slot[low.astype(np.int64)]
        out[t] = s
        x = freq[s] * (x >> _P) + low - start[s]
        need = x < LOW
        step = np.cumsum(need, 1)
        got = words[np.minimum(at[:, None] + step - need, len(words) - 1)]
        x = np.where(need, (x << _32) | got, x)
        at = at + step[:, -1]
    per = block_steps * lanes
    units = out.transpose(1, 0, 2).reshape(blocks, marks * checkpoint_steps, lanes)[:, :block_steps]
    ids = symbols[units.reshape(blocks * per)[:n]]
    for b in range(blocks):
        if zlib.crc32(ids[b * per : (b + 1) * per].astype("<u4").tobytes()) != info["crc"][b]:
            raise CorruptFile(f"checksum of block {b}")
    return names, ids, lengths


def decode_block(data: bytes, block: int, checkpoint: int = 0) -> np.ndarray:
    """The ids of one block from a checkpoint on, without decoding any other."""
    _, docs, n, distinct, block_steps, lanes, checkpoint_steps, blocks = HEAD.unpack_from(data)
    place = HEAD.size + 13 * docs
    symbols, freq = (np.frombuffer(data, "<u4", distinct, place + 4 * distinct * k) for k in (0, 1))
    place += 8 * distinct
    info = np.frombuffer(data, [("words", "<u4"), ("crc", "<u4")], blocks, place)
    marks = -(-block_steps // checkpoint_steps)
    checks = np.frombuffer(data, [("at", "<u4"), ("x", "<u8", (lanes,))], blocks * marks, place + 8 * blocks).reshape(blocks, marks)
    place += 8 * blocks + blocks * marks * (4 + 8 * lanes)
    at = int(info["words"][:block].sum(dtype=np.int64)) + int(checks["at"][block, checkpoint])
    words = np.frombuffer(data, "<u4", int(info["words"].sum(dtype=np.int64)), place)
    start = np.concatenate([[0], np.cumsum(freq, dtype=np.int64)]).tolist()
    slot = np.repeat(np.arange(distinct), freq)
    x, out = [int(v) for v in checks["x"][block, checkpoint]], []
    for _ in range(checkpoint * checkpoint_steps, block_steps):
        for lane in range(lanes):
            low = x[lane] & ((1 << PRECISION) - 1)
            s = int(slot[low])
            out.append(s)
            x[lane] = int(freq[s]) * (x[lane] >> PRECISION) + low - start[s]
            if x[lane] < 1 << 31:
                x[lane] = x[lane] << 32 | int(words[at])
                at += 1
    left = n - block * block_steps * lanes - checkpoint * checkpoint_steps * lanes
    return symbols[out[: max(0, left)]]


#: Per worker and tokenizer file: the tokenizer, its special strings, ids of pieces.
_TOKENIZERS: dict[str, tuple] = {}
#: Pieces whose ids a worker keeps; past this the store starts anew. Bounds memory, never results.
KEPT_PIECES = 900_000
#: Bytes of text (one text at least) that are cut and looked up in one go.
SLICE_BYTES = 4_000_000
#: Begins a piece that no space stands before; texts that hold it are cut another way.
BARE = "\x02"
#: White space of any script, as an RE2 class.
_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Texts in which a space or a line break is no cut by itself, for the white space around it.
_ODD = rf"{BARE}|^\n|\n(?:{_SPACES}|$)|{_SPACES}\n|{_SPACES} (?:{_SPACES}|$)"
_CUT = re.compile(r" (?=\S)")
_WHITE = re.compile(r"\s")


def _tokenizer(path: str) -> tuple:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path not in _TOKENIZERS:
        tokenizer = Tokenizer.from_file(path)
        parts = json.loads(tokenizer.to_str())
        byte_level = parts["pre_tokenizer"] or {}
        if byte_level.get("type") != "ByteLevel" or not byte_level.get("use_regex", True) or byte_level.get("add_prefix_space"):
            raise ValueError("a byte-level tokenizer with its own pattern and no added space is needed")
        if parts.get("normalizer"):
            raise ValueError("a tokenizer without a normalizer is needed, as texts are cut before it would see them")
        _TOKENIZERS[path] = tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()], {}
    return _TOKENIZERS[path]


class _Pieces:
    """Ids of pieces between the cuts that a byte-level pre-tokenizer always makes; new ones are asked for together.

    A piece stands after a space, or if it begins with BARE, right after the one before (or at the text's begin)."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.specials, self.known = _tokenizer(path)
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        (self.line,) = self.whole(["\n"])

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _as_lines(self, pieces: list[str]) -> Iterator[bytes]:
        """The ids of each piece (as it stands, without line breaks): they go as one text, a line each, and a line break
        between is a piece of its own there, so that the ids part at its id."""
        for k in range(0, len(pieces), 4096):
            some = pieces[k : k + 4096]
            raw = self.whole(["\n".join(some)])[0]
            cuts = np.flatnonzero(np.frombuffer(raw, "<u4") == np.frombuffer(self.line, "<u4")[0]) * 4 if len(self.line) == 4 else []
            if len(cuts) == len(some) - 1:
                ends = [*cuts.tolist(), len(raw)]
                yield from (raw[a:b] for a, b in zip([0, *(c + 4 for c in ends[:-1])], ends, strict=True))
            else:  # a vocabulary in which a line break is not told apart so
                yield from self.whole(some)

    def ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. What has white space in it is encoded by itself and not kept."""
        # set.difference looks members up in the store; an operator would walk the whole store
        new = set(pieces).difference(self.known)
        if not new:
            return [self.known[p] for p in pieces]
        as_is = {p: p[1:] if p[:1] == BARE else f" {p}" for p in new}
        hard = [p for p, t in as_is.items() if len(t) < 2 or _WHITE.search(t, 1)]
        lined = [p for p in new.difference(hard)]
        self.known.update(zip(lined, self._as_lines([as_is[p] for p in lined]), strict=True))
        made = dict(zip(hard, self.whole([as_is[p] for p in hard]), strict=True)) if hard else {}
        known = self.known
        return [made[p] if p in made else known[p] for p in pieces] if made else [known[p] for p in pieces]

    def of_parts(self, lists: pa.ListArray) -> list[bytes]:
        """The ids of texts in pieces; the first of each stands at the text's begin."""
        ends = np.asarray(lists.offsets)
        flat = lists.flatten()
        heads = self.ids([BARE + h for h in flat.take(pa.array(ends[:-1])).to_pylist()])
        coded = flat.dictionary_encode()
        values = pa.array(self.ids(coded.dictionary.to_pylist()), pa.large_binary())
        # the ids of all pieces in their order are one buffer
        laid = values.take(coded.indices)
        at = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1)
        data = memoryview(laid.buffers()[2] or b"")
        return [h + bytes(data[at[a + 1] : at[b]]) for h, a, b in zip(heads, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def encode_texts(texts: list[str] | pa.StringArray, path: str) -> list[bytes]:
    """The ids of each whole text (null: empty) as little-endian u32, without special tokens added.

    No merge crosses a cut of the pre-tokenizer, so the ids of a text are those of its pieces between cuts: it cuts before
    a space that a non-space follows, and before any space that a non-space precedes. The tokenizers library is asked for
    each new piece only. Texts with the string of a special token go to it whole.
    """
    column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    column = pc.fill_null(column, "")
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    out: list[bytes] = []
    at = 0
    while at < len(column):
        done = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right")))
        out += _encode_slice(column.slice(at, end - at), _Pieces(path))
        at = end
    return out


def _cut_plain(texts: pa.StringArray) -> pa.ListArray:
    """The pieces of texts without anything of _ODD: cut at spaces, around line breaks, and before a stop that follows a
    letter or a digit and has a space after it."""
    lined = pc.replace_substring(texts, "\n", f" {BARE}\n {BARE}")
    return pc.split_pattern(pc.replace_substring_regex(lined, r"([\p{L}\p{N}])([,.]) ", rf"\1 {BARE}\2 "), " ")


def _cut_odd(texts: pa.StringArray) -> pa.ListArray:
    """The pieces of any texts: cut at spaces that a non-space follows; what begins with BARE itself is kept whole."""
    return pa.array([_CUT.split(t) if BARE not in t else [t] for t in texts.to_pylist()], pa.list_(pa.string()))


def _encode_slice(column: pa.StringArray, pieces: _Pieces) -> list[bytes]:
    flag = lambda found: np.asarray(found.to_numpy(zero_copy_only=False), bool)
    special = np.zeros(len(column), bool)
    for s in pieces.specials:
        special |= flag(pc.match_substring(column, s))
    odd = flag(pc.match_substring_regex(column, _ODD)) & ~special
    out: list[bytes] = [b""] * len(column)
    for mask, encode in (
        (special, lambda some: pieces.whole(some.to_pylist())),
        (odd, lambda some: pieces.of_parts(_cut_odd(some))),
        (~special & ~odd, lambda some: pieces.of_parts(_cut_plain(some))),
    ):
        if mask.any():
            for k, ids in zip(np.flatnonzero(mask).tolist(), encode(column.filter(pa.array(mask))), strict=True):
                out[k] = ids
    return out


def write_token_files(docs: DataFrame, tokenizer_path: str, *, end_id: int = 0, segment_ids: int = 2_000_000, text: str = "text", key: str = "doc_id", tag: str = "tokens") -> DataFrame:
    """Write the ids of all texts, each followed by end_id, in ascending key order; returns the files' table.

    A range shuffle orders the documents; a task then tokenizes its range in order and closes a file when it holds
    segment_ids ids, so memory is bounded by that and by one batch of texts. Columns of the table: part (order of the
    range), file (order within it), first and last key, n_docs, n_ids, data.

    Null texts count as empty (end_id alone), null keys come first, documents of equal key stay together in the order
    of their texts, an empty table gives a table without rows, and further columns of docs are not read.
    """
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def to_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, file = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0
        end = np.array([end_id], "<u4").tobytes()

        def close() -> pa.RecordBatch:
            nonlocal names, held, size, file
            lengths = np.array([len(h) // 4 for h in held], np.int64)
            data = encode(names, np.frombuffer(b"".join(held), "<u4"), lengths)
            row = [[part], [file], [len(names)], [int(lengths.sum())], [data]]
            names, held, size, file = [], [], 0, file + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "file", "n_docs", "n_ids", "data"])

        for whole in batches:
            for name, ids in zip(whole.column("doc_id").to_pylist(), encode_texts(whole.column("text"), tokenizer_path), strict=True):
                names.append(name)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= segment_ids:
                    yield close()
        if names:
            yield close()

    ranged = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(arrow_map(ranged, to_files, "part int, file int, n_docs long, n_ids long, data binary"), tag)


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document of the files: part, file, place in the file, doc_id, ids (little-endian u32, end id too)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, data in zip(*(batch.column(c).to_pylist() for c in ("part", "file", "data")), strict=True):
                names, ids, lengths = decode(data)
                ends = np.cumsum(lengths, dtype=np.int64).tolist()
                raw = ids.astype("<u4").tobytes()
                for k in range(0, len(names), 512):
                    own = ends[k : k + 512]
                    begin = [ends[k - 1] if k else 0, *own[:-1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(own), pa.int32()), pa.array([file] * len(own), pa.int32()), pa.array(range(k, k + len(own)), pa.int32()), pa.array(names[k : k + 512], pa.int64()), pa.array([raw[4 * a : 4 * b] for a, b in zip(begin, own, strict=True)], pa.binary())],
                        ["part", "file", "place", "doc_id", "ids"],
                    )

    return files.select("part", "file", "data").mapInArrow(read, "part int, file int, place int, doc_id long, ids binary")


def token_index(files: DataFrame) -> DataFrame:
    """Per document, as read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Starts add up in two steps: within a file by place, over files by the files' own counts, a table of one row a file.
    """
    from pyspark.sql import Window as W

    docs = read_token_files(files).select("part", "file", "place", "doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    per_file = files.select("part", "file", "n_ids")
    offsets = per_file.select("part", "file", (F.sum("n_ids").over(W.partitionBy("part").orderBy("file")) - F.col("n_ids")).alias("own"))
    parts = per_file.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row a task of the writer: the one ordered list that must be seen as a whole
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    offsets = offsets.join(parts, "part").select("part", "file", (F.col("own") + F.col("base")).alias("offset"))
    within = F.sum("n_tokens").over(W.partitionBy("part", "file").orderBy("place")) - F.col("n_tokens")
    return docs.withColumn("within", within).join(offsets, ["part", "file"]).select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", F.col("ids_crc32").cast("long").alias("ids_crc32"))
