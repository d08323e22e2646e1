"""TIFF media columns: walk the image directories, decode strips and tiles, undo predictors, one row per page.

Reads classic TIFF in both byte orders: strips and tiles, chunky and planar samples of 8, 16, 32 or 64 bits, no
compression (1), LZW (5), deflate (8 and 32946) and PackBits (32773), predictors 1, 2 (horizontal differences) and
3 (floating point). The writer makes the multi-page files of the query and of the tests.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import arrow_map

#: Tags of the TIFF 6.0 specification.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
DESCRIPTION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 270, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
#: Field types of the specification: their sizes and struct letters.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}


class BadTiff(ValueError):
    """The bytes can't be read as TIFF."""


# --- codecs ---------------------------------------------------------------------------------------------------------

_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def pack_bits(data: bytes) -> bytes:
    out, at = [], 0
    raw = np.frombuffer(data, np.uint8)
    same = raw[1:] == raw[:-1]
    runs = _RUN.finditer(data) if (same[1:] & same[:-1]).any() else ()

    def literal(a: int, b: int) -> None:
        for k in range(a, b, 128):
            n = min(128, b - k)
            out.append(bytes((n - 1,)) + data[k : k + n])

    for m in runs:
        literal(at, m.start())
        at = m.end()
        out.append(bytes((257 - (at - m.start()), data[m.start()])))
    literal(at, len(data))
    return b"".join(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at, made, end = [], 0, 0, len(data)
    while at < end and made < size:
        n = data[at]
        if n < 128:
            piece = data[at + 1 : at + n + 2]
            at += n + 2
        elif n == 128:
            at += 1
            continue
        else:
            piece = data[at + 1 : at + 2] * (257 - n)
            at += 2
        out.append(piece)
        made += len(piece)
    return b"".join(out)


def _lzw_layout() -> tuple[np.ndarray, np.ndarray]:
    """Bit offset and width of the k-th code after a clear code (widths grow one code early, as TIFF has it)."""
    k = np.arange(3840)  # at most so many codes until the table is full
    width = np.select([k < 254, k < 766, k < 1790], [9, 10, 11], 12)
    return np.concatenate([[0], np.cumsum(width)])[:-1], width


_AT, _WIDTH = _lzw_layout()
#: Codes between two clear codes as the writer sets them, below the largest table that a reader accepts.
_SPAN = 3830


def lzw_encode(data: bytes) -> bytes:
    codes: list[int] = [256]
    spans = [0]  # places in codes of the clear codes
    add = codes.append
    table: dict[int, int] = {}  # by prefix code * 256 + byte
    get, free, w = table.get, 258, -1
    for c in data:
        if w < 0:
            w = c
            continue
        key = w << 8 | c
        code = get(key)
        if code is not None:
            w = code
            continue
        add(w)
        table[key] = free
        free += 1
        w = c
        if free - 258 >= _SPAN:
            spans.append(len(codes))
            add(256)
            table.clear()
            free = 258
    if w >= 0:
        add(w)
    add(257)
    value = np.array(codes, np.int64)
    width = np.empty(len(codes), np.int64)
    for k, (a, b) in enumerate(zip(spans, [*spans[1:], len(codes)], strict=True)):
        # a clear code has the width that the table before it had come to
        width[a] = _WIDTH[a - spans[k - 1] - 1] if k else 9
        width[a + 1 : b] = _WIDTH[: b - a - 1]
    at = np.cumsum(width) - width
    # each code lies within three bytes
    room = value << (24 - width - (at & 7))
    out = np.zeros(int(at[-1] >> 3) + 3, np.int64)
    for k in range(3):
        out[: len(out)] += np.bincount((at >> 3) + k, (room >> (16 - 8 * k)) & 255, len(out)).astype(np.int64)
    return out.astype(np.uint8).tobytes()[: int(at[-1] + width[-1] + 7) // 8]


def lzw_decode(data: bytes, size: int) -> bytes:
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    total, at, out, made = len(data) * 8, 0, [], 0
    singles = [bytes((k,)) for k in range(256)] + [b"", b""]
    while at + 9 <= total and made < size:
        where = at + _AT
        n = int(np.searchsorted(where + _WIDTH, total, "right"))
        where, width = where[:n], _WIDTH[:n].astype(np.uint32)
        byte = where >> 3
        four = raw[byte] << np.uint32(24) | raw[byte + 1] << np.uint32(16) | raw[byte + 2] << np.uint32(8) | raw[byte + 3]
        codes = (four << (where & 7).astype(np.uint32)) >> (np.uint32(32) - width)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        used = int(stop[0]) if len(stop) else n
        table, last = singles.copy(), b""
        add = table.append
        for code in codes[:used].tolist():
            if last:
                if code < len(table):
                    piece = table[code]
                    add(last + piece[:1])
                elif code == len(table):
                    piece = last + last[:1]
                    add(piece)
                else:
                    raise BadTiff("LZW code beyond the table")
            else:
                if code > 255:
                    raise BadTiff("LZW begins beyond the table")
                piece = table[code]
            out.append(piece)
            last = piece
            made += len(piece)
        if used == n or codes[used] == 257:
            break
        at += int(_AT[used] + _WIDTH[used])
    return b"".join(out)


def _decompress(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BadTiff(str(e)) from e
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    else:
        raise BadTiff(f"compression {compression}")
    if len(out) < size:
        raise BadTiff(f"{len(out)} bytes where {size} are due")
    return out[:size]


def _unpredict(a: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """a: rows x columns x samples, in the file's byte order."""
    if predictor == 1:
        return a
    if predictor == 2:
        return np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("=")).astype(a.dtype)
    if predictor == 3:
        rows, columns, samples = a.shape
        size = a.dtype.itemsize
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(rows, columns * samples * size)
        # byte differences run at the distance of one pixel's samples, over planes of most significant bytes first
        planes = np.cumsum(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        big = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(a.dtype.newbyteorder(">"))
        return big.reshape(rows, columns, samples).astype(a.dtype)
    raise BadTiff(f"predictor {predictor}")


# --- reading --------------------------------------------------------------------------------------------------------


@dataclass
class Page:
    page: int
    width: int = 0
    height: int = 0
    bits: int = 0
    samples: int = 0
    compression: str = ""
    predictor: int = 0
    layout: str = ""
    segments: int = 0
    pixels: bytes = b""  # rows top down, samples of a pixel together, in the file's byte order
    description: str | None = None
    error: str | None = None
    tags: dict[int, tuple] = field(default_factory=dict)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    if at + 2 > len(data):
        raise BadTiff("directory beyond the end")
    (count,) = struct.unpack_from(order + "H", data, at)
    if at + 2 + 12 * count + 4 > len(data):
        raise BadTiff("directory beyond the end")
    tags = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in TYPES:
            continue
        letters = TYPES[kind]
        one = struct.calcsize("=" + letters)
        place = at + 2 + 12 * k + 8
        if one * n > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + one * n > len(data):
            raise BadTiff(f"tag {tag} beyond the end")
        tags[tag] = struct.unpack_from(order + letters * n if len(letters) > 1 else f"{order}{n}{letters}", data, place)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
    return tags, following


def _pixels(data: bytes, tags: dict[int, tuple], page: Page, order: str) -> None:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    page.width, page.height, page.samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    page.bits, page.predictor, planar = one(BITS, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    page.compression = NAMES.get(one(COMPRESSION, 1), str(one(COMPRESSION, 1)))
    if DESCRIPTION in tags:
        page.description = b"".join(tags[DESCRIPTION]).rstrip(b"\0").decode("utf-8", "replace")
    if page.bits not in (8, 16, 32, 64) or any(b != page.bits for b in tags.get(BITS, ())):
        raise BadTiff(f"{page.bits} bits a sample")
    if not page.width or not page.height:
        raise BadTiff("no size")
    kind = np.dtype(f"{order}{'f' if one(SAMPLE_FORMAT, 1) == 3 and page.bits > 16 else 'u'}{page.bits // 8}")
    tiled = TILE_OFFSETS in tags
    page.layout = "tiles" if tiled else "strips"
    wide, high = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (page.width, min(one(ROWS_PER_STRIP, page.height), page.height))
    offsets, counts = (tags.get(t, ()) for t in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
    if not wide or not high:
        raise BadTiff("no segment size")
    across, down = -(-page.width // wide), -(-page.height // high)
    planes, own = (page.samples, 1) if planar == 2 else (1, page.samples)
    if len(offsets) < across * down * planes or len(counts) < across * down * planes:
        raise BadTiff("too few segments")
    page.segments = across * down * planes
    out = np.empty((page.height, page.width, page.samples), kind)
    for k in range(page.segments):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * high, rest % across * wide
        rows = high if tiled else min(high, page.height - y)
        if offsets[k] + counts[k] > len(data):
            raise BadTiff("segment beyond the end")
        got = _decompress(data[offsets[k] : offsets[k] + counts[k]], one(COMPRESSION, 1), rows * wide * own * kind.itemsize)
        a = _unpredict(np.frombuffer(got, kind).reshape(rows, wide, own), page.predictor, order)
        out[y : y + rows, x : x + wide, plane : plane + own] = a[: page.height - y, : page.width - x]
    page.pixels = out.tobytes()


def read_pages(data: bytes | None, most_pages: int = 1_000_000) -> Iterator[Page]:
    """The pages of a file in order. What can't be read becomes a page with an error, and ends the walk if its
    directory itself can't be read, or comes again."""
    if not data or len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        yield Page(0, error="no TIFF header")
        return
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    number = 0
    if not at:
        yield Page(0, error="no directory")
    while at and number < most_pages:
        page = Page(number)
        try:
            if at in seen:
                raise BadTiff("directories run in a circle")
            seen.add(at)
            page.tags, at = _directory(data, at, order)
        except (BadTiff, struct.error) as e:
            page.error = str(e)
            yield page
            return
        try:
            _pixels(data, page.tags, page, order)
        except (BadTiff, struct.error, ValueError, MemoryError) as e:
            page.error = str(e)
        yield page
        number += 1


# --- writing --------------------------------------------------------------------------------------------------------

#: Compression, predictor and layout of a written file's pages, in turn.
PLAN = ((DEFLATE, 1, "strips"), (PACKBITS, 1, "tiles"), (LZW, 2, "strips"), (DEFLATE, 2, "tiles"), (NONE, 2, "strips"), (PACKBITS, 1, "strips"), (DEFLATE, 2, "strips"), (LZW, 1, "tiles"))


def _compress(raw: bytes, compression: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits}[compression](raw)


def write_tiff(samples: bytes, width: int = 64, page_rows: int = 512, turn: int = 0, plan: tuple = PLAN, order: str = "<", description: str = "") -> bytes:
    """8-bit samples, a multiple of width long, as grey pages of page_rows rows; page k is stored as plan[turn + k] says."""
    pixels = np.frombuffer(samples, np.uint8).reshape(-1, width)
    out = [b"II*\0" if order == "<" else b"MM\0*", b""]
    at, directories = 8, []
    for k, y in enumerate(range(0, len(pixels), page_rows)):
        image = pixels[y : y + page_rows]
        compression, predictor, layout = plan[(turn + k) % len(plan)]
        high, wide = (16 * max(1, min(16, len(image) // 16)), 64) if layout == "tiles" else (256, width)
        segments = []
        for a in range(0, len(image), high):
            for b in range(0, width, wide):
                piece = image[a : a + high, b : b + wide]
                if layout == "tiles":
                    piece = np.pad(piece, ((0, high - piece.shape[0]), (0, wide - piece.shape[1])))
                if predictor == 2:
                    piece = np.concatenate([piece[:, :1], np.diff(piece, axis=1)], axis=1)
                segments.append(_compress(piece.tobytes(), compression))
        offsets = []
        for s in segments:
            offsets.append(at)
            out.append(s + b"\0" * (len(s) % 2))
            at += len(s) + len(s) % 2
        tags = {WIDTH: [width], HEIGHT: [len(image)], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        sizes = [len(s) for s in segments]
        tags |= {TILE_WIDTH: [wide], TILE_HEIGHT: [high], TILE_OFFSETS: offsets, TILE_COUNTS: sizes} if layout == "tiles" else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [high], STRIP_COUNTS: sizes}
        if description and not k:
            tags[DESCRIPTION] = description.encode() + b"\0"
        entries = b""
        for tag, values in sorted(tags.items()):
            packed = bytes(values) if tag == DESCRIPTION else struct.pack(f"{order}{len(values)}I", *values)
            if len(packed) > 4:
                out.append(packed + b"\0" * (len(packed) % 2))
                packed, at = struct.pack(order + "I", at), at + len(out[-1])
            entries += struct.pack(order + "HHI", tag, 2 if tag == DESCRIPTION else 4, len(values)) + packed.ljust(4, b"\0")
        directories.append((at, len(tags), entries))
        out.append(None)
        at += 6 + len(entries)
    places = [d[0] for d in directories] + [0]
    found = iter(zip(directories, places[1:], strict=True))
    out[1] = struct.pack(order + "I", places[0])
    for k, piece in enumerate(out):
        if piece is None:
            (_, n, entries), following = next(found)
            out[k] = struct.pack(order + "H", n) + entries + struct.pack(order + "I", following)
    return b"".join(out)


# --- DataFrames -----------------------------------------------------------------------------------------------------

PAGE_SCHEMA = "key long, file_bytes long, file_sha256 string, page int, width int, height int, bits int, samples int, compression string, predictor int, layout string, segments int, pixels binary, description string, error string"
_ARROW = pa.schema([("key", pa.int64()), ("file_bytes", pa.int64()), ("file_sha256", pa.string()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32()), ("samples", pa.int32()), ("compression", pa.string()), ("predictor", pa.int32()), ("layout", pa.string()), ("segments", pa.int32()), ("pixels", pa.binary()), ("description", pa.string()), ("error", pa.string())])
_BATCH_BYTES = 4 << 20
#: The description that texts_to_tiff gives a file.
_SIZE = re.compile(r"n_bytes=(\d{1,18})")


def tiff_pages(files: DataFrame, media: str = "media", key: str = "key") -> DataFrame:
    """One row per page of each file, in the files' order, the pages of a file together; a narrow map without a shuffle.

    key goes along. A null, empty or unreadable file gives one row, page 0 with an error; an unreadable page gives a row
    with an error and no pixels, and the walk goes on. Repeated rows are read each by itself, an empty table gives no
    rows, further columns are not read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for name, data in zip(batch.column("key").to_pylist(), batch.column("media").to_pylist(), strict=True):
                digest = hashlib.sha256(data or b"").hexdigest()
                for p in read_pages(data):
                    rows.append({"key": name, "file_bytes": len(data or b""), "file_sha256": digest, **{c: getattr(p, c) for c in _ARROW.names[3:]}})
                    held += len(p.pixels)
                    if held > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return arrow_map(files.selectExpr(f"cast({key} as long) as key", f"{media} as media"), read, PAGE_SCHEMA)


def texts_to_tiff(docs: DataFrame, *, text: str = "text", key: str = "doc_id", unit: int = 64) -> DataFrame:
    """Each whole text (null as empty) in UTF-8, zero bytes to a positive multiple of unit, as a TIFF file: key, media.

    Its description holds the length without the zero bytes.

    The text alone decides how its pages are stored, so equal texts give equal files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                media = []
                for t in batch.column("text").to_pylist():
                    raw = (t or "").encode()
                    size = len(raw)
                    raw += b"\0" * (-len(raw) % unit or (0 if raw else unit))
                    media.append(write_tiff(raw, unit, turn=zlib.crc32(raw), description=f"n_bytes={size}"))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(media, pa.binary())], ["key", "media"])

    return arrow_map(docs.selectExpr(f"cast({key} as long) as key", f"cast({text} as string) as text"), write, "key long, media binary")


def payload_digests(pages: DataFrame) -> DataFrame:
    """Folds the pages of each file, which must stand together and in order as tiff_pages leaves them, to one row.

    n_bytes is read from a description of the form of texts_to_tiff, else null. A file that could not be read has an empty
    payload and counts its errors; null keys and repeated files give a row each; an empty table gives no rows.
    """
    names = ["doc_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_bytes", "n_pages", "errors"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None

        def row(s: dict) -> tuple:
            tail = s["tail"][-64:]
            hist = s["hist"] / max(1, s["size"])
            entropy = float(-(hist[hist > 0] * np.log2(hist[hist > 0])).sum())
            feature = f"pages={s['pages']};codecs={','.join(sorted(s['codecs']))};mean={float((hist * np.arange(256)).sum()):.4f};entropy={entropy:.4f};distinct={int((hist > 0).sum())}"
            return s["key"], s["size"], s["sha"].hexdigest(), zlib.crc32(tail), s["bytes"], s["file"], feature, s["n_bytes"], s["pages"], s["errors"]

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["page"] == 0:
                    if state:
                        done.append(row(state))
                    state = {"key": r["key"], "sha": hashlib.sha256(), "size": 0, "tail": b"", "hist": np.zeros(256), "pages": 0, "codecs": set(), "errors": 0, "bytes": r["file_bytes"], "file": r["file_sha256"], "n_bytes": int(size[1]) if (size := _SIZE.fullmatch(r["description"] or "")) else None}
                p = r["pixels"]
                state["sha"].update(p)
                state["size"] += len(p)
                state["tail"] = (state["tail"] + p)[-64:]
                state["hist"] += np.bincount(np.frombuffer(p, np.uint8), minlength=256)
                state["pages"] += 1
                state["errors"] += r["error"] is not None
                state["codecs"].add(f"{r['compression']}/{r['layout']}/{r['predictor']}")
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row(state), types, strict=True)], names)

    return pages.mapInArrow(fold, "doc_id long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_bytes long, n_pages int, errors int")
