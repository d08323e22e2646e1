"""Sets of word shingles as sorted arrays of 64-bit hashes, made for many texts at once in numpy.

Words are runs of anything but ASCII white space, A-Z in lower case; a set holds each run of five words once, or with
fewer words the whole sequence. Sets are compared by their hashes: two different shingles agree with odds of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .base import mix64

WORDS = 5
#: Bytes of text hashed in one go; bounds the working arrays.
CHUNK = 1 << 20

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = mix64(np.arange(1000, 1000 + WORDS, dtype=np.uint64)) | np.uint64(1)
_PLACE = mix64(np.arange(5000, 5064, dtype=np.uint64)) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _places(longest: int) -> np.ndarray:
    global _PLACE
    if longest > len(_PLACE):
        _PLACE = mix64(np.arange(5000, 5000 + 2 * longest, dtype=np.uint64)) | np.uint64(1)
    return _PLACE


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place of the first byte and of that after the last, of each word of the bytes."""
    letter = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    lengths = ends - starts
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = _BYTE[raw[letter]] * _places(int(lengths.max()))[inner]
    return mix64(np.add.reduceat(values, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64)), starts, ends


def _of_chunk(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    raw = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    words, starts, _ = word_hashes(raw)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(starts, offsets).tolist()
    n = max(0, len(words) - WORDS + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(WORDS):
        runs += words[k : k + n] * _STEP[k]
    runs = mix64(runs)
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= WORDS:
            yield b - a, np.unique(runs[a : b - WORDS + 1])
        elif b > a:
            yield b - a, mix64((words[a:b] * _STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield 0, np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each text: number of words, sorted distinct shingle hashes."""
    chunk: list[bytes] = []
    size = 0
    for t in texts:
        chunk.append(t)
        size += len(t)
        if size > CHUNK:
            yield from _of_chunk(chunk)
            chunk, size = [], 0
    if chunk:
        yield from _of_chunk(chunk)


def digest(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set: equal sets, equal names."""
    with np.errstate(over="ignore"):
        total = mix64(np.array([mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum() + np.uint64(len(hashes))], np.uint64))
    return int(total.view(np.int64)[0])
