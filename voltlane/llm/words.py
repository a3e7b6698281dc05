"""Words of whole texts as numpy arrays, for use inside Spark tasks.

A word is a run of characters other than the space and the controls 0x09-0x0D. As these are single bytes in UTF-8,
words are cut on bytes. Every word gets a 64-bit hash of its bytes, computed for all words of a chunk at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken apart at once; one text longer than this makes a chunk of its own.
CHUNK_BYTES = 2_000_000
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Chunk(NamedTuple):
    first: int
    """Row of the first text of the chunk in its batch."""
    rows: int
    data: np.ndarray
    """Bytes of the texts, one after the other."""
    bounds: np.ndarray
    """Where each text begins, and the end of the last."""
    start: np.ndarray
    end: np.ndarray
    """Where each word begins and ends."""
    per_text: np.ndarray
    """Number of words of each text."""
    hashes: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64 bits over 64 bits, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64))
    if lower:
        codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


_CODES = {lower: _codes(lower) for lower in (False, True)}
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES // 4), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 4 * CHUNK_BYTES:  # one very long text does not stay in memory
            _powers[base] = have
    return have[:n]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODES[lower][data] * _power(_BASE, len(data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))


def chunks(texts: pa.Array | pa.ChunkedArray, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole texts in chunks of about `limit` bytes. A null counts as an empty text. `lower`: A-Z hash as a-z."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    buffer = texts.buffers()[2]
    all_bytes = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        data = all_bytes[offsets[first] : offsets[last]]
        bounds = offsets[first : last + 1] - offsets[first]
        yield cut(data, bounds, first, lower)
        first = last


def cut(data: np.ndarray, bounds: np.ndarray, first: int = 0, lower: bool = False) -> Chunk:
    inside = ~_BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][(bounds[:-1] < bounds[1:]) & (bounds[:-1] > 0)]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    per_text = np.diff(np.searchsorted(start, bounds))
    return Chunk(first, len(bounds) - 1, data, bounds, start, end, per_text, word_hashes(data, start, end, lower))


def owner(per_text: np.ndarray) -> np.ndarray:
    """Text number of each word."""
    return np.repeat(np.arange(len(per_text)), per_text)


def windows(hashes: np.ndarray, per_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of `size` words inside a text."""
    if len(hashes) < size:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    n = len(hashes) - size + 1
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        sums = (sums ^ hashes[k : k + n]) * np.uint64(_BASE + 2 * k)
        sums ^= sums >> np.uint64(29)
    texts = owner(per_text)
    whole = texts[:n] == texts[size - 1 :]
    return mix(sums[whole]), texts[:n][whole]
