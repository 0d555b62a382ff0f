"""Words and word shingles of Arrow string columns, hashed in whole arrays.

A word is a run of bytes other than space and U+0009 to U+000D, with A-Z lower-cased. Both rules are
about single bytes that never occur inside a longer UTF-8 sequence, so they work on the column's
byte buffer without making a Python string for any text. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at a time; a longer text is handled alone.
CHUNK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, CHUNK), base, dtype=np.uint64)
        steps[0] = 1
        made = np.multiply.accumulate(steps)
        if n > 2 * CHUNK:  # made for one long text: not kept
            return made
        _POWERS[base] = made
    return _POWERS[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (nulls count as empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    where = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    where = where[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[where[0] : where[-1]]
    return raw, where - where[0]


def chunks(raw: np.ndarray, where: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about CHUNK bytes: (first, past the last, bytes, starts)."""
    first, n = 0, len(where) - 1
    while first < n:
        past = max(first + 1, int(np.searchsorted(where, where[first] + CHUNK, "right")) - 1)
        yield first, past, raw[where[first] : where[past]], where[first : past + 1] - where[first]
        first = past


class Words:
    """Words of a run of texts: ``start``/``end`` bytes, ``hash``, and ``of`` (first word of each text)."""

    def __init__(self, raw: np.ndarray, where: np.ndarray):
        self.low = low = _LOWER[raw]
        n = len(low)
        inside = ~_SPACE[low]
        before = np.empty(n, dtype=bool)
        before[1:] = ~inside[:-1]
        after = np.empty(n, dtype=bool)
        after[:-1] = ~inside[1:]
        edges = where[(where > 0) & (where < n)]
        if n:
            before[0] = after[-1] = True
            before[edges] = True
            after[edges - 1] = True
        self.start = np.flatnonzero(inside & before)
        self.end = np.flatnonzero(inside & after) + 1
        self.of = np.searchsorted(self.start, where, "left")
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((low + np.uint64(1)) * _powers(_BASE, n), out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * _powers(_UNBASE, n + 1)[self.start])


def _multipliers(width: int) -> np.ndarray:
    return np.random.default_rng(width).integers(1, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole when there are fewer; none without words."""
    n = min(width, len(hashes))
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    m = _multipliers(width)
    count = len(hashes) - n + 1
    out = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        out += hashes[k : k + count] * m[k]
    return mix(out)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For runs of texts: the number of the first, and each one's distinct shingles in order."""
    raw, where = text_bytes(texts)
    for first, past, part, starts in chunks(raw, where):
        words = Words(part, starts)
        yield (
            first,
            [np.unique(_shingles(words.hash[words.of[i] : words.of[i + 1]], width)) for i in range(past - first)],
        )
