"""Words of many UTF-8 texts at once, on the byte buffers that Arrow hands to a task."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time inside a task (a longer single text is handled alone).
CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes: digits, letters a-z after lower-casing A-Z, and every byte of a non-ASCII character.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: A word's hash sums, over its bytes, a mixture of the byte and its place: no factor is common to a place or a byte,
#: so regular words (of two letters, say) cannot cancel out.
_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
_PLACES = mix(np.arange(1, 1 + (1 << 12), dtype=np.uint64) * _M)


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[at:at + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; every text is in exactly one range, whole."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def give_back() -> None:
    """Return freed memory to the system: Python workers are kept and reused by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


class Words:
    """The words of some texts: lower-cased bytes, starts, ends, text numbers and 64-bit hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.low = _LOWER[raw]
        inside = _IN_WORD[self.low]
        edge = np.empty(len(raw) + 1, dtype=bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0] = edge[-1] = True
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[offsets] = True  # a text's end also ends a word
        edge |= cut
        at = np.flatnonzero(edge)
        first = at[:-1]
        keep = inside[first] if len(raw) else np.zeros(0, bool)
        self.start, self.end = first[keep], at[1:][keep]
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.texts = len(offsets) - 1
        self.counts = np.bincount(self.text, minlength=self.texts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.hash = self._hashes(inside)

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lengths = self.end - self.start
        at = np.flatnonzero(inside)
        place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        places, longest = _PLACES, int(lengths.max())
        if longest > len(places):
            places = mix(np.arange(1, longest + 1, dtype=np.uint64) * _M)
        values = (_BYTES[self.low[at]] ^ places[place]) * _M
        values ^= values >> np.uint64(32)
        sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
        return mix(sums + lengths.astype(np.uint64) * _M)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, texts) of all runs of ``k`` words; a text with fewer words, but not none, is one shingle."""
    h, t = words.hash, words.text
    if len(h) >= k:
        run = h[:len(h) - k + 1].copy()
        for j in range(1, k):
            run = run * _M + h[j:len(h) - k + 1 + j]
        same = t[:len(h) - k + 1] == t[k - 1:]
        run, at = mix(run[same]), t[:len(h) - k + 1][same]
    else:
        run, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if not len(short):
        return run, at
    extra = np.zeros(len(short), np.uint64)
    for i, d in enumerate(short):
        value = int(words.counts[d])
        for w in h[words.first[d]:words.first[d + 1]].tolist():
            value = (value * int(_M) + w) & (1 << 64) - 1
        extra[i] = value
    run, at = np.concatenate([run, mix(extra)]), np.concatenate([at, short])
    order = np.argsort(at, kind="stable")
    return run[order], at[order]


def word_texts(words: Words) -> list[bytes]:
    """Each text's words, lower-cased and with one blank between them."""
    n = len(words.low)
    size = words.end - words.start
    total = np.cumsum(size + 1)
    out = np.full(int(total[-1]) if len(total) else 0, 32, np.uint8)
    begin = total - size - 1
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + place] = words.low[np.repeat(words.start, size) + place] if n else 0
    ends = np.r_[0, total][words.first]
    data = out.tobytes()
    return [data[a:max(a, z - 1)] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
