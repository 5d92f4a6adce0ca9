"""Words, word hashes and window hashes of a column of texts, computed on whole arrays.

Texts are read as UTF-8 bytes. A word is a maximal run of bytes that a 256-entry table admits, so
both white-space splitting and "letters and digits" splitting need no regular expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Two odd multipliers for each kind of polynomial hash; two independent hashes give 128 bits.
WORD_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Words longer than this many bytes are hashed one at a time, so that one giant word needs no tables.
LONG_WORD = 1 << 16
#: Bytes hashed at a time.
SLICE = 1 << 22


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: ``[^\x20\x09-\x0D]+``
NOT_BLANK = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer: every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """The words of a column: ``doc`` is the row of each word, ``first[r]:first[r + 1]`` are row r's words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        """64-bit hash of every word."""
        base = WORD_BASES[which]
        length = self.end - self.start
        out = np.empty(len(self), dtype=U64)
        if not len(self):
            return out
        cuts = np.searchsorted(self.start, np.arange(0, int(self.start[-1]) + 1, SLICE))
        cuts = np.unique(np.append(cuts, len(self)))
        with np.errstate(over="ignore"):
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                size = length[a:b].copy()
                huge = np.flatnonzero(size > LONG_WORD)
                size[huge] = 1
                offset = np.cumsum(size) - size
                within = np.arange(int(size.sum())) - np.repeat(offset, size)
                power = np.multiply.accumulate(np.full(int(size.max()), base, dtype=U64))
                letters = self.data[np.repeat(self.start[a:b], size) + within].astype(U64) + U64(1)
                h = np.add.reduceat(letters * power[within], offset)
                h = mix(h + size.astype(U64) * U64(0x2545F4914F6CDD1D))
                for i in huge:
                    word = self.data[self.start[a + i] : self.end[a + i]].tobytes()
                    h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=bytes([which])).digest(), "little")
                out[a:b] = h
        return out

    def position(self) -> np.ndarray:
        """Place of every word inside its own text."""
        return np.arange(len(self)) - self.first[self.doc]

    def whole(self, size: int) -> np.ndarray:
        """Starts of the windows of ``size`` words that lie inside one text."""
        n = len(self) - size + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])


def words(texts: pa.ChunkedArray | pa.Array, table: np.ndarray = NOT_BLANK, lower: bool = False) -> Words:
    """Split every text of a column; a null text has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.cast(pa.large_string()).chunks or [pa.array([], pa.large_string())])
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and buffer.size else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    inside = table[data]
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begin[edges] = inside[edges]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, start, end, doc, first)


def window_hashes(word: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive entries of ``word``."""
    n = len(word) - size + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    acc, base = np.zeros(n, dtype=U64), U64(WINDOW_BASES[which])
    with np.errstate(over="ignore"):
        for i in range(size):
            acc *= base
            acc += word[i : n + i]
    return mix(acc)


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words that begins at one of ``starts``."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + size, n), -1)
    return np.cumsum(step[:-1]) > 0
