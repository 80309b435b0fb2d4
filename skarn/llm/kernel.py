"""Words, hashes and shingles of whole texts, a block of bytes at a time.

All of it works on the UTF-8 bytes of an Arrow column. A text is never cut: a block ends between texts, and a text
longer than a block is a block of its own, hashed in pieces that end between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes in a block; with one more value, its tables have a power of two of entries.
BLOCK = (1 << 20) - 1
#: What tasks of another kind may have left in this process, which Spark uses again: dropped when blocks are next cut.
HELD: list[dict] = []
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = np.asarray(x, dtype=_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 0x632BE59BD9B4E019 % 2**64))


_BYTE = stream(1, 256)
_BASE = 0x9E3779B97F4A7C15 | 5
_UNBASE = pow(_BASE, -1, 2**64)
_WORD = 0xD6E8FEB86659FD93
_UNWORD = pow(_WORD, -1, 2**64)
_TABLES: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; at least n of them."""
    have = _TABLES.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, dtype=_U)
        have[0] = 1
        _TABLES[base] = have = np.multiply.accumulate(have)
    return have


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which byte values lie in one of the (inclusive) ranges."""
    found = np.zeros(256, dtype=bool)
    for low, high in ranges:
        found[low : high + 1] = True
    return found


#: Word bytes of `[^\x20\x09-\x0D]+`, and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z is lower case.
BLACK = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and the n + 1 offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", dtype=np.uint8), at.astype(np.int64)


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs [low, high) of texts with at most ``size`` bytes, or of one longer text."""
    for memory in HELD:
        memory.clear()
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1)
        yield low, high
        low = high


class Words:
    """The words of a run of texts: byte positions ``start`` and ``end``; text i has words first[i] to first[i+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = False):
        self.data = data[offsets[0] : offsets[-1]]
        if lower:
            self.data = LOWER[self.data]
        self.offsets = offsets - offsets[0]
        n = len(self.data)
        inside = is_word[self.data]
        fresh, last = inside.copy(), inside.copy()
        fresh[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        heads = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        if n:
            fresh[heads] = inside[heads]
            tails = np.append(heads[1:], n) - 1
            last[tails] = inside[tails]
        self.start = np.flatnonzero(fresh)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.start), dtype=_U)
        low = 0
        while low < len(out):
            base = self.start[low]
            high = max(low + 1, int(np.searchsorted(self.end, base + BLOCK, side="right")))
            piece = self.data[base : self.end[high - 1]]
            table = powers(_BASE, len(piece) + 1)
            total = np.zeros(len(piece) + 1, dtype=_U)
            np.cumsum(_BYTE[piece] * table[: len(piece)], out=total[1:])
            a, b = self.start[low:high] - base, self.end[low:high] - base
            out[low:high] = (total[b] - total[a]) * powers(_UNBASE, len(piece) + 1)[a] + _BYTE[(b - a) & 255]
            low = high
        return mix(out)

    def text(self, low: int, high: int) -> bytes:
        """The words low to high - 1, joined by one space."""
        data = self.data
        return b" ".join(data[a:b].tobytes() for a, b in zip(self.start[low:high], self.end[low:high], strict=True))


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive word hashes; it depends on those n words alone."""
    if len(words) < n:
        return np.zeros(0, dtype=_U)
    if n <= 8:
        table = powers(_WORD, n)
        total = words[: len(words) - n + 1] * table[0]
        for k in range(1, n):
            total = total + words[k : len(words) - n + 1 + k] * table[k]
        return mix(total)
    out = np.empty(len(words) - n + 1, dtype=_U)
    for low in range(0, len(out), BLOCK):
        high = min(len(out), low + BLOCK)
        piece = words[low : high + n - 1]
        total = np.zeros(len(piece) + 1, dtype=_U)
        np.cumsum(piece * powers(_WORD, len(piece))[: len(piece)], out=total[1:])
        out[low:high] = (total[n:] - total[:-n]) * powers(_UNWORD, len(out) + 1)[: high - low]
    return mix(out)


def run_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the n-word runs that lie within one text, and the text of each."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    text = np.repeat(np.arange(len(counts)), counts)
    ahead = np.cumsum(counts) - counts
    return np.arange(len(text)) - ahead[text] + first[:-1][text], text


def shingle_sets(words: Words, n: int = 5) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct n-word shingles; of all its words as one if it has fewer."""
    hashed = words.hashes()
    runs = rolling(hashed, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(runs[a : b - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(rolling(hashed[a:b], b - a) ^ _U(b - a))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out
