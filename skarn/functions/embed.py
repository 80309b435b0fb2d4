"""Text embedding: a hash embedder as the default, and a hook for any other model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the two hashes.
_SEED, _PRIME, _SEED2, _PRIME2, _MASK = 0x811C9DC5, 0x01000193, 0x55555555, 0x5BD1E995, 0xFFFFFFFF
#: Letters, digits and the low line, in bytes of lower-case UTF-8: anything else separates words.
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), 95, *range(97, 123)]] = True
#: Texts that are embedded at once, and letters of a word hashed for all words at once; few words are longer.
_ROWS, _LETTERS = 1024, 48


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both 32-bit hashes of each word, a letter of all words at a time."""
    one, two = np.full(len(start), _SEED, np.uint64), np.full(len(start), _SEED2, np.uint64)
    u, mask = np.uint64, np.uint64(_MASK)
    at = np.arange(len(start))
    for k in range(min(int(size.max(initial=0)), _LETTERS)):
        at = at[size[at] > k]
        letter = data[start[at] + k].astype(u)
        one[at] = (one[at] ^ letter) * u(_PRIME) & mask
        two[at] = (two[at] ^ letter << u(3)) * u(_PRIME2) & mask
    for w in np.flatnonzero(size > _LETTERS).tolist():
        a, b = int(one[w]), int(two[w])
        for c in data[start[w] + _LETTERS : start[w] + size[w]].tolist():
            a, b = (a ^ c) * _PRIME & _MASK, (b ^ c << 3) * _PRIME2 & _MASK
        one[w], two[w] = a, b
    return one.astype(np.int64), two.astype(np.int64)


def hash_embeddings(texts: list[str | None], dim: int = 384) -> np.ndarray:
    """A row per text. Each word adds to up to three places, by two hashes and the length of the word before; unit length.
    A text without a word is the zero vector. Words are ASCII: anything else separates."""
    low = [(t or "").lower() for t in texts]
    data = np.frombuffer("".join(f"{t}\n" for t in low).encode(), dtype=np.uint8)
    ends = np.cumsum(pc.binary_length(pa.array(low, pa.large_string())).to_numpy() + 1) if low else np.zeros(0, np.int64)
    # each text ends with a line break, so no word crosses into the next
    inside = np.concatenate(([False], _WORD[data]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edges[::2], edges[1::2]
    text = np.searchsorted(ends, start, side="right")
    order = np.arange(len(start)) - np.searchsorted(text, text)
    size = stop - start
    one, two = _hashes(data, start, size)
    later = np.flatnonzero(order > 0)
    pairs = one[later] ^ (31 * size[later - 1])
    weight = 1 / np.sqrt(order + 1.0)
    places = np.concatenate((one, two, pairs))
    # a 32-bit value counts by its magnitude as a signed one
    places = np.where(places < 1 << 31, places, (1 << 32) - places) % dim
    rows = np.concatenate((text, text, text[later]))
    v = np.bincount(rows * dim + places, np.concatenate((weight, 0.7 * weight, 0.5 * weight[later])), len(low) * dim).astype(float).reshape(len(low), dim)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def hash_embedding(text: str | None, dim: int = 384) -> np.ndarray:
    return hash_embeddings([text], dim)[0]


def embedder(model: Callable[[str | None], np.ndarray] | None = None, dim: int = 384, kind: str = "float", fallback: bool = True) -> Callable[[Column], Column]:
    """A function from a text column to an array column of ``kind``, a batch at a time. ``model`` takes one text; where it
    fails, the hash embedding of that text stands in, unless ``fallback`` is False."""
    dtype = {"float": np.float32, "double": np.float64}[kind]

    def one(text: str | None) -> np.ndarray:
        try:
            return np.asarray(model(text), dtype=dtype)
        except Exception:  # noqa: BLE001  whatever a model raises
            if not fallback:
                raise
            return hash_embedding(text, dim).astype(dtype)

    @F.arrow_udf(f"array<{kind}>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, parts = batch.to_pylist(), []
            for low in range(0, len(texts), _ROWS):
                some = texts[low : low + _ROWS]
                rows = hash_embeddings(some, dim).astype(dtype) if model is None else np.stack([one(t) for t in some])
                offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
                parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel())))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.from_numpy_dtype(dtype)))

    return embed
