"""Benchmark decontamination: a broadcast set of the items' word windows, scanned for in every document.

Words are runs of ``ALNUM`` bytes after A-Z are lower case. A window is ``n`` consecutive words of an item, or a whole
shorter item. A hash that a document shares with the set is checked word for word. At most ``max_windows`` windows are
broadcast at once, counted first, as sorted arrays of about 20 bytes a window beside the texts; a larger set of items is
dealt into blocks by hash and the documents pass them in turn, written in between, so a task holds one block at a time
and its memory has a bound that does not depend on the number of items or documents. An item is not cut: the largest
one must fit in a task as well.

Nulls: a null text or item has no words and no hits. Empty tables give no hits, or no rows. Texts of any length are
scanned whole. Repeated items count once per distinct id; repeated documents are each judged. ``decontaminate`` passes
any other columns, whatever their names, through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import ALNUM, Words, blocks, column_bytes, rolling
from .shared import fresh, quoted, written

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WindowSet:
    """Windows of one block of items, by their length in words: sorted hashes, and for each the place of its words and its
    item, about 20 bytes a window beside the items' texts. Made once, on the driver, and broadcast."""

    def __init__(self, rows: list[tuple[str, str | None]], n: int):
        data, offsets = column_bytes(pa.array([t for _, t in rows], pa.large_string()))
        words = Words(data, offsets, ALNUM, lower=True)
        hashed = words.hashes()
        self.names = np.array([i for i, _ in rows], dtype=object)
        self.data, self.start, self.end = words.data, words.start.astype(np.uint32), words.end.astype(np.uint32)
        count = np.diff(words.first)
        self.by_size = {}
        for size in np.unique(np.minimum(count, n)).tolist():
            if not size:
                continue
            own = np.flatnonzero(count == size) if size < n else np.flatnonzero(count >= n)
            many = count[own] - size + 1
            at = np.repeat(words.first[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            keys, item = rolling(hashed, size)[at], np.repeat(own, many).astype(np.uint32)
            order = np.lexsort((item, keys))
            keys, item, at = keys[order], item[order], at[order].astype(np.uint32)
            # a window that an item has twice counts once
            once = np.concatenate((np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (item[1:] != item[:-1])))
            keys, item, at = keys[once], item[once], at[once]
            seen = np.zeros(1 << min(24, max(16, int(8 * len(keys)).bit_length())), dtype=bool)
            seen[keys & np.uint64(len(seen) - 1)] = True
            self.by_size[size] = (seen, keys, item, at)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.data, self.start, self.end, self.names)) + sum(x.nbytes for arrays in self.by_size.values() for x in arrays)

    def text(self, low: int, high: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[low:high], self.end[low:high], strict=True))

    def hits(self, words: Words) -> list[tuple[int, int, int, set[str]]]:
        """(text, first word, words, items) of each occurrence of a window, its words compared."""
        out = []
        hashed = words.hashes()
        for size, (seen, keys, item, at) in self.by_size.items():
            runs = rolling(hashed, size)
            near = np.flatnonzero(seen[runs & np.uint64(len(seen) - 1)])
            low = np.searchsorted(keys, runs[near])
            high = np.searchsorted(keys, runs[near], side="right")
            text = np.searchsorted(words.first, near, side="right") - 1
            inside = (low < high) & (near + size <= words.first[text + 1])
            for k, t, a, b in zip(near[inside].tolist(), text[inside].tolist(), low[inside].tolist(), high[inside].tolist(), strict=True):
                own = words.text(k, k + size)
                items = {self.names[item[x]] for x in range(a, b) if self.text(at[x], at[x] + size) == own}
                if items:
                    out.append((t, k, size, items))
        return out


def _item_blocks(items: DataFrame, n: int, item: str, text: str, max_windows: int) -> Iterator[list[tuple[str, str | None]]]:
    rows = items.select(F.col(quoted(item)).cast("string").alias("i"), F.col(quoted(text)).cast("string").alias("t")).where("i is not null")
    # a window starts at a word, and words are two bytes apart at least
    most = rows.agg(F.sum(F.floor(F.octet_length("t") / 2) + 1)).first()[0] or 0
    count = max(1, -(-int(most) // max_windows))
    for k in range(count):
        block = rows if count == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k)
        yield [(r.i, r.t) for r in block.toLocalIterator()]


def _annotated(docs: DataFrame, text: str, items: DataFrame, n: int, item: str, item_text: str, max_windows: int) -> DataFrame:
    """``docs`` with two more columns: spans (bytes: pairs of first word and end) and items (strings)."""
    spans, names = fresh(docs.columns, "spans", "items")
    at, shared = docs.columns.index(text), None
    rows = docs.withColumn(spans, F.lit(b"")).withColumn(names, F.array().cast("array<string>"))
    for block in _item_blocks(items, n, item, item_text, max_windows):
        if shared is not None:
            # what one block found is written, so that a task holds one block at a time
            rows = written(rows, "annotated")
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(WindowSet(block, n))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for batch in batches:
                data, offsets = column_bytes(batch.column(at))
                had_spans, had_items = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                for low, high in blocks(offsets):
                    words = Words(data, offsets[low : high + 1], ALNUM, lower=True)
                    more: dict[int, tuple[list[int], set[str]]] = {}
                    for t, k, size, found in windows.hits(words):
                        pairs, ids = more.setdefault(t, ([], set()))
                        first = int(words.first[t])
                        pairs += [k - first, k - first + size]
                        ids |= found
                    for t, (pairs, ids) in more.items():
                        had_spans[low + t] += np.array(pairs, dtype="<i8").tobytes()
                        had_items[low + t] = sorted({*had_items[low + t], *ids})
                columns = [*batch.columns[:-2], pa.array(had_spans, batch.schema.types[-2]), pa.array(had_items, batch.schema.types[-1])]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        rows = rows.mapInArrow(scan, rows.schema)
    return rows


def covered(spans: bytes, n_words: int) -> np.ndarray:
    """Which of the words lie in any span."""
    pairs = np.frombuffer(spans, dtype="<i8").reshape(-1, 2)
    steps = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(steps, pairs[:, 0], 1)
    np.add.at(steps, pairs[:, 1], -1)
    return np.cumsum(steps)[:-1] > 0


def contamination_report(docs: DataFrame, items: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", max_windows: int = 2_000_000) -> DataFrame:
    """Per document its words, the words hit, and the items found in it."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            counts = np.concatenate([np.zeros(0, np.int64), *(np.diff(Words(data, offsets[a : b + 1], ALNUM, lower=True).first) for a, b in blocks(offsets))])
            ids = batch.column(3).to_pylist()
            hit = [int(covered(s, int(c)).sum()) if s else 0 for s, c in zip(batch.column(2).to_pylist(), counts, strict=True)]
            sums = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(sums, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    rows = docs.select(F.col(quoted(key)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    return _annotated(rows, "text", items, n, item, item_text, max_windows).mapInArrow(digest, REPORT)


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "documents", n: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", max_windows: int = 2_000_000) -> DataFrame:
    """The documents without those that hold a window (``documents``), or with the covered words cut out (``spans``)."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is 'documents' or 'spans', not {mode!r}")
    rows = _annotated(docs, text, items, n, item, item_text, max_windows)
    spans, at = rows.columns[-2], docs.columns.index(text)
    if mode == "documents":
        return rows.where(F.octet_length(quoted(spans)) == 0).select(*map(quoted, docs.columns))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for k, s in enumerate(found):
                if s:
                    data, offsets = column_bytes(pa.array([texts[k]], pa.string()))
                    words = Words(data, offsets, ALNUM, lower=True)
                    gone = covered(s, len(words.start))
                    keep = np.ones(len(data), dtype=bool)
                    edges = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
                        keep[words.start[a] : words.end[b - 1]] = False
                    texts[k] = data[keep].tobytes().decode()
            yield pa.RecordBatch.from_arrays([c if k != at else pa.array(texts, batch.schema.types[at]) for k, c in enumerate(batch.columns[:-1])], names=batch.schema.names[:-1])

    return rows.select(*map(quoted, docs.columns), quoted(spans)).mapInArrow(cut, docs.schema)
