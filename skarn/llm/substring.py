"""Substring dedup by relative Lempel-Ziv parsing against reference blocks.

The reference is the corpus itself, cut into blocks by content: a block holds the segments whose seed hashes into it.
A seed is the smallest hash of ``seed`` consecutive words in a window, so equal windows have equal seeds wherever they
stand, and a document meets exactly the blocks that can hold its windows instead of every block. A segment is the
longest run of windows with one seed. The index of a block holds each distinct segment once, with places where it
stands.

The parse of a document is greedy: a segment that the index holds is copied as a whole, and the factor goes on through
the next one for as long as that is copied from where the last copy stopped (``factors``). At the boundaries of
factors, where a segment's seed is known elsewhere but its content is not, each window is checked by itself against an
index of the windows there, one copy of each whole segment standing for all, and the factor is drawn out to the last
window found. Factors have at least ``window`` words each and are the duplicate spans. Together they cover exactly the
windows whose words also start anywhere else: two equal windows always share a seed, and a whole segment's copy holds a
copy of each of its windows. Hashes compared are 128 bits, seed and content.

Nulls: a null text has no words; rows with a null id are not parsed and lose nothing. A text shorter than a window
loses nothing. Texts of any length are parsed whole. Repeated documents lose every window, as each copy starts
elsewhere too; rows that share an id are rows of one document, each cut by the spans of all. Of several places to copy
from, the first by id and word is named. Empty tables give empty results; other columns, whatever their names, pass
through ``substring_dedup`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import _UNWORD, _WORD, BLACK, Words, blocks, column_bytes, mix, powers, rolling, run_starts
from .shared import fresh, quoted, written

SEGMENT = "seed long, content long, row long, start int, n int"
REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _leftmost(values: np.ndarray, width: int) -> np.ndarray:
    """For each position the leftmost smallest of ``width`` values from it on."""
    at, span = np.arange(len(values)), 1
    low = values
    while 2 * span <= width:
        left, right = low[: len(low) - span], low[span:]
        first = left <= right
        low, at = np.where(first, left, right), np.where(first, at[: len(at) - span], at[span:])
        span *= 2
    if span < width:
        step = width - span
        first = low[: len(low) - step] <= low[step:]
        at = np.where(first, at[: len(at) - step], at[step:])
    return at


def segments(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seed, content hash, text, first window (a word of the text) and number of windows of each segment."""
    hashed = words.hashes()
    start, text = run_starts(words.first, window)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    seeds = rolling(hashed, seed)
    chosen = _leftmost(seeds, window - seed + 1)[start]
    head = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]))))
    n = np.diff(np.append(head, len(start)))
    low, size = start[head], n + window - 1
    content = np.empty(len(head), np.uint64)
    step = 1 << 20
    for a in range(0, len(head), step):
        b = min(len(head), a + step)
        base = low[a]
        part = hashed[base : low[b - 1] + size[b - 1]]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * powers(_WORD, len(part))[: len(part)], dtype=np.uint64)))
        at = low[a:b] - base
        content[a:b] = (total[at + size[a:b]] - total[at]) * powers(_UNWORD, len(part) + 1)[at]
    content = mix(content + size.astype(np.uint64))
    return seeds[chosen[head]].view(np.int64), content.view(np.int64), text[head], low - words.first[text[head]], n


def _spans(n_words: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    steps = np.zeros(n_words + 1, dtype=np.int64)
    starts = np.minimum(starts, n_words)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + sizes, n_words), -1)
    return np.cumsum(steps)[:-1] > 0


def duplicate_spans(rows: DataFrame, window: int = 35, seed: int = 12) -> DataFrame:
    """(row, starts, sizes, ref_rows, ref_starts): for rows (row, text) the factors copied from elsewhere, each of at least
    ``window`` words: where it starts, its words, and a place that it is copied from. Rows without any are left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in blocks(offsets):
                seeds, content, text, start, n = segments(Words(data, offsets[a : b + 1], BLACK), window, seed)
                yield pa.RecordBatch.from_arrays([pa.array(seeds), pa.array(content), pa.array(ids[a + text]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["seed", "content", "row", "start", "n"])

    every = written(rows.where("row is not null").mapInArrow(cut, SEGMENT), "segments")
    # written, so that a hot seed's rows on the other side of the join can be split
    known = written(every.groupBy("seed").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("seed"), "seeds")
    met = written(every.join(known, "seed"), "segments-met")
    # the index of the reference blocks: each distinct segment once, with two of its places; written, so that no
    # aggregate stands between an exchange and the join that can split a hot segment
    copies = written(met.groupBy("seed", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "start", "n")).alias("ref"), F.max(F.struct("row", "start")).alias("last")), "reference")
    found = met.join(copies, ["seed", "content"])
    parsed = written(found.select("seed", "row", "start", "n", "copies", *_elsewhere("ref", "last", "start")), "segments-parsed")
    edge = parsed.where("copies = 1").select("row", "seed", "start", "n", F.lit(1).alias("weight"))
    # at a factor's end, one copy of each whole segment stands for all of them
    refs = copies.where("copies > 1").join(edge.select("seed").distinct(), "seed", "left_semi").select("ref.row", "seed", "ref.start", "ref.n", F.lit(2).alias("weight"))
    todo = edge.union(refs).groupBy("row").agg(F.collect_list(F.struct("seed", "start", "n", "weight")).alias("todo"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            seeds, starts, counts, weights = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            for a, b in blocks(offsets):
                words = Words(data, offsets[a : b + 1], BLACK)
                runs = rolling(words.hashes(), window)
                which = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                part = slice(ends[a], ends[b])
                n = counts[part]
                many = np.repeat(np.arange(len(n)), n)
                at = starts[part][many] + np.arange(len(many)) - np.repeat(np.cumsum(n) - n, n)
                place = words.first[which[many]] + at
                fits = place + window <= words.first[which[many] + 1]
                many, at, place = many[fits], at[fits], place[fits]
                yield pa.RecordBatch.from_arrays([pa.array(seeds[part][many]), pa.array(runs[place].view(np.int64)), pa.array(ids[a:b][which[many]]), pa.array(at.astype(np.int32)), pa.array(weights[part][many].astype(np.int32))], names=["seed", "hash", "row", "at", "weight"])

    checked = written(rows.join(todo, "row").select("row", "text", "todo").mapInArrow(windows, "seed long, hash long, row long, at int, weight int"), "windows")
    again = written(checked.groupBy("seed", "hash").agg(F.sum("weight").alias("w"), F.min(F.struct("row", "at")).alias("ref"), F.max(F.struct("row", "at")).alias("last")).where("w > 1"), "reference-windows")
    single = checked.where("weight = 1").join(again, ["seed", "hash"]).select("row", F.col("at").alias("start"), F.lit(window).alias("size"), *_elsewhere("ref", "last", "at"))
    whole = parsed.where("copies > 1").select("row", "start", (F.col("n") + F.lit(window - 1)).alias("size"), "ref_row", "ref_start")
    pieces = whole.union(single).groupBy("row").agg(F.collect_list(F.struct("start", "size", "ref_row", "ref_start")).alias("pieces"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends, fields = lists.offsets.to_numpy(), [lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
            out = [factors(*(f[a:b] for f in fields), window) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            offsets = np.concatenate(([0], np.cumsum([len(x[0]) for x in out]))).astype(np.int32)
            values = [np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in range(4)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(t.to_pandas_dtype()))) for v, t in zip(values, kinds, strict=True))], names=["row", "starts", "sizes", "ref_rows", "ref_starts"])

    return pieces.mapInArrow(parse, "row long, starts array<int>, sizes array<int>, ref_rows array<long>, ref_starts array<int>")


def _elsewhere(first: str, last: str, start: str) -> list[Column]:
    """The first place in the reference; for what stands there itself, the last."""
    here = (F.col(f"{first}.row") == F.col("row")) & (F.col(f"{first}.{start}") == F.col(start))
    return [F.when(here, F.col(f"{last}.{name}")).otherwise(F.col(f"{first}.{name}")).alias(alias) for name, alias in (("row", "ref_row"), (start, "ref_start"))]


def factors(start: np.ndarray, size: np.ndarray, ref_row: np.ndarray, ref_start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The greedy parse of one text: copied pieces, in order, are one factor for as long as each goes on where the copy
    before it stopped, in the same reference text; where one does not, the factor ends and the next begins."""
    order = np.lexsort((size, start))
    start, size, ref_row, ref_start = (x[order].astype(np.int64) for x in (start, size, ref_row, ref_start))
    end = np.maximum.accumulate(start + size)
    # the windows of a factor are adjacent: the next piece begins at most one word after the last window before it
    on = (ref_row[1:] == ref_row[:-1]) & (ref_start[1:] - start[1:] == ref_start[:-1] - start[:-1]) & (start[1:] <= end[:-1] - window + 1)
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(start)), bool), ~on)))
    return start[head], (np.maximum.reduceat(start + size, head) - start[head] if len(head) else head), ref_row[head], ref_start[head]


def _cut(text: pa.Array, starts: pa.Array, sizes: pa.Array) -> Iterator[tuple[int, Words, np.ndarray]]:
    """(index, words, index of the text in them) of each text, and which of its words go."""
    data, offsets = column_bytes(text)
    for a, b in blocks(offsets):
        words = Words(data, offsets[a : b + 1], BLACK)
        for k in range(a, b):
            n = int(words.first[k - a + 1] - words.first[k - a])
            gone = np.zeros(n, dtype=bool)
            if starts[k].is_valid:
                gone = _spans(n, starts[k].values.to_numpy(), sizes[k].values.to_numpy())
            yield k, words, gone, k - a


def _joined(docs: DataFrame, key: str, text: str, window: int, seed: int) -> DataFrame:
    rows = docs.select(F.col(quoted(key)).cast("long").alias("row"), F.col(quoted(text)).cast("string").alias("text"))
    return rows.join(duplicate_spans(rows, window, seed), "row", "left").select("row", "text", "starts", "sizes")


def substring_report(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, seed: int = 12) -> DataFrame:
    """Per document its words, the words removed, and the SHA-256 of the kept words joined by spaces."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, sums = [], [], []
            for _, words, gone, k in _cut(*batch.columns[1:]):
                low, high = words.first[k : k + 2]
                total.append(len(gone))
                removed.append(int(gone.sum()))
                raw = words.data
                pairs = zip(words.start[low:high][~gone].tolist(), words.end[low:high][~gone].tolist(), strict=True)
                view = raw.tobytes() if len(words.first) == 2 else raw[words.offsets[k] : words.offsets[k + 1]].tobytes()
                base = 0 if len(words.first) == 2 else int(words.offsets[k])
                sums.append(hashlib.sha256(b" ".join([view[x - base : y - base] for x, y in pairs])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _joined(docs, key, text, window, seed).mapInArrow(digest, REPORT)


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, seed: int = 12) -> DataFrame:
    """The documents with the words of duplicate spans cut out, and the white space of the kept text as it was."""
    row, starts, sizes, mine = fresh(docs.columns, "row", "starts", "sizes", "mine")
    spans = duplicate_spans(docs.select(F.col(quoted(key)).cast("long").alias("row"), F.col(quoted(text)).cast("string").alias("text")), window, seed)
    spans = spans.select(F.col("row").alias(row), F.col("starts").alias(starts), F.col("sizes").alias(sizes))
    joined = docs.withColumn(mine, F.col(quoted(key)).cast("long")).join(spans, F.col(mine) == F.col(row), "left").drop(row, mine)
    at = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, words, gone, k in _cut(batch.column(at), *batch.columns[-2:]):
                if gone.any():
                    keep = np.ones(words.offsets[k + 1] - words.offsets[k], dtype=bool)
                    low, base = words.first[k], words.offsets[k]
                    edges = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
                        keep[words.start[low + a] - base : words.end[low + b - 1] - base] = False
                    texts[i] = words.data[base : words.offsets[k + 1]][keep].tobytes().decode()
            yield pa.RecordBatch.from_arrays([*(c if k != at else pa.array(texts, batch.schema.types[at]) for k, c in enumerate(batch.columns[:-2]))], names=batch.schema.names[:-2])

    return joined.mapInArrow(cut, docs.schema)
