"""Best-fit packing of tokenised documents by a linear grouping scheme.

Documents longer than a sequence are cut into pieces. The plan needs only how many pieces have each length: at most
``capacity`` numbers, whatever the size of the corpus, so the driver makes it. Large lengths, in descending order, form
groups of equal cardinality and are rounded up to the largest of their group; for these few sizes the linear programme
over configurations (what one sequence may hold) is solved by column generation, its solution rounded down. Actual
lengths then take the places of the rounded ones, all but the smallest of a configuration, and what is left, large and
small, goes best-fit, longest first. The pieces of sequences that are then not full go best-fit once more. Plans by
several numbers of groups and borders of what is small are made, one without groups among them, and the smallest wins.

The plan is a list of patterns (the lengths in a sequence, and how many sequences look so). A piece finds its place by
its rank among the pieces of its length: a rank within its task, counted while tokenising, plus the counts of the tasks
before. No text is shuffled, and no group of pieces meets in a task.

Nulls: a null text is an empty one (just the end id). Texts of any length are encoded whole. Repeated rows and ids are
packed each; pieces of equal length take places in the order of their ranks. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import encoder, little_endian_u32
from .shared import quoted, written

Pattern = tuple[tuple[int, ...], int]


def grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count), longest first, cut into at most ``groups`` groups of equal cardinality."""
    total = int(counts.sum())
    edges = [total * k // groups for k in range(groups + 1)]
    out, at, k = [[]], 0, 1
    for length, count in zip(lengths[::-1].tolist(), counts[::-1].tolist(), strict=True):
        while count:
            while at >= edges[k]:
                k += 1
                out.append([])
            part = min(count, edges[k] - at)
            out[-1].append((length, part))
            at, count = at + part, count - part
    return [g for g in out if g]


def _best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for g, (size, value) in enumerate(zip(sizes, worth.tolist(), strict=True)):
        if value > 1e-12:
            for _ in range(capacity // size):
                more = best[:-size] + value
                gain = more > best[size:] + 1e-12
                if not gain.any():
                    break
                best[size:] = np.where(gain, more, best[size:])
                last[size:] = np.where(gain, g, last[size:])
    taken, room = np.zeros(len(sizes)), capacity
    while room > 0 and last[room] >= 0:
        taken[last[room]] += 1
        room -= sizes[last[room]]
    return float(taken @ worth), taken


def configurations(sizes: list[int], need: np.ndarray, capacity: int, gap: float = 1e-3, stall: int = 60) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, within ``gap`` of the optimum of the linear programme, or as it is
    when ``stall`` columns in a row have not lowered its objective by a tenth of ``gap``."""
    n = len(sizes)
    columns = np.diag([float(capacity // s) for s in sizes])
    inverse, used = np.diag(1 / np.diag(columns)), need / np.diag(columns)
    best, since = np.inf, 0
    while since < stall:
        if used.sum() < best * (1 - gap / 10):
            best, since = used.sum(), 0
        since += 1
        worth = np.maximum(inverse.sum(axis=0), 0)
        value, taken = _best_configuration(sizes, worth, capacity)
        if value <= 1 + gap:
            break
        step = inverse @ taken
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        used = np.maximum(used - ratio[out] * step, 0)
        used[out] = ratio[out]
        columns[:, out] = taken
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    return [(columns[:, k], used[k]) for k in range(n)]


class _Open:
    """Sequences still open, as patterns by the room left in them."""

    def __init__(self, capacity: int):
        self.by_room: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
        self.capacity = capacity
        self.has = np.zeros(capacity + 1, dtype=bool)

    def add(self, pattern: tuple[int, ...], count: int) -> None:
        room = self.capacity - sum(pattern)
        self.by_room[room].append((pattern, count))
        self.has[room] = True

    def best_fit(self, length: int, count: int) -> None:
        while count:
            fits = self.has[length:]
            room = length + int(np.argmax(fits))
            if not fits.any():
                each = self.capacity // length
                if count >= each:
                    self.add((length,) * each, count // each)
                if count % each:
                    self.add((length,) * (count % each), 1)
                return
            pattern, have = self.by_room[room].pop()
            part = min(have, count)
            if part < have:
                self.by_room[room].append((pattern, have - part))
            self.has[room] = bool(self.by_room[room])
            self.add((*pattern, length), part)
            count -= part

    def patterns(self) -> list[Pattern]:
        merged: dict[tuple[int, ...], int] = {}
        for patterns in self.by_room:
            for pattern, count in patterns:
                pattern = tuple(sorted(pattern, reverse=True))
                merged[pattern] = merged.get(pattern, 0) + count
        return list(merged.items())


#: (groups, small) of the plans that are made; without groups all pieces go best-fit, longest first.
SCHEMES = ((64, 1 / 4), (128, 1 / 10), (200, 1 / 5), (200, 1 / 10), (0, 1.0))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: for each length up to half, pieces too long to share a sequence with one of it
    have one each, those over half of the capacity have one each too, and the rest must fit their room."""
    lengths = np.array(sorted(counts), dtype=np.int64)
    many = np.array([counts[int(x)] for x in lengths], dtype=np.int64)
    best = -(-int((lengths * many).sum()) // capacity)
    for k in [0, *lengths[lengths <= capacity // 2].tolist()]:
        alone, half = lengths > capacity - k, lengths > capacity / 2
        upper, rest = half & ~alone, (lengths >= k) & ~half
        room = int(many[upper].sum()) * capacity - int((lengths * many)[upper].sum())
        best = max(best, int(many[half].sum()) + max(0, -(-(int((lengths * many)[rest].sum()) - room) // capacity)))
    return best


def packing_plan(counts: dict[int, int], capacity: int, schemes: tuple[tuple[int, float], ...] = SCHEMES) -> list[Pattern]:
    """Patterns that hold exactly ``counts`` pieces of each length: the smallest of the plans by each scheme, so never
    more sequences than best-fit with the longest first."""
    return min((_plan(counts, capacity, groups, small) for groups, small in schemes), key=lambda plan: sum(count for _, count in plan))


def _plan(counts: dict[int, int], capacity: int, groups: int, small: float) -> list[Pattern]:
    """A plan by up to ``groups`` groups of lengths over ``small`` of the capacity."""
    open_ = _Open(capacity)
    lengths = np.array(sorted(x for x in counts if small * capacity < x < capacity), dtype=np.int64)
    many = np.array([counts[int(x)] for x in lengths], dtype=np.int64)
    rest = {x: c for x, c in counts.items() if x <= small * capacity}
    if counts.get(capacity):
        open_.add((capacity,), counts[capacity])
    if len(lengths) and groups:
        runs = grouped(lengths, many, groups)
        sizes = [g[0][0] for g in runs]
        for taken, used in configurations(sizes, np.array([float(sum(c for _, c in g)) for g in runs]), capacity):
            places = [g for g in np.flatnonzero(taken) for _ in range(int(taken[g]))]
            # the smallest place stays open: best-fit finds it the length that fills the sequence
            places = places[: max(1, len(places) - 1)]
            left = int(used + 1e-6)
            while left and places:
                # one place after another takes actual lengths of its group; a step lasts while none of them changes
                taken_now: list[tuple[list[tuple[int, int]], int]] = []
                step = left
                share = {g: places.count(g) for g in set(places)}
                for g, times in share.items():
                    step = min(step, runs[g][0][1] // times if runs[g] else 0)
                if step == 0:
                    # fewer of a length are left than a sequence has places for: one sequence of mixed lengths
                    if any(sum(c for _, c in runs[g]) < times for g, times in share.items()):
                        break
                    step = 1
                pattern = []
                for g, times in share.items():
                    want = step * times
                    if runs[g][0][1] >= want:
                        pattern += [runs[g][0][0]] * times
                        taken_now.append((runs[g], want))
                    else:
                        for _ in range(want):
                            pattern.append(runs[g][0][0])
                            runs[g][0] = (runs[g][0][0], runs[g][0][1] - 1)
                            if not runs[g][0][1]:
                                runs[g].pop(0)
                for run, want in taken_now:
                    run[0] = (run[0][0], run[0][1] - want)
                    if not run[0][1]:
                        run.pop(0)
                open_.add(tuple(pattern), step)
                left -= step
        for group in runs:
            for length, count in group:
                rest[length] = rest.get(length, 0) + count
    for length in sorted(rest, reverse=True):
        open_.best_fit(length, rest[length])
    first = open_.patterns()
    # rounding leaves some sequences a little room that no piece fits: open these again, with the exact lengths
    again, loose = _Open(capacity), {}
    for pattern, count in first:
        if sum(pattern) == capacity:
            again.add(pattern, count)
        else:
            for length in pattern:
                loose[length] = loose.get(length, 0) + count
    for length in sorted(loose, reverse=True):
        again.best_fit(length, loose[length])
    return min(first, again.patterns(), key=lambda plan: sum(count for _, count in plan))


class Places:
    """Where the piece with a given rank among those of its length goes."""

    RANK = 48

    def __init__(self, plan: list[Pattern]):
        used: dict[int, int] = {}
        keys, sequence, offset = [], [], []
        first = 0
        for pattern, count in sorted(plan):
            at = 0
            for length in pattern:
                keys.append(length << self.RANK | used.get(length, 0))
                used[length] = used.get(length, 0) + count
                sequence.append(first)
                offset.append(at)
                at += length
            first += count
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.sequence, self.offset = np.array(sequence, dtype=np.int64)[order], np.array(offset, dtype=np.int64)[order]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << self.RANK) | rank
        k = np.searchsorted(self.keys, key, side="right") - 1
        return self.sequence[k] + key - self.keys[k], self.offset[k]


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", schemes: tuple[tuple[int, float], ...] = SCHEMES, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece; ``with_ids``: and its ids, binary."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        names = ["part", "doc_id", "piece", "start", "length", "ids_crc32", "rank"] + ["ids"] * with_ids
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(enc.raw(value.as_py()) + end, dtype=enc.dtype)
                for k, start in enumerate(range(0, len(ids), capacity)):
                    piece = ids[start : start + capacity]
                    raw = little_endian_u32(piece)
                    rows.append((part, doc, k, start, len(piece), zlib.crc32(raw), int(seen[len(piece)]), *[raw] * with_ids))
                    seen[len(piece)] += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names)

    rows = docs.select(F.col(quoted(key)).cast("long").alias("k"), F.col(quoted(text)).cast("string").alias("t"))
    cut = written(rows.mapInArrow(pieces, "part int, doc_id long, piece int, start long, length int, ids_crc32 long, rank long" + ", ids binary" * with_ids), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(packing_plan(lengths, capacity, schemes)))
    ahead = counts.select("part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            sequence, offset = places.value.find(length, rank)
            columns = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            if with_ids:
                columns["ids"] = batch.column("ids")
            columns["length"] = columns["length"].cast(pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    ranked = cut.join(ahead, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("ahead")).drop("part", "ahead")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): each sequence's ids as little-endian 32-bit integers, from ``pack(with_ids=True)``.
    A sequence holds at most its capacity, so a group has a bound."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
