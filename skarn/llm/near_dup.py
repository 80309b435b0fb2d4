"""Near-duplicate documents by a chosen-path set similarity join, each link confirmed on the full sets.

A document's set is its distinct word shingles. Documents with equal sets form one class, and one of each class goes
on. In the join, documents that share a selected minwise token meet in a node of a tree; a node with few documents is
compared exhaustively, a larger one branches by further tokens, and other trees with other first tokens repeat it until a pair
at the threshold is missed with the probability given in ``missed``: under 1e-5 where the first nodes are compared,
about 1e-4 where all nodes branch four times. Comparison in a node is by 64 minwise bytes with a wide
margin and yields a forest, not all pairs. The forests' components then get the full sets, and the exact similarity
decides. A node or component with many documents is cut into blocks, and every pair of blocks meets in a task of its own.

Nulls: a null text has an empty set, linked with nothing; rows with a null id are classes of their own (component
null, kept). Rows that share an id count as one document with several texts. Texts of any length are read whole. Of
equal texts the smallest id is kept. Empty tables give empty results; other columns pass through ``near_dedup`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernel import BLACK, Words, blocks, column_bytes, mix, shingle_sets, stream
from .shared import fresh, quoted, written

#: Trees, each with a first token of its own; groups of further tokens, one of them to branch by at each level of a path.
TREES, GROUPS, BRANCHES = 10, 6, 5
TOKENS, BYTES = TREES + GROUPS * BRANCHES, 48
SIGNED = "doc long, n long, f1 long, f2 long, tokens array<int>, sketch binary"
_SEED = (stream(11, TOKENS + BYTES) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
_FACTOR = (stream(12, TOKENS + BYTES) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)


def group_at(tree: int, level: int) -> int:
    """The group of tokens that a node of a tree branches by: another one at each level of a path, up to GROUPS levels."""
    return (tree + level * (1 if tree < GROUPS else GROUPS - 1)) % GROUPS


def missed(similarity: float = 0.75, levels: int = 0, trees: int = TREES, draws: int = 400_000) -> float:
    """The share of pairs of this similarity that meet in no node if all nodes branch this often, counted over random
    agreements of tokens: a pair must agree on a tree's first token and on one of a group at each further level, and
    trees share groups. Pairs that a node compares at once are missed less often."""
    agree = np.random.default_rng(1).random((draws, TOKENS)) < similarity
    groups = agree[:, TREES:].reshape(draws, GROUPS, BRANCHES).any(axis=2)
    met = np.zeros(draws, dtype=bool)
    for tree in range(trees):
        met |= np.logical_and.reduce([agree[:, tree], *(groups[:, group_at(tree, level)] for level in range(levels))])
    return 1 - float(met.mean())


def signed(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set size, two fingerprints of the set, its minwise tokens and its minwise bytes, of each text."""
    data, offsets = column_bytes(column)
    parts = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, TOKENS), np.int32), np.zeros((0, BYTES), np.uint8)]]
    for low, high in blocks(offsets):
        sets = shingle_sets(Words(data, offsets[low : high + 1], BLACK, lower=True), shingle)
        n = np.array([len(s) for s in sets], dtype=np.int64)
        full = np.flatnonzero(n)
        f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        least = np.zeros((len(n), TOKENS + BYTES), np.uint32)
        if len(full):
            every = np.concatenate([sets[k] for k in full])
            at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
            f1[full] = np.add.reduceat(mix(every), at)
            f2[full] = np.add.reduceat(mix(every ^ np.uint64(0x5851F42D4C957F2D)), at)
            short = (every >> np.uint64(32)).astype(np.uint32)
            for k in range(TOKENS + BYTES):
                least[full, k] = np.minimum.reduceat((short ^ _SEED[k]) * _FACTOR[k], at)
        sketch = least[:, TOKENS:]
        parts.append([n, f1.view(np.int64), f2.view(np.int64), least[:, :TOKENS].view(np.int32), ((sketch ^ (sketch >> np.uint32(8))) & np.uint32(255)).astype(np.uint8)])
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def runs(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """The rows of each key (the first ``keys`` columns, longs) of batches sorted by it, one key at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        edges = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        if held and any(held[0].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        low = 0
        for high in edges.tolist():
            held.append(batch.slice(low, high - low))
            yield pa.Table.from_batches(held)
            held, low = [], high
        held.append(batch.slice(low))
    if held:
        yield pa.Table.from_batches(held)


def run_edges(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array], list[np.ndarray]]]:
    """Whole runs of equal keys (the first ``keys`` columns, longs) of batches sorted by them, many at a time: the values
    of the next column (longs), where each run begins and the last ends, the columns from that one on, and the keys."""

    def edges_of(columns: list) -> np.ndarray:
        values = np.stack([c.to_numpy() for c in columns[:keys]])
        return np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1

    def packed(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, list[pa.Array], list[np.ndarray]]:
        columns = [c.combine_chunks() for c in pa.Table.from_batches(held).columns]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        first = np.concatenate(([0], edges_of(columns), [len(columns[0])]))
        return columns[keys].to_numpy(), first, columns[keys:], [c.to_numpy() for c in columns[:keys]]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = edges_of(batch.columns)
        goes_on = bool(held) and all(held[0].column(k)[0].as_py() == batch.column(k)[0].as_py() for k in range(keys))
        cut = int(edges[-1]) if len(edges) else 0
        if cut or (held and not goes_on):
            yield packed([*held, *([batch.slice(0, cut)] if cut else [])])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield packed(held)


def parts_of(size: Column, task: int) -> Column:
    """Blocks of a group: one up to ``task`` rows, then up to 16, and beyond that blocks of at most 64 times as many."""
    return F.greatest(F.least(F.ceil(size / task), F.lit(16)), F.ceil(size / (64 * task))).cast("int")


def forest(n: int, near) -> list[tuple[int, int]]:
    """Links that join whatever ``near(p, others)`` joins: a search that compares only what no link has reached."""
    left, out = np.arange(1, n), []
    stack = [0]
    while len(left):
        if not stack:
            stack, left = [int(left[0])], left[1:]
            continue
        p = stack.pop()
        found = near(p, left)
        if found.any():
            new = left[found]
            left = left[~found]
            out += [(p, int(k)) for k in new]
            stack += new.tolist()
    return out


def sketch_links(sketches: np.ndarray, least: int) -> list[tuple[int, int]]:
    return forest(len(sketches), lambda p, others: (sketches[others] == sketches[p]).sum(axis=1) >= least)


def exact_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of the pairs with 100 * |intersection| >= percent * |union|."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        same = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if 100 * same >= percent * (sizes.sum() - same) else []
    every = np.concatenate(sets)
    _, token = np.unique(every, return_inverse=True)
    first = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(token, kind="stable")]
    ends = np.cumsum(np.bincount(token))
    alive = [len(sets), owner, ends]

    def near(p: int, others: np.ndarray) -> np.ndarray:
        if 2 * len(others) < alive[0]:
            stay = np.zeros(len(sets), dtype=bool)
            stay[others] = True
            keep = stay[alive[1]]
            alive[:] = len(others), alive[1][keep], np.concatenate(([0], np.cumsum(keep)))[alive[2]]
        _, owners, ends = alive
        mine = token[first[p] : first[p + 1]]
        high = ends[mine]
        low = np.where(mine > 0, ends[mine - 1], 0)
        counts = high - low
        at = np.repeat(high - np.cumsum(counts), counts) + np.arange(counts.sum())
        same = np.bincount(owners[at], minlength=len(sets))[others]
        return 100 * same >= percent * (sizes[p] + sizes[others] - same)

    return forest(len(sets), near)


def _links_of(batches: Iterator[pa.RecordBatch], keys: int, value, find) -> Iterator[pa.RecordBatch]:
    """Links within each run: columns are the keys, the document, its value."""
    for run in runs(batches, keys):
        if run.num_rows > 1:
            ids = run.column(keys).to_numpy()
            found = np.array(find(value(run.column(keys + 1))), dtype=np.int64).reshape(-1, 2)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]])], names=["a", "b"])


def _sketches(column: pa.ChunkedArray) -> np.ndarray:
    data, offsets = column_bytes(column)
    return data[offsets[0] : offsets[-1]].reshape(-1, BYTES)


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in column]


def _nodes(reps: DataFrame, trees: int, node_size: int, levels: int, dense: float) -> DataFrame:
    """(node, doc, size) of all nodes with two documents or more that are compared. A node over ``node_size`` branches,
    unless it kept more than the share ``dense`` of its parent: then its documents are alike, and further tokens would
    only repeat it, while the search for links in it takes a few passes."""
    rows = reps.select("doc", F.posexplode(F.slice("tokens", 1, trees)).alias("tree", "v")).select(F.xxhash64("tree", "v").alias("node"), "doc", "tree", F.lit(None).cast("long").alias("parent"))
    out = None
    for level in range(levels + 1):
        # written, so that the join can split a node that many documents share
        counts = written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"sizes-{level}")
        sized = written(rows.join(counts, "node"), f"nodes-{level}")
        large = (F.col("size") > node_size) & (F.col("parent").isNull() | (F.col("size") <= dense * F.col("parent"))) & F.lit(level < levels)
        small = sized.where(~large).select("node", "doc", "size")
        out = small if out is None else out.union(small)
        if level == levels or sized.where(large).isEmpty():
            return out
        group = F.element_at(F.array(*(F.lit(group_at(t, level)) for t in range(TREES))), F.col("tree") + 1)
        branches = F.sequence(TREES + group * BRANCHES + 1, TREES + group * BRANCHES + BRANCHES)
        rows = sized.where(large).join(reps.select("doc", "tokens"), "doc").select("node", "doc", "tree", "size", "tokens", F.explode(branches).alias("c"))
        rows = rows.select(F.xxhash64("node", "c", F.element_at("tokens", F.col("c"))).alias("node"), "doc", "tree", F.col("size").alias("parent"))
    return out


def _block_pairs(rows: DataFrame, parts, group: str, *columns: str) -> DataFrame:
    """Rows of a group cut into ``parts`` blocks: a row goes to every pair of blocks that has its own, so a pair of
    documents meets in a task whose size has a bound. With one part the group is one task's."""
    part = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    pair = (F.least(part, F.col("other")) * F.lit(1 << 31) + F.greatest(part, F.col("other"))).cast("long").alias("pair")
    paired = rows.withColumn("parts", parts).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return paired.select(group, pair, "doc", *columns).repartition(group, "pair").sortWithinPartitions(group, "pair", "doc")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 75, trees: int = TREES, node_size: int = 8192, levels: int = 4, dense: float = 0.6, task_docs: int = 512, task_shingles: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per input row."""
    if not 0 < trees <= TREES:
        raise ValueError(f"there are tokens for up to {TREES} trees")
    rows = docs.select(F.col(quoted(key)).cast("long").alias("doc"), F.col(quoted(text)).cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, tokens, sketch = signed(batch.column(1), shingle)
            lists = pa.ListArray.from_arrays(np.arange(0, tokens.size + 1, TOKENS, dtype=np.int32), pa.array(tokens.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(f1), pa.array(f2), lists, pa.array([x.tobytes() for x in sketch], pa.binary())], names=["doc", "n", "f1", "f2", "tokens", "sketch"])

    signs = written(rows.mapInArrow(sign, SIGNED), "signed")
    # written, so that a hot class's rows on the other side of the join can be split
    classes = written(signs.where("n > 0 and doc is not null").groupBy("n", "f1", "f2").agg(F.min("doc").alias("rep")), "classes")
    member = written(signs.select("doc", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left").select("doc", "n", "rep"), "members")
    chosen = written(signs.join(member.where("doc = rep").select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.min_by(F.struct("n", "tokens", "sketch"), F.struct("f1", "f2")).alias("x")).select("doc", "x.*"), "reps")

    nodes = _nodes(chosen, trees, node_size, levels, dense)
    least = int(BYTES * (percent / 100 - 0.25))
    compared = _block_pairs(nodes.join(chosen.select("doc", "sketch"), "doc"), parts_of(F.col("size"), task_docs), "node", "sketch")
    coarse = components(compared.mapInArrow(lambda b: _links_of(b, 2, _sketches, lambda s: sketch_links(s, least)), "a long, b long"))

    coarse = coarse.join(chosen.select(F.col("doc").alias("id"), "n"), "id")
    sizes = written(coarse.groupBy("component").agg(F.greatest(parts_of(F.count(F.lit(1)), task_docs // 2 or 1), F.ceil(F.sum("n") / task_shingles)).cast("int").alias("parts")), "sets")
    placed = coarse.join(sizes, "component").select("id", "component", "parts")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(3))
            found = [s.tobytes() for a, b in blocks(offsets) for s in shingle_sets(Words(data, offsets[a : b + 1], BLACK, lower=True), shingle)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["component", "parts", "doc", "shingles"])

    whole = rows.join(placed, rows.doc == placed.id).select("component", "parts", "doc", "text").mapInArrow(sets, "component long, parts int, doc long, shingles binary")
    paired = _block_pairs(whole, F.col("parts"), "component", "shingles")
    final = components(paired.mapInArrow(lambda b: _links_of(b, 2, _sets, lambda s: exact_links(s, percent)), "a long, b long"))

    joined = member.join(final, member.rep == final.id, "left").select("doc", "n", F.coalesce("component", "rep", "doc").alias("component_id"))
    return joined.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """The documents of which no smaller id is in their component, all columns as they are."""
    gone, at = fresh(docs.columns, "gone", "at")
    drops = near_duplicates(docs, key, text, **params).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.withColumn(at, F.col(quoted(key)).cast("long")).join(drops, F.col(at) == F.col(gone), "left_anti").drop(at)
