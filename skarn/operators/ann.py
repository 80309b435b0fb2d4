"""Approximate nearest neighbours: a hierarchical proximity graph per shard, searched in every shard and merged.

A shard is a hash class of the ids with a bounded number of vectors. It is built by one task, as arrays: vectors as a
matrix, links as a list of arrays per layer; a search computes the distances of a whole neighbour list at once. Searching
all shards with the full k and beam finds at least what one graph over all vectors would.
"""

from __future__ import annotations

import heapq
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import score
from ..sources.scratch import written
from .knn import distances, knn_batch

NODES = "shard int, node int, id long, level int, vector array<float>, neighbors array<array<int>>"


@dataclass(frozen=True)
class GraphConfig:
    m: int = 16
    ef_construction: int = 64
    ef_search: int = 32
    metric: str = "cosine"
    quantization: str = "f32"
    seed: int = 42

    @property
    def m0(self) -> int:
        return 2 * self.m


class Vectors:
    """Distances from a query to rows of the (possibly quantized) matrix."""

    def __init__(self, rows: np.ndarray, config: GraphConfig):
        self.config = config
        self.rows = rows.astype(np.float64)
        if config.quantization == "sq8":
            self.codes, self.scale = self._sq8(self.rows)
        elif config.quantization == "bq":
            self.codes = self.rows > 0

    @staticmethod
    def _sq8(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = np.abs(rows).max(axis=1)
        scale = np.where(most == 0, 1, most / 127)
        return np.clip(np.floor(rows / scale[:, None] + 0.5), -127, 127), scale

    def query(self, q: np.ndarray):
        q = np.asarray(q, dtype=np.float64)
        if self.config.quantization == "sq8":
            codes, scale = self._sq8(q[None])
            return lambda at: 1 - np.clip((self.codes[at] @ codes[0]) * scale[0] * self.scale[at], -1, 1)
        if self.config.quantization == "bq":
            bits = q > 0
            return lambda at: (self.codes[at] != bits).sum(axis=1) / len(bits)
        if self.config.metric == "cosine":
            return lambda at: 1 - np.clip(self.rows[at] @ q, -1, 1)
        if self.config.metric == "dot":
            return lambda at: -(self.rows[at] @ q)
        return lambda at: np.sqrt(((self.rows[at] - q) ** 2).sum(axis=1))


    def all(self, q: np.ndarray) -> np.ndarray:
        """Distances from many queries (a row each) to all rows, by matrix products: exact but for the order of sums."""
        if self.config.quantization == "sq8":
            codes, scale = self._sq8(q)
            return 1 - np.clip((codes @ self.codes.T) * scale[:, None] * self.scale, -1, 1)
        if self.config.quantization == "bq":
            bits, codes = (q > 0).astype(np.float64), self.codes.astype(np.float64)
            return (bits.sum(axis=1)[:, None] + codes.sum(axis=1) - 2 * (bits @ codes.T)) / q.shape[1]
        return distances(self.rows, q, self.config.metric)

    def one_by_one(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distances from a query to some rows, each sum from left to right: the same for equal rows wherever they stand,
        which the sums of a matrix product need not be."""
        if self.config.quantization != "f32":
            return self.query(q)(at)
        terms = (self.rows[at] - q) ** 2 if self.config.metric == "euclidean" else self.rows[at] * q
        total = np.cumsum(terms, axis=1)[:, -1]
        return 1 - np.clip(total, -1, 1) if self.config.metric == "cosine" else -total if self.config.metric == "dot" else np.sqrt(total)


class Graph:
    """The layers of one shard: ``links[layer][node]`` is an array of nodes."""

    def __init__(self, rows: np.ndarray, levels: np.ndarray, config: GraphConfig):
        self.vectors, self.levels, self.config = Vectors(rows, config), levels, config
        self.links: list[dict[int, np.ndarray]] = [{} for _ in range(int(levels.max()) + 1)] if len(levels) else []
        self.entry = int(np.argmax(levels)) if len(levels) else -1

    @staticmethod
    def draw_levels(ids: np.ndarray, config: GraphConfig) -> np.ndarray:
        """Geometric levels from a hash of the id, so a rebuild gives the same graph."""
        x = (ids.astype(np.uint64) + np.uint64(config.seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53
        return np.floor(-np.log(np.maximum(u, 1e-12)) / math.log(config.m)).astype(int)

    def build(self) -> Graph:
        config, top = self.config, -1
        for node, level in enumerate(self.levels.tolist()):
            far = self.vectors.query(self.vectors.rows[node])
            start = [self.entry] if top >= 0 else []
            for layer in range(top, level, -1):
                start = [self.beam(far, start, 1, layer)[0][1]]
            for layer in range(min(level, top), -1, -1):
                near = self.beam(far, start, config.ef_construction, layer)
                chosen = np.array([n for _, n in near[: config.m]])
                most = config.m0 if layer == 0 else config.m
                self.links[layer][node] = chosen
                for other in chosen.tolist():
                    linked = np.append(self.links[layer].get(other, np.zeros(0, int)), node)
                    if len(linked) > most:
                        linked = linked[np.argsort(self.vectors.query(self.vectors.rows[other])(linked), kind="stable")[:most]]
                    self.links[layer][other] = linked
                start = [n for _, n in near]
            for layer in range(max(top, -1) + 1, level + 1):
                self.links[layer].setdefault(node, np.zeros(0, int))
            if level > top:
                self.entry, top = node, level
        return self

    def beam(self, far, start: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest found from ``start`` in a layer, nearest first."""
        seen = set(start)
        first = list(zip(far(np.array(start)).tolist(), start, strict=True))
        ahead, best = list(first), [(-d, -n) for d, n in first]
        heapq.heapify(ahead)
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        links = self.links[layer]
        while ahead:
            d, node = heapq.heappop(ahead)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [n for n in links.get(node, np.zeros(0, int)).tolist() if n not in seen]
            if not new:
                continue
            seen.update(new)
            for d, n in zip(far(np.array(new)).tolist(), new, strict=True):
                if len(best) < width or d < -best[0][0]:
                    heapq.heappush(ahead, (d, n))
                    heapq.heappush(best, (-d, -n))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, -n) for d, n in best)

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        far, start = self.vectors.query(q), [self.entry]
        for layer in range(len(self.links) - 1, 0, -1):
            start = [self.beam(far, start, 1, layer)[0][1]]
        return self.beam(far, start, ef, 0)

    def checked(self, queries: list[np.ndarray], found: list[list[int]], keep: np.ndarray, ids: np.ndarray, k: int, cells: int = 4_000_000) -> Iterator[list[tuple[float, int]]]:
        """For each query the exact k nearest of the rows to ``keep``, ties to the smaller id. The farthest of the k that
        the beam found bounds them: a matrix product over all rows tells which others are no farther."""
        rows = np.flatnonzero(keep)
        step = max(1, cells // max(1, len(keep)))
        for low in range(0, len(queries), step):
            q = np.stack(queries[low : low + step]).astype(np.float64)
            # wider than the error of the products, as what they pass is computed again
            slack = 1e-9 if self.config.quantization != "f32" or self.config.metric == "cosine" else 1e-6 * (1 + np.abs(self.vectors.rows).max(initial=0) ** 2 + np.abs(q).max() ** 2) * q.shape[1]
            far = self.vectors.all(q)
            for one, own, distance in zip(q, found[low : low + step], far, strict=True):
                bound = np.sort(distance[own])[k - 1] + slack if len(own) >= k else np.inf
                near = rows[distance[rows] <= bound]
                exact = self.vectors.one_by_one(one, near)
                order = np.lexsort((ids[near], exact))[:k]
                yield list(zip(exact[order].tolist(), near[order].tolist(), strict=True))

    @staticmethod
    def restore(rows: pd.DataFrame, config: GraphConfig) -> Graph:
        rows = rows.sort_values("node")
        graph = Graph(np.stack(rows.vector.to_numpy()), rows.level.to_numpy(), config)
        for node, layers in zip(rows.node.tolist(), rows.neighbors, strict=True):
            for layer, linked in enumerate(layers):
                graph.links[layer][node] = np.asarray(linked, dtype=int)
        return graph


def build_graph(vectors: DataFrame, config: GraphConfig = GraphConfig(), shard_vectors: int = 20_000, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The nodes of all shards. The number of shards follows from the count, so a task's work has a bound."""
    shards = max(1, -(-vectors.count() // shard_vectors))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").drop_duplicates("id", keep="last").reset_index(drop=True)
        graph = Graph(np.stack(rows.v.to_numpy()), Graph.draw_levels(rows.id.to_numpy(), config), config).build()
        rows["node"], rows["level"] = np.arange(len(rows)), graph.levels
        rows["neighbors"] = [[graph.links[layer].get(n, np.zeros(0, int)).tolist() for layer in range(level + 1)] for n, level in enumerate(graph.levels)]
        return rows.rename(columns={"v": "vector"})[["shard", "node", "id", "level", "vector", "neighbors"]]

    rows = vectors.select(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(shards)).cast("int").alias("shard"), F.col(key).cast("long").alias("id"), F.col(column).cast("array<float>").alias("v")).where("v is not null")
    return rows.groupBy("shard").applyInPandas(build, NODES)


def search_graph(nodes: DataFrame, queries: DataFrame, k: int = 10, config: GraphConfig = GraphConfig(), ef: int | None = None, allowed: DataFrame | None = None, tombstones: DataFrame | None = None, query_key: str = "vec_id", column: str = "embedding", most_queries: int = 20_000, checked: bool = False) -> DataFrame:
    """(qid, id, distance, score, rank). ``allowed`` and ``tombstones`` (ids in their first column) filter what the beam
    found, with a beam twice as wide; deleted nodes still lead the way. A beam misses some of the nearest, more of them
    in larger tables: with ``checked``, an exact check of each shard follows and adds what it missed. Up to
    ``most_queries`` queries are broadcast, counted first; more pass in blocks of about that size."""
    asked = queries.select(F.col(query_key).cast("long").alias("q"), F.col(column).cast("array<double>").alias("v")).where("v is not null")
    parts = max(1, -(-asked.count() // most_queries))
    filtered = allowed is not None or tombstones is not None
    width = max(k, ef or config.ef_search) * (2 if filtered else 1)
    nodes = nodes.withColumn("keep", F.lit(True))
    if allowed is not None:
        some = allowed.select(F.col(allowed.columns[0]).alias("id"), F.lit(True).alias("some")).distinct()
        nodes = nodes.join(some, "id", "left").withColumn("keep", F.coalesce("some", F.lit(False))).drop("some")
    if tombstones is not None:
        dead = tombstones.select(F.col(tombstones.columns[0]).alias("id"), F.lit(True).alias("gone")).distinct()
        nodes = nodes.join(dead, "id", "left").withColumn("keep", F.col("keep") & F.col("gone").isNull()).drop("gone")

    def searched(shared):
        def search(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("node")
            graph, ids, keep = Graph.restore(rows, config), rows.id.to_numpy(), rows.keep.to_numpy()
            qids, asked = shared.value[0], list(map(np.asarray, shared.value[1]))
            found = [[(d, n) for d, n in graph.search(q, width) if keep[n]] for q in asked]
            if checked:
                found = graph.checked(asked, [[n for _, n in x] for x in found], keep, ids, k)
            out = [(qid, ids[n], d) for qid, x in zip(qids, found, strict=True) for d, n in x[:k]]
            return pd.DataFrame(out, columns=["qid", "id", "distance"])

        return search

    found = None
    for part in range(parts):
        block = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part)).toPandas()
        shared = nodes.sparkSession.sparkContext.broadcast((block.q.to_numpy(), list(block.v)))
        some = nodes.groupBy("shard").applyInPandas(searched(shared), "qid long, id long, distance double")
        found = some if found is None else found.union(some)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return found.select("qid", "id", "distance", score(F.col("distance"), config.metric, config.quantization).alias("score"), "rank")


def numbered(nodes: DataFrame) -> DataFrame:
    """The nodes numbered without gaps over all shards, in the order of their ids, and their links with them: within a
    shard they have numbers of their own. Ranges of ids are counted, so that no task sorts all."""
    ids = nodes.select("id").repartitionByRange("id").sortWithinPartitions("id")
    placed = written(ids.select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "node-numbers")
    counts = sorted(tuple(r) for r in placed.groupBy("part").count().collect())
    before = [(part, sum(n for _, n in counts[:k])) for k, (part, _) in enumerate(counts)]
    offsets = nodes.sparkSession.createDataFrame(before, "part int, before long")
    numbers = placed.join(F.broadcast(offsets), "part").select("id", (F.col("at") + F.col("before")).cast("int").alias("number"))

    def renumber(rows: pd.DataFrame) -> pd.DataFrame:
        new = np.zeros(int(rows.node.max()) + 1, dtype=np.int32)
        new[rows.node.to_numpy()] = rows.number.to_numpy()
        rows["neighbors"] = [[new[np.asarray(layer, dtype=int)].tolist() for layer in layers] for layers in rows.neighbors]
        return rows.assign(node=rows.number)[["shard", "node", "id", "level", "vector", "neighbors"]]

    return nodes.join(numbers, "id").groupBy("shard").applyInPandas(renumber, NODES)


def compact(nodes: DataFrame, tombstones: DataFrame, config: GraphConfig = GraphConfig(), **params) -> DataFrame:
    """The graph built anew from the vectors that are not deleted; node numbers are gapless again,
    within each shard; ``numbered`` has them over all shards."""
    live = nodes.join(tombstones.select(F.col(tombstones.columns[0]).alias("id")), "id", "left_anti").select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding"))
    return build_graph(live, config, **params)


def drop_tombstones(nodes: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Without deleted nodes: the rest renumbered in order, links to deleted ones left out. All within a shard."""

    def renumber(rows: pd.DataFrame) -> pd.DataFrame:
        live = rows[rows.gone.isna()].sort_values("node").copy()
        new = {old: k for k, old in enumerate(live.node.tolist())}
        live["neighbors"] = [[[new[n] for n in layer if n in new] for layer in layers] for layers in live.neighbors]
        live["node"] = list(range(len(live)))
        return live[["shard", "node", "id", "level", "vector", "neighbors"]]

    dead = tombstones.select(F.col(tombstones.columns[0]).alias("id"), F.lit(True).alias("gone")).distinct()
    marked = nodes.join(dead, "id", "left")
    return marked.groupBy("shard").applyInPandas(renumber, NODES)


def switch_quantization(nodes: DataFrame, config: GraphConfig, quantization: str, **params) -> tuple[DataFrame, GraphConfig]:
    """The graph built anew from its vectors under another quantization, all else as it was; the same graph where it has
    that quantization already."""
    if quantization not in ("f32", "sq8", "bq"):
        raise ValueError(f"quantization is f32, sq8 or bq, not {quantization!r}")
    if quantization == config.quantization:
        return nodes, config
    other = replace(config, quantization=quantization)
    return build_graph(nodes.select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding")), other, **params), other


def sizes(nodes: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """One row: size, all nodes of the graph, and active_size, those not deleted."""
    rows = nodes.select("id", F.lit(False).alias("gone"))
    if tombstones is not None:
        dead = tombstones.select(F.col(tombstones.columns[0]).alias("id"), F.lit(True).alias("gone")).distinct()
        rows = nodes.select("id").join(dead, "id", "left").select("id", F.coalesce("gone", F.lit(False)).alias("gone"))
    return rows.agg(F.count(F.lit(1)).alias("size"), F.count_if(~F.col("gone")).alias("active_size"))


def degrees(nodes: DataFrame) -> DataFrame:
    """(id, level, layer, degree): the links of each node in each of its layers."""
    return nodes.select("id", "level", F.posexplode("neighbors").alias("layer", "linked")).select("id", "level", "layer", F.size("linked").alias("degree"))


def probe_queries(spark: SparkSession, dim: int, count: int = 20, step: float = 13, rise: float = 0.7) -> DataFrame:
    """(vec_id, embedding): fixed test vectors, the d-th value of the i-th being sin(i * step + d * rise) in single
    precision. An audit asks 20 with steps of 13 and 0.7, a benchmark 100 with 17 and 1."""
    value = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.sin(F.col("id") * step + d * rise).cast("float"))
    return spark.range(count).select(F.col("id").alias("vec_id"), value.alias("embedding"))


def time_searches(nodes: DataFrame, queries: DataFrame, k: int = 5, config: GraphConfig = GraphConfig(), ef: int | None = None, query_key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(qid, shard, ms): how long the search of each query takes in each shard, one after another; the graph is restored
    once. Up to 20,000 queries, as a benchmark asks a few: more raise an error."""
    asked = queries.select(F.col(query_key).cast("long").alias("q"), F.col(column).cast("array<double>").alias("v")).limit(20_001).toPandas()
    if len(asked) > 20_000:
        raise ValueError("a benchmark asks at most 20,000 queries")
    shared = nodes.sparkSession.sparkContext.broadcast((asked.q.to_numpy(), list(asked.v)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        graph, out = Graph.restore(rows, config), []
        for qid, q in zip(*shared.value, strict=True):
            began = time.perf_counter()
            graph.search(np.asarray(q), max(k, ef or config.ef_search))
            out.append((qid, int(rows.shard.iloc[0]), (time.perf_counter() - began) * 1000))
        return pd.DataFrame(out, columns=["qid", "shard", "ms"])

    return nodes.groupBy("shard").applyInPandas(run, "qid long, shard int, ms double")


def prune_links(links: DataFrame, most: int) -> DataFrame:
    """(src, layer, dst, distance): the nearest ``most`` links of each node and layer."""
    return links.withColumn("__r", F.row_number().over(Window.partitionBy("src", "layer").orderBy("distance", "dst"))).where(F.col("__r") <= most).drop("__r")


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row: the mean share of each query's exact k that was found, in percent with one decimal."""
    hits = exact.select("qid", "id").join(found.select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hits.groupBy("qid").agg(F.count("hit").alias("h")).agg(F.round(F.avg(F.col("h") / k) * 100, 1).alias("recall"))


def audit(vectors: DataFrame, queries: DataFrame, k: int = 10, config: GraphConfig = GraphConfig(), ef: int | None = None) -> DataFrame:
    """Recall of the graph against the exact scan, of the same vectors."""
    return recall(search_graph(build_graph(vectors, config), queries, k, config, ef), knn_batch(vectors, queries, k, config.metric), k)
