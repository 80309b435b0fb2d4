"""Snapshots of a graph and its chunks: JSON, a compact binary form, and Parquet for what is too large for one file.

JSON and binary are interchange formats of one file, for indexes that one task can hold; the writers run on an executor
over rows in node order, and ``save_tables`` has no such bound.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats.
MAGIC, VERSION = 0x564C5753, 1
METRICS = ("cosine", "dot", "euclidean")
QUANTIZATIONS = ("f32", "sq8", "bq")
JSON_TYPE, JSON_VERSION, DEFAULT_MODEL, DEFAULT_DIMENSION = "skarn_index_snapshot", "1.0", "Xenova/all-MiniLM-L6-v2", 384
CHUNK_FIELDS = ("id", "documentName", "chunkIndex", "totalChunks", "text", "startChar", "endChar", "tokenCountEstimate")
CHUNK_COLUMNS = ("id", "document_name", "chunk_index", "total_chunks", "text", "start_char", "end_char", "token_count_estimate")


@dataclass
class Snapshot:
    """``nodes``: (id, level, vector, neighbors by layer) in node order. ``entry``: a node number, None if empty."""

    nodes: list[tuple[str, int, list[float], list[list[int]]]]
    chunks: list[dict]
    m: int = 16
    m0: int = 32
    ef_construction: int = 64
    ef_search: int = 32
    metric: str = "cosine"
    quantization: str = "f32"
    entry: int | None = None
    max_level: int = -1
    model: str = DEFAULT_MODEL
    created_at: str = ""
    extra: dict = field(default_factory=dict)

    def live(self, deleted: set[str]) -> Snapshot:
        """Without deleted nodes: renumbered, links to them left out, and the entry kept or the first of the top level."""
        kept = [k for k, n in enumerate(self.nodes) if n[0] not in deleted]
        new = {old: k for k, old in enumerate(kept)}
        nodes = [(i, level, v, [[new[n] for n in layer if n in new] for layer in layers]) for i, level, v, layers in (self.nodes[k] for k in kept)]
        top = max((n[1] for n in nodes), default=-1)
        entry = new.get(self.entry) if self.entry in new else next((k for k, n in enumerate(nodes) if n[1] == top), None)
        return replace(self, nodes=nodes, entry=entry, max_level=top)


def to_binary(s: Snapshot) -> bytes:
    """Little-endian: thirteen 4-byte header fields, the chunks as JSON, then each node: its id and a zero byte, level,
    vector, and per layer a count and the node numbers."""
    chunks = json.dumps(s.chunks, ensure_ascii=False, separators=(",", ":")).encode()
    dim = len(s.nodes[0][2]) if s.nodes else 0
    head = struct.pack("<10I2iI", MAGIC, VERSION, len(s.nodes), dim, s.m, s.m0, s.ef_construction, s.ef_search, METRICS.index(s.metric), QUANTIZATIONS.index(s.quantization), -1 if s.entry is None else s.entry, s.max_level, len(chunks))
    out = [head, chunks]
    for i, level, v, layers in s.nodes:
        out.append(i.encode() + b"\0" + struct.pack("<I", level) + np.asarray(v, dtype="<f4").tobytes())
        out += [struct.pack("<I", len(x)) + np.asarray(x, dtype="<u4").tobytes() for x in (layers + [[]] * (level + 1))[: level + 1]]
    return b"".join(out)


def from_binary(data: bytes) -> Snapshot:
    magic, version, n, dim, m, m0, efc, efs, metric, quantization, entry, top, size = struct.unpack_from("<10I2iI", data)
    if magic != MAGIC:
        raise ValueError("Invalid binary snapshot: bad magic number")
    if version != VERSION:
        raise ValueError(f"Unsupported snapshot version: {version}")
    at = 52
    chunks = json.loads(data[at : at + size].decode()) if size else []
    at += size
    nodes = []
    for _ in range(n):
        end = data.index(b"\0", at)
        name, at = data[at:end].decode(), end + 1
        (level,) = struct.unpack_from("<I", data, at)
        vector = np.frombuffer(data, "<f4", dim, at + 4).tolist()
        at += 4 + 4 * dim
        layers = []
        for _ in range(level + 1):
            (count,) = struct.unpack_from("<I", data, at)
            layers.append(np.frombuffer(data, "<u4", count, at + 4).tolist())
            at += 4 + 4 * count
        nodes.append((name, level, vector, layers))
    pick = lambda names, k: names[k] if k < len(names) else names[0]
    return Snapshot(nodes, chunks, m, m0, efc, efs, pick(METRICS, metric), pick(QUANTIZATIONS, quantization), None if entry < 0 else entry, top)


def to_json(s: Snapshot, signature: str = JSON_TYPE) -> str:
    """``signature`` is the file's type; files for another reader need the type that it asks for."""
    hnsw = {"M": s.m, "M0": s.m0, "efConstruction": s.ef_construction, "efSearch": s.ef_search, "metric": s.metric, "quantization": s.quantization, "entryPointIndex": s.entry, "maxLevel": s.max_level}
    hnsw["nodes"] = [{"id": i, "vector": list(v), "level": level, "neighbors": layers} for i, level, v, layers in s.nodes]
    meta = {"totalChunks": len(s.chunks), "dimension": len(s.nodes[0][2]) if s.nodes else DEFAULT_DIMENSION, "modelName": s.model}
    return json.dumps({"version": JSON_VERSION, "type": signature, "createdAt": s.created_at, "metadata": meta, "hnsw": hnsw, "chunks": s.chunks}, indent=2, ensure_ascii=False)


def from_json(text: str, signature: str = JSON_TYPE) -> Snapshot:
    found = json.loads(text)
    if found.get("type") != signature:
        raise ValueError("Invalid snapshot: wrong type")
    h = found["hnsw"]
    nodes = [(n["id"], n["level"], n["vector"], n["neighbors"]) for n in h["nodes"]]
    return Snapshot(nodes, found["chunks"], h["M"], h["M0"], h["efConstruction"], h["efSearch"], h["metric"], h.get("quantization", "f32"), h["entryPointIndex"], h["maxLevel"], found.get("metadata", {}).get("modelName", DEFAULT_MODEL), found.get("createdAt", ""))


def _one(nodes: pd.DataFrame, chunks: list[dict], params: dict) -> Snapshot:
    nodes = nodes.sort_values("node")
    rows = [(str(i), int(level), list(map(float, v)), [list(map(int, x)) for x in n]) for i, level, v, n in zip(nodes.id, nodes.level, nodes.vector, nodes.neighbors, strict=True)]
    top = max((r[1] for r in rows), default=-1)
    return Snapshot(rows, chunks, entry=next((k for k, r in enumerate(rows) if r[1] == top), None), max_level=top, **params)


def snapshot_rows(nodes: DataFrame, chunks: DataFrame | None = None, form: str = "binary", **params) -> DataFrame:
    """(shard, content): a snapshot file of each shard of a graph, written where the shard is. Chunks, if any, go with the
    shard of their vector (a column ``shard``). An index without nodes gives no rows: there is nothing to export."""

    def write(graph: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        if not len(graph):
            return pd.DataFrame({"shard": [], "content": []})
        mine = [{f: (x if not hasattr(x, "item") else x.item()) for f, x in zip(CHUNK_FIELDS, row, strict=True)} for row in texts[list(CHUNK_COLUMNS)].itertuples(index=False, name=None)] if len(texts) else []
        made = _one(graph, mine, params)
        content = to_binary(made) if form == "binary" else to_json(made).encode()
        return pd.DataFrame({"shard": [int(graph.shard.iloc[0])], "content": [content]})

    spark = nodes.sparkSession
    if chunks is None:
        chunks = spark.createDataFrame([], "shard int, " + ", ".join(f"{c} string" for c in CHUNK_COLUMNS))
    # columns of their own, as the chunks may come from the nodes
    chunks = chunks.select(F.expr("shard + 0").cast("int").alias("shard"), *CHUNK_COLUMNS)
    return nodes.groupBy("shard").cogroup(chunks.groupBy("shard")).applyInPandas(write, "shard int, content binary")


def export(nodes: DataFrame, chunks: DataFrame | None = None, form: str = "binary", **params) -> DataFrame:
    """``snapshot_rows`` of an index that holds something; an empty one is an error."""
    if nodes.isEmpty():
        raise ValueError("the index is empty: there is nothing to export")
    return snapshot_rows(nodes, chunks, form, **params)


def _opened(data: bytes, form: str, signature: str = JSON_TYPE) -> Snapshot:
    return from_binary(bytes(data)) if form == "binary" else from_json(bytes(data).decode(), signature)


def read_snapshots(files: DataFrame, form: str = "binary", content: str = "content") -> DataFrame:
    """The nodes in snapshot files (a binary column): (node, id, level, vector, neighbors)."""

    def read(batches):
        for batch in batches:
            rows = []
            for data in batch[content]:
                rows += [(k, i, level, v, layers) for k, (i, level, v, layers) in enumerate(_opened(data, form).nodes)]
            yield pd.DataFrame(rows, columns=["node", "id", "level", "vector", "neighbors"])

    return files.select(content).mapInPandas(read, "node int, id string, level int, vector array<float>, neighbors array<array<int>>")


def read_headers(files: DataFrame, form: str = "binary", content: str = "content") -> DataFrame:
    """The parameters of each snapshot file, where its search enters, and how much it holds."""
    fields = "m int, m0 int, ef_construction int, ef_search int, metric string, quantization string, entry int, max_level int, nodes int, chunks int"

    def read(batches):
        for batch in batches:
            made = [_opened(data, form) for data in batch[content]]
            rows = [(s.m, s.m0, s.ef_construction, s.ef_search, s.metric, s.quantization, s.entry, s.max_level, len(s.nodes), len(s.chunks)) for s in made]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in fields.split(", ")], dtype=object)

    return files.select(content).mapInPandas(read, fields)


def read_chunks(files: DataFrame, form: str = "binary", content: str = "content") -> DataFrame:
    """The chunks in snapshot files."""

    def read(batches):
        for batch in batches:
            rows = [[c.get(f) for f in CHUNK_FIELDS] for data in batch[content] for c in _opened(data, form).chunks]
            yield pd.DataFrame(rows, columns=list(CHUNK_COLUMNS), dtype=object)

    return files.select(content).mapInPandas(read, "id string, document_name string, chunk_index int, total_chunks int, text string, start_char int, end_char int, token_count_estimate int")


def save_tables(path: str, nodes: DataFrame, chunks: DataFrame, **header) -> None:
    """A snapshot of any size: a folder of Parquet tables and a header row, written last."""
    if nodes.isEmpty():
        raise ValueError("the index is empty: there is nothing to export")
    nodes.write.parquet(f"{path}/nodes")
    chunks.write.parquet(f"{path}/chunks")
    nodes.sparkSession.createDataFrame([(json.dumps(header),)], "header string").write.parquet(f"{path}/header")


def load_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    header = json.loads(spark.read.parquet(f"{path}/header").first().header)
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/chunks"), header


def vector_json(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, json): each vector as a JSON array."""
    return vectors.select(F.col(key).alias("id"), F.to_json(F.col(column)).alias("json"))
