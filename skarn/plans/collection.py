"""A collection: documents, chunks, vectors and both indexes behind one object, as lazy DataFrames over a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import embedder
from ..operators import ann, bm25, chunk, hybrid, knn, metrics, rag
from ..sources import snapshot
from ..sources.store import Store


class Collection:
    """``add`` chunks, embeds and stores; ``search`` is dense, sparse or hybrid; ``answer`` cites what it found."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column] | None = None, dim: int = 384, size: int = 550, overlap: int = 100):
        self.spark, self.store = spark, Store(spark, path)
        self.embed, self.size, self.overlap = embed or embedder(dim=dim), size, overlap

    def add(self, docs: DataFrame, name: str = "name", text: str = "text") -> None:
        """Upserts documents (name, text): a document's old chunks and vectors go first. One without chunks is left out."""
        rows = docs.select(F.col(name).cast("string").alias("name"), F.col(text).alias("text")).dropDuplicates(["name"])
        chunks = chunk.chunk_any(rows, "name", "text", self.size, self.overlap)
        old = self.store.read("chunks").join(rows.select(F.col("name").alias("document_name")), "document_name", "left_semi").select("id")
        self.store.delete("vectors", old)
        self.store.delete("chunks", old)
        self.store.put("chunks", chunks)
        new = self.store.read("chunks").join(rows.select(F.col("name").alias("document_name")), "document_name", "left_semi")
        self.store.put("vectors", new.select("id", self.embed(F.col("text")).alias("vector")))
        totals = new.groupBy("document_name").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        sizes = rows.select("name", F.octet_length("text").cast("long").alias("size_bytes"))
        self.store.put("documents", totals.join(sizes, F.col("document_name") == F.col("name")).select("name", "size_bytes", "chunk_count", F.current_timestamp().alias("created_at")))

    def delete(self, name: str) -> None:
        self.store.delete_document(name)

    def clear(self) -> None:
        self.store.clear()

    @property
    def chunks(self) -> DataFrame:
        return self.store.read("chunks")

    @property
    def vectors(self) -> DataFrame:
        return self.store.read("vectors")

    def names(self) -> DataFrame:
        return self.chunks.select("document_name").distinct().orderBy("document_name")

    def totals(self) -> DataFrame:
        return chunk.document_totals(self.chunks)

    def _in(self, document: str | None) -> DataFrame:
        return self.chunks if document is None else self.chunks.where(F.col("document_name") == document)

    def dense(self, query: str, k: int = 5, document: str | None = None) -> DataFrame:
        vectors = self.vectors if document is None else self.vectors.join(self._in(document).select("id"), "id", "left_semi")
        asked = self.spark.range(1).select(self.embed(F.lit(query)).alias("vector"))
        return knn.knn(vectors, asked, k, key="id", column="vector")

    def index(self) -> bm25.BM25Index:
        """The lexical index of the chunks as they are now, saved beside them when it is first asked for."""
        version = self.store.version("chunks")
        if version is None:
            return bm25.BM25Index.build(self.chunks, "id", "text")
        path = f"{self.store.path}/lexical/{version}"
        if not self.store.exists(f"{path}/constants/_SUCCESS"):
            return bm25.BM25Index.create(self.chunks, path, "id", "text")
        return bm25.BM25Index.load(self.spark, path)

    def sparse(self, query: str, k: int = 5, document: str | None = None) -> DataFrame:
        return self.index().search(query, k, among=None if document is None else self._in(document).select("id"))

    def search(self, query: str, mode: str = "hybrid", k: int = 5, document: str | None = None) -> DataFrame:
        """(rank, id, combined_score, document_name, chunk_index, text, ...), best first."""
        if mode == "dense":
            found = self.dense(query, k, document).select("id", F.col("score").alias("combined_score"))
        elif mode == "sparse":
            found = hybrid.relative_scores(self.sparse(query, k, document)).select("id", "combined_score")
        elif mode == "hybrid":
            found = hybrid.reciprocal_rank_fusion(self.dense(query, 2 * k, document), self.sparse(query, 2 * k, document), k).select("id", "combined_score")
        else:
            raise ValueError(f"mode is dense, sparse or hybrid, not {mode!r}")
        ranked = hybrid.ranked(found.withColumnRenamed("combined_score", "score"), "found")
        return F.broadcast(ranked).join(self.chunks, "id").select(F.col("found_rank").alias("rank"), "id", F.col("found_score").alias("combined_score"), "document_name", "chunk_index", "text").orderBy("rank")

    def answer(self, query: str, mode: str = "hybrid", k: int = 5, document: str | None = None, preset: rag.Preset = rag.LIBRARY) -> DataFrame:
        found = self.search(query, mode, k, document).where("rank <= 4")
        return rag.answer(found.select(F.lit(0).alias("qid"), F.col("rank").alias("ord"), "id", "document_name", "chunk_index", "text"), query, preset)

    def find_similar(self, chunk_id: str, k: int = 5) -> DataFrame:
        return knn.find_similar(self.vectors, chunk_id, k, "id", "vector").join(self.chunks, "id").orderBy("distance", "id")

    def stats(self) -> DataFrame:
        return metrics.memory_footprint(self.vectors, "vector")

    def vector(self, chunk_id: str, tombstones: DataFrame | None = None) -> list[float] | None:
        """The vector of one chunk; None where there is none, or it is deleted."""
        row = self.vectors.where(F.col("id") == chunk_id)
        if tombstones is not None:
            row = row.join(tombstones.select(F.col(tombstones.columns[0]).alias("id")), "id", "left_anti")
        found = row.first()
        return None if found is None else list(found.vector)

    def sizes(self, tombstones: DataFrame | None = None) -> DataFrame:
        """One row: size, all vectors, and active_size, those not deleted."""
        return ann.sizes(self.vectors, tombstones)

    def rehydrate(self, config: ann.GraphConfig = ann.GraphConfig()) -> tuple[DataFrame, bm25.BM25Index] | None:
        """The graph and the lexical index of what is stored, built anew; None unless there are both chunks and vectors."""
        return (self.graph(config), self.index()) if self.store.is_ready() else None

    def import_snapshot(self, files: DataFrame, form: str = "binary") -> None:
        """Replaces the collection by what snapshot files hold (a binary column ``content``): chunks, the vectors of live
        nodes, and a document for each name in the chunks. The lexical index follows the chunks."""
        chunks, nodes = snapshot.read_chunks(files, form), snapshot.read_snapshots(files, form)
        self.store.replace("chunks", chunks)
        self.store.replace("vectors", nodes.select("id", "vector"))
        now = self.store.read("chunks").groupBy("document_name").agg(F.sum(F.octet_length("text")).alias("size_bytes"), F.count(F.lit(1)).cast("int").alias("chunk_count"))
        self.store.replace("documents", now.select(F.col("document_name").alias("name"), "size_bytes", "chunk_count", F.current_timestamp().alias("created_at")))

    def graph(self, config: ann.GraphConfig = ann.GraphConfig()) -> DataFrame:
        """A graph over the vectors; node ids are hashes of chunk ids, which ``graph_ids`` maps back."""
        return ann.build_graph(self.vectors.select(F.xxhash64("id").alias("vec_id"), F.col("vector").alias("embedding")), config)

    def graph_ids(self) -> DataFrame:
        return self.vectors.select(F.xxhash64("id").alias("node_id"), "id")
