"""Exact nearest neighbours: one query, many queries, filters, tombstones, quantized scans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quantize, vector


def _one(query: DataFrame, column: str) -> DataFrame:
    """The query as a single row, so that its broadcast has a bound."""
    return F.broadcast(query.select(F.col(column).alias("__q")).limit(1))


def knn(vectors: DataFrame, query: DataFrame, k: int = 10, metric: str = "cosine", where: Column | str | None = None, key: str = "vec_id", column: str = "embedding", quantization: str = "f32", exclude: DataFrame | None = None, round_to: int | None = None, score_by_metric: bool = False) -> DataFrame:
    """(id, distance, score) of the k nearest to the first row of ``query``. ``where`` filters before the top-k, and so
    does ``exclude``, a table of tombstones (its first column). Ties go to the smaller id. The scan's score is the dot
    product over 0 to 1 whatever the metric; ``score_by_metric`` maps the distance instead. With ``round_to``,
    distances are rounded before they are compared."""
    rows = vectors.where(where) if where is not None else vectors
    if exclude is not None:
        rows = rows.join(exclude.select(F.col(exclude.columns[0]).alias(key)), key, "left_anti")
    rows = rows.select(F.col(key).alias("id"), F.col(column).alias("__v")).crossJoin(_one(query, column))
    v, q = F.col("__v"), F.col("__q")
    if quantization == "sq8":
        distance = quantize.sq8_distance(quantize.sq8(v), quantize.sq8(q))
    elif quantization == "bq":
        distance = quantize.bq_distance(quantize.bq(v), quantize.bq(q))
    else:
        distance = vector.vector_distance(v, q, metric)
    scored = vector.score(F.col("distance"), metric, quantization) if score_by_metric or quantization != "f32" else F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__dot")))
    dots = [vector.dot(v, q).alias("__dot")] if quantization == "f32" and not score_by_metric and metric != "dot" else []
    rows = rows.select("id", distance.alias("distance"), *dots)
    if not dots and quantization == "f32" and not score_by_metric:
        rows = rows.withColumn("__dot", -F.col("distance"))
    rows = rows.select("id", "distance", scored.alias("score"))
    if round_to is not None:
        rows = rows.select("id", F.round("distance", round_to).alias("distance"), F.round("score", round_to).alias("score"))
    return rows.orderBy("distance", "id").limit(k)


def find_similar(vectors: DataFrame, id_: int | str, k: int = 5, key: str = "vec_id", column: str = "embedding", **params) -> DataFrame:
    """The k nearest to a stored vector, itself left out."""
    return knn(vectors.where(F.col(key) != F.lit(id_)), vectors.where(F.col(key) == F.lit(id_)), k, key=key, column=column, **params)


BATCH = "qid long, id long, distance double"


def distances(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """A row for each query, a column for each vector."""
    product = q @ v.T
    if metric == "cosine":
        return 1 - np.clip(product, -1, 1)
    if metric == "dot":
        return -product
    return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * product, 0))


class Nearest:
    """The k nearest so far of each query, ties to the smaller id; places not yet taken are infinitely far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids, self.distance = np.zeros((queries, 0), np.int64), np.zeros((queries, 0))

    def add(self, ids: np.ndarray, distance: np.ndarray) -> None:
        if distance.shape[1] > self.k:
            # all up to the k-th distance may be among the k nearest; of equally far ones the smaller ids are
            kth = np.partition(distance, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            near = distance <= kth
            width = int(near.sum(axis=1).max())
            order = np.argsort(~near, axis=1, kind="stable")[:, :width] if width < distance.shape[1] else np.broadcast_to(np.arange(distance.shape[1]), distance.shape)
            some, far = ids[order], np.where(np.take_along_axis(near, order, 1), np.take_along_axis(distance, order, 1), np.inf)
        else:
            some, far = np.broadcast_to(ids, distance.shape), distance
        all_ids, all_far = np.concatenate((self.ids, some), axis=1), np.concatenate((self.distance, far), axis=1)
        order = np.lexsort((all_ids, all_far), axis=1)[:, : self.k]
        self.ids, self.distance = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_far, order, 1)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", key: str = "vec_id", query_key: str = "vec_id", column: str = "embedding", most_queries: int = 20_000, round_to: int | None = None) -> DataFrame:
    """(qid, id, distance, rank): the k nearest of every query, by matrix products over batches of vectors.

    Up to ``most_queries`` queries are broadcast, counted first; more pass in blocks of that size, one scan each. A task
    keeps the k nearest of each query over all its batches and emits them once, so what is shuffled grows with tasks
    and queries, and not with the vectors."""
    spark = vectors.sparkSession
    asked = queries.select(F.col(query_key).cast("long").alias("q"), F.col(column).cast("array<double>").alias("v")).where("v is not null")
    count = asked.count()
    parts = max(1, -(-count // most_queries))
    out = None
    for part in range(parts):
        block = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part)).toPandas()
        if not len(block):
            continue
        shared = spark.sparkContext.broadcast((block.q.to_numpy(), np.stack(block.v.to_numpy())))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            best = Nearest(len(qids), k)
            for batch in batches:
                # so many rows at once that the distances to all queries take a bounded room
                for low in range(0, batch.num_rows, max(1, 4_000_000 // len(qids))):
                    some = batch.slice(low, max(1, 4_000_000 // len(qids)))
                    v = some.column(1).flatten().to_numpy().reshape(some.num_rows, -1)
                    distance = distances(v, q, metric)
                    best.add(some.column(0).to_numpy(), distance if round_to is None else np.round(distance, round_to))
            ids, found, valid = best.ids, best.distance, np.isfinite(best.distance)
            if valid.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, valid.sum(axis=1))), pa.array(ids[valid]), pa.array(found[valid])], names=["qid", "id", "distance"])

        found = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("v is not null").mapInArrow(nearest, BATCH)
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], BATCH)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)

