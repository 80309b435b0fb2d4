"""Token-ID output: documents as independent Zstandard frames of ids, with a seek table and checksums.

``write_tokens`` sorts the documents by key over range partitions, and each task writes its own files: one frame per
document, so a reader decompresses only the documents it asks for. The directory of a file holds the keys in order.
A file gets its final name only when it is whole and its name is new for each attempt; the manifest names only files
of tasks that Spark has committed, so a lost executor or a repeated task leaves no file in use half written.

Nulls: a null text is an empty one (just the end id); a null key sorts first. Repeated keys are kept, each as its own
frame. An empty table gives an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encode import encoder, little_endian_u32
from .seekable import Reader, Writer
from .shared import new_path, quoted, written

MANIFEST = "part int, file int, path string, width int, n_docs long, n_tokens long"
READ = "doc_id long, path string, frame int, at long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, key: str = "doc_id", text: str = "text", file_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Writes files of at most about ``file_bytes`` below ``folder``; returns the manifest, a row per file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        part, file, out, keys, tokens, made = TaskContext.get().partitionId(), 0, None, [], 0, []

        def close():
            out.close(packed_directory(keys, enc.width))
            made.append((part, file, path, enc.width, len(keys), tokens))

        try:
            for batch in batches:
                for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if out is None:
                        path = f"{folder}/tokens-{part:05d}-{file:05d}-{uuid.uuid4().hex}.ids.zst"
                        out, keys, tokens = Writer(path, level), [], 0
                    content = enc.raw(value.as_py()) + end
                    out.frame(content)
                    keys.append(k)
                    tokens += len(content) // enc.width
                    if out.size >= file_bytes:
                        close()
                        file, out = file + 1, None
            if out is not None:
                close()
                out = None
        finally:
            if out is not None:
                out.drop()
        yield pa.RecordBatch.from_pandas(_frame(made), schema=_MANIFEST)

    rows = docs.select(F.col(quoted(key)).cast("long").alias("k"), F.col(quoted(text)).cast("string").alias("t"))
    return written(rows.repartitionByRange("k").sortWithinPartitions("k").mapInArrow(write, MANIFEST), "token-manifest")


_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def _frame(rows: list[tuple]):
    import pandas as pd

    return pd.DataFrame(rows, columns=_MANIFEST.names)


def with_starts(manifest: DataFrame, group: int = 1024) -> DataFrame:
    """Adds ``start``, the ids in all files before: sums within groups of parts, then over the groups."""
    rows = manifest.withColumn("g", F.floor(F.col("part") / group))
    inner = Window.partitionBy("g").orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("g").agg(F.sum("n_tokens").alias("s"))
    ahead = sums.select("g", F.coalesce(F.sum("s").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return rows.join(ahead, "g").withColumn("start", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).drop("g", "ahead")


def packed_directory(keys: list[int | None], width: int) -> bytes:
    """Keys, which of them are null, and the bytes of an id."""
    return np.array([k or 0 for k in keys], dtype="<i8").tobytes() + bytes(k is None for k in keys) + bytes([width])


def directory(reader: Reader) -> tuple[list[int | None], int]:
    """The keys of a file's frames, and the bytes of an id."""
    n = len(reader)
    keys = np.frombuffer(reader.directory, dtype="<i8", count=n).tolist()
    nulls = reader.directory[8 * n : 9 * n]
    return [None if gone else k for k, gone in zip(keys, nulls, strict=True)], reader.directory[9 * n]


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row per document, read back from the files: key, file, frame, ids before it, count and CRC-32 of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(path)
                keys, width = directory(reader)
                counts = reader.table[:, 1] // width
                at = start + np.cumsum(counts) - counts
                sums = [zlib.crc32(little_endian_u32(np.frombuffer(x, dtype=f"<u{width}"))) for x in reader.frames()]
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([path] * len(keys), pa.string()), pa.array(np.arange(len(keys), dtype=np.int32)), pa.array(at), pa.array(counts), pa.array(sums, pa.int64())], names=["doc_id", "path", "frame", "at", "n_tokens", "ids_crc32"])

    return with_starts(manifest).select("path", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(read, READ)


def fetch(path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document, by its key, without reading any other frame."""
    reader = Reader(path)
    keys, width = directory(reader)
    # null keys come first, the others are sorted
    nulls = sum(1 for k in itertools.takewhile(lambda k: k is None, keys))
    low, high = bisect.bisect_left(keys, doc_id, nulls), bisect.bisect_right(keys, doc_id, nulls)
    found = [np.frombuffer(reader.frame(k), dtype=f"<u{width}") for k in range(low, high)]
    reader.close()
    return found


def token_output(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Writes to the shared folder and reads back; columns doc_id, start, n_tokens, ids_crc32, path, frame."""
    spark = docs.sparkSession
    manifest = write_tokens(docs, vocabulary, new_path(spark, "tokens"), end_id)
    return read_tokens(spark, manifest).select("doc_id", F.col("at").alias("start"), "n_tokens", "ids_crc32", "path", "frame")
