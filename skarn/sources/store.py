"""A catalog of versioned Parquet tables: put (upsert), get, delete, and snapshots of the whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables and their keys.
KEYS = {"documents": "name", "chunks": "id", "vectors": "id", "snapshots": "id", "preferences": "key", "history": "query"}
SCHEMAS = {
    "documents": "name string, size_bytes long, chunk_count int, created_at timestamp",
    "chunks": "id string, document_name string, chunk_index int, total_chunks int, text string, start_char int, end_char int, token_count_estimate int",
    "vectors": "id string, vector array<float>",
    "snapshots": "id string, title string, timestamp timestamp, chunk_count int, path string",
    "preferences": "key string, value string",
    "history": "query string, mode string, ts timestamp",
}


class Store:
    """Each put or delete writes a new version of a table and then moves the pointer to it, so a reader sees a whole
    version or the one before, and a failed write leaves no trace in use. Files go through Spark, so any file system
    will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, table: str) -> str | None:
        names = sorted(x.getPath().getName() for x in (self._fs.globStatus(self._at(f"{self.path}/{table}/CURRENT-*")) or []))
        return names[-1].partition("_")[2] if names else None

    def _commit(self, table: str, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{table}/{version}")
        old = sorted(x.getPath().getName() for x in (self._fs.globStatus(self._at(f"{self.path}/{table}/CURRENT-*")) or []))
        number = int(old[-1].split("-")[1].split("_")[0]) + 1 if old else 0
        # creating the pointer fails if another writer has taken the number: its version stands, and ours is not lost silently
        if not self._fs.createNewFile(self._at(f"{self.path}/{table}/CURRENT-{number:012d}_{version}")):
            raise RuntimeError(f"{table} was written by another session meanwhile")

    def read(self, table: str) -> DataFrame:
        version = self._pointer(table)
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{table}/{version}")

    def put(self, table: str, rows: DataFrame) -> None:
        """Upsert by key; of rows with one key in a put, any one stays."""
        key = KEYS[table]
        new = rows.select(*(F.col(c).cast(t) for c, t in _fields(SCHEMAS[table]))).dropDuplicates([key])
        self._commit(table, self.read(table).join(new.select(key), key, "left_anti").unionByName(new))

    def replace(self, table: str, rows: DataFrame) -> None:
        """The table holds these rows and no others; of rows with one key, any one stays."""
        self._commit(table, rows.select(*(F.col(c).cast(t) for c, t in _fields(SCHEMAS[table]))).dropDuplicates([KEYS[table]]))

    def version(self, table: str) -> str | None:
        """The name of the version that readers see; None before the first write."""
        return self._pointer(table)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def get(self, table: str, value: str) -> DataFrame:
        return self.read(table).where(F.col(KEYS[table]) == value)

    def delete(self, table: str, keys: DataFrame) -> None:
        """Without the rows whose key is in the first column of ``keys``."""
        gone = keys.select(F.col(keys.columns[0]).alias(KEYS[table])).distinct()
        self._commit(table, self.read(table).join(gone, KEYS[table], "left_anti"))

    def delete_document(self, name: str) -> None:
        """The document, its chunks and their vectors."""
        ids = self.read("chunks").where(F.col("document_name") == name).select("id")
        self.delete("vectors", ids)
        self._commit("chunks", self.read("chunks").where(~F.col("document_name").eqNullSafe(name)))
        self._commit("documents", self.read("documents").where(~F.col("name").eqNullSafe(name)))

    def clear(self) -> None:
        for table in (*KEYS, "lexical"):
            self._fs.delete(self._at(f"{self.path}/{table}"), True)

    def vacuum(self) -> None:
        """Removes the versions and pointers that are not current."""
        for table in KEYS:
            now = self._pointer(table)
            for x in self._fs.globStatus(self._at(f"{self.path}/{table}/*")) or []:
                if now not in x.getPath().getName():
                    self._fs.delete(x.getPath(), True)
        now = self._pointer("chunks")
        for x in self._fs.globStatus(self._at(f"{self.path}/lexical/*")) or []:
            if x.getPath().getName() != now:
                self._fs.delete(x.getPath(), True)

    def is_ready(self) -> bool:
        """Whether there is anything to rehydrate: both chunks and vectors."""
        return not self.read("chunks").isEmpty() and not self.read("vectors").isEmpty()

    def set_preference(self, key: str, value: object) -> None:
        self.put("preferences", self.spark.createDataFrame([(key, json.dumps(value))], SCHEMAS["preferences"]))

    def preference(self, key: str, default: object = None) -> object:
        row = self.get("preferences", key).first()
        return json.loads(row.value) if row else default

    def remember(self, query: str, mode: str, keep: int = 20) -> None:
        """A search in the history: newest first, one entry a query, ``keep`` at most."""
        query = query.strip()
        if query:
            new = self.spark.range(1).select(F.lit(query).alias("query"), F.lit(mode).alias("mode"), F.current_timestamp().alias("ts"))
            rows = self.read("history").where(F.col("query") != query).unionByName(new)
            self._commit("history", recent_searches(rows, keep))


def recent_searches(history: DataFrame, keep: int = 20) -> DataFrame:
    """The latest entry of each query, newest first."""
    latest = history.groupBy("query").agg(F.max(F.struct("ts", "mode")).alias("x")).select("query", "x.mode", "x.ts")
    return latest.orderBy(F.desc("ts"), "query").limit(keep)


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.strip().split(" ", 1)) for x in schema.split(", ")]

