"""Tables and files in the folder that every executor of the cluster can reach."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a new local one, on a local master alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skarn-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        _MADE.append((spark, found))
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/skarn-{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many tasks as run at once, where its scan has fewer: a small table of one file, whose rows are
    dear to work on. Any larger table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables made by ``written`` that nothing reads any more, and lets Spark remove the files of shuffles that
    nothing refers to: it does so when the driver's JVM collects what belongs to them."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            remove(spark, folder)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like these that no column has, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@atexit.register
def _remove_all() -> None:
    for spark, path in reversed(_MADE):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended, and Python ends too
            return
