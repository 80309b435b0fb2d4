"""Latency, memory and selection figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latency(samples: DataFrame, column: str = "ms") -> DataFrame:
    """(iterations, avg, p50, p95, p99, qps): percentiles are the values at floor(n * p) of the sorted samples, found by
    a rank over counts of equal values, so that no task sorts all samples."""
    counts = samples.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    total = samples.agg(F.count(column).alias("n"), F.sum(column).alias("s"))
    wanted = [(0.5, "p50"), (0.95, "p95"), (0.99, "p99")]
    part = F.floor(F.log(F.greatest(F.abs("v"), F.lit(1e-9))) * 8) * F.signum("v")
    rows = counts.withColumn("part", part)
    parts = rows.groupBy("part").agg(F.sum("c").alias("pc"), F.min("v").alias("low"))
    ahead = parts.select("part", F.coalesce(F.sum("pc").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    upto = F.col("ahead") + F.sum("c").over(Window.partitionBy("part").orderBy("v"))
    ranked = rows.join(F.broadcast(ahead), "part").withColumn("upto", upto).crossJoin(F.broadcast(total))
    found = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("v"))).alias(name) for p, name in wanted]
    return ranked.groupBy("n", "s").agg(*found).select(F.col("n").alias("iterations"), (F.col("s") / F.col("n")).alias("avg"), "p50", "p95", "p99", F.floor(F.col("n") / F.col("s") * 1000 + 0.5).alias("qps"))


def memory_footprint(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: bytes of the vectors in each form and of the links, and the savings in percent."""
    rows = vectors.agg(F.count(column).alias("n"), F.coalesce(F.max(F.size(column)), F.lit(0)).alias("dim"))
    n, d = F.col("n"), F.col("dim")
    return rows.select("n", "dim", (n * d * 4).alias("f32_bytes"), (n * (d + 4)).alias("sq8_bytes"), F.floor(n * d / 8).alias("bq_bytes"), (n * 16 * 4 * 2).alias("link_bytes"), F.round((1 - (d + 4) / (d * 4)) * 100, 1).alias("sq8_saving"), F.round((1 - F.lit(1) / 32) * 100, 1).alias("bq_saving"))


def grade(recall: Column) -> Column:
    return F.when(recall >= 95, "green").when(recall >= 80, "amber").otherwise("red")
