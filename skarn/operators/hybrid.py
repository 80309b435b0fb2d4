"""Rank fusion of a dense and a sparse result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """Ranks by score, from 1. A result list has at most its k rows, so one window over it has a bound."""
    return rows.select("id", F.col("score").alias(f"{name}_score"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias(f"{name}_rank"))


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, k: int = 10, constant: int = 60, dense_weight: float = 1.0, sparse_weight: float = 0.8, round_to: int | None = None) -> DataFrame:
    """(id, combined_score, dense_score, dense_rank, sparse_score, sparse_rank) of two result lists (id, score): the sum of
    weight / (constant + rank), as a share of the best. Ties go to the better dense rank, sparse rank, id."""
    both = ranked(dense, "dense").join(ranked(sparse, "sparse"), "id", "full_outer")
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (F.lit(constant) + F.col(rank)), F.lit(0.0))
    both = both.withColumn("raw", part(dense_weight, "dense_rank") + part(sparse_weight, "sparse_rank"))
    top = F.max("raw").over(Window.partitionBy())
    both = both.withColumn("combined_score", F.when(top > 0, F.least(F.lit(1.0), F.col("raw") / top)).otherwise(F.col("raw")))
    if round_to is not None:
        both = both.withColumn("combined_score", F.round("combined_score", round_to))
    order = [F.desc("combined_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "id"]
    return both.select("id", "combined_score", "dense_score", "dense_rank", "sparse_score", "sparse_rank").orderBy(*order).limit(k)


def relative_scores(rows: DataFrame, round_to: int | None = None) -> DataFrame:
    """(id, score, combined_score): scores as shares of the best."""
    share = F.col("score") / F.max("score").over(Window.partitionBy())
    return rows.select("id", "score", (F.round(share, round_to) if round_to is not None else share).alias("combined_score"))
