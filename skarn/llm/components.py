"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a").toDF("a", "b"))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = written(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = links.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` has long columns a and b. Returns (id, component) for every id in a link: the smallest id reachable.

    Each round is a large-star and a small-star step: the links shrink to stars around the smallest ids in about the
    logarithm of the longest chain. Minima are taken before the exchange too, and are written, so that no aggregate
    stands between an exchange and a join: Spark can then split the join where an id has very many links. Each round is
    written to the shared folder. Null ends and self links are left out.
    """
    now = written(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftrightunsigned(F.xxhash64("b", "a"), 24))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        before, now = state, written(_small_star(written(_large_star(now), "links")), "links")
    raise RuntimeError("the components did not settle")
