"""Okapi BM25 over an inverted index kept as DataFrames, or as tables sorted by term."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, tokens
from ..sources.scratch import remove, spread

_STOP = frozenset(STOPWORDS)


def query_tokens(text: str) -> list[str]:
    """The tokens of a question, as of a document."""
    return [w for w in re.split(r"[^a-z0-9_\-]+", text.lower()) if len(w) > 1 and w not in _STOP]


@dataclass
class BM25Index:
    """postings (term, id, tf, dl), lengths (id, dl) and the constants. A posting holds its document's length, so a search
    joins nothing as large as the corpus. Documents without a token count in N and avgdl. ``terms`` (term, df) and
    ``totals`` (one row: n, total_dl) are there once an index has been saved; otherwise they are counted when asked for."""

    postings: DataFrame
    lengths: DataFrame
    k1: float = 1.2
    b: float = 0.75
    terms: DataFrame | None = None
    totals: DataFrame | None = None

    @staticmethod
    def build(docs: DataFrame, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> BM25Index:
        return BM25Index._of(docs.select(F.col(key).alias("id"), tokens(F.col(text)).alias("words")), k1, b)

    @staticmethod
    def _of(rows: DataFrame, k1: float, b: float) -> BM25Index:
        """From (id, words). The length goes with its row, not with its id, as rows may share an id."""
        postings = rows.select("id", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        return BM25Index(postings, rows.select("id", F.size("words").alias("dl")), k1, b)

    @staticmethod
    def create(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> BM25Index:
        """An index of documents, saved: they are cut into words once, and these are written for as long as it takes."""
        spark = docs.sparkSession
        rows = spread(docs.select(F.col(key).alias("id"), F.col(text).alias("t")))
        rows.select("id", tokens(F.col("t")).alias("words")).write.parquet(f"{path}/words")
        made = BM25Index._of(spark.read.parquet(f"{path}/words"), k1, b).save(path)
        remove(spark, f"{path}/words")
        return made

    def save(self, path: str) -> BM25Index:
        """Writes the index and returns it as read from there: postings and document frequencies sorted by term, so that a
        search reads the row groups of its terms alone. Postings are written before they are sorted, as the ranges of
        terms are found by a pass of their own."""
        spark = self.postings.sparkSession
        self.postings.select("term", "id", "tf", "dl").write.parquet(f"{path}/counted")
        counted = spark.read.parquet(f"{path}/counted")
        counted.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")
        counted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        remove(spark, f"{path}/counted")
        self.lengths.write.parquet(f"{path}/lengths")
        spark.read.parquet(f"{path}/lengths").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_dl")).write.parquet(f"{path}/totals")
        spark.createDataFrame([(self.k1, self.b)], "k1 double, b double").write.parquet(f"{path}/constants")
        return BM25Index.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BM25Index:
        """A saved index."""
        k1, b = spark.read.parquet(f"{path}/constants").first()
        postings, lengths, terms, totals = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms", "totals"))
        return BM25Index(postings, lengths, k1, b, terms, totals)

    def stats(self) -> DataFrame:
        """One row: n, total_dl, avgdl."""
        totals = self.totals if self.totals is not None else self.lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_dl"))
        return totals.withColumn("avgdl", F.col("total_dl") / F.greatest(F.lit(1), F.col("n")))

    def document_frequency(self) -> DataFrame:
        return self.terms if self.terms is not None else self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def remove(self, ids: DataFrame) -> BM25Index:
        """Without the documents of ``ids`` (its first column)."""
        gone = ids.select(F.col(ids.columns[0]).alias("id"))
        return BM25Index(self.postings.join(gone, "id", "left_anti"), self.lengths.join(gone, "id", "left_anti"), self.k1, self.b)

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> BM25Index:
        """With these documents, in place of any of the same id."""
        new, kept = BM25Index.build(docs, key, text, self.k1, self.b), self.remove(docs.select(key))
        return BM25Index(kept.postings.unionByName(new.postings), kept.lengths.unionByName(new.lengths), self.k1, self.b)

    def _scored(self, met: DataFrame, where: Column | str | None, among: DataFrame | None = None) -> DataFrame:
        """(qid, id, score) of postings met by query terms, with df and qtf."""
        rows = met if where is None else met.where(where)
        if among is not None:
            rows = rows.join(among.select(F.col(among.columns[0]).alias("id")), "id", "left_semi")
        rows = rows.crossJoin(F.broadcast(self.stats()))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / F.col("avgdl")))
        return rows.groupBy("qid", "id").agg(F.sum(F.col("qtf") * idf * weight).alias("score"))

    def search(self, query: str, k: int = 10, where: Column | str | None = None, round_to: int | None = None, among: DataFrame | None = None) -> DataFrame:
        """(id, score) of the best k. A repeated query term counts each time; ``where``, a predicate on id, and ``among``,
        ids in its first column, apply to what is scored, while N, df and avgdl stay those of the index. Ties go to the
        smaller id."""
        spark = self.postings.sparkSession
        counts = Counter(query_tokens(query))
        # the terms of one question: as literals they reach the scan of the postings
        asked = spark.createDataFrame([(0, t, n) for t, n in sorted(counts.items())], "qid int, term string, qtf int")
        wanted = F.col("term").isin(sorted(counts)) if counts else F.lit(False)
        met = self.postings.where(wanted)
        df = self.terms.where(wanted) if self.terms is not None else met.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        rows = self._scored(met.join(F.broadcast(asked), "term").join(F.broadcast(df), "term"), where, among)
        if round_to is not None:
            rows = rows.withColumn("score", F.round("score", round_to))
        return rows.select("id", "score").orderBy(F.desc("score"), "id").limit(k)

    def search_batch(self, queries: DataFrame, k: int = 10, query_key: str = "item_id", text: str = "text", round_to: int | None = None, broadcast_terms: int = 500_000) -> DataFrame:
        """(qid, id, score, rank) of the best k of each query. Up to ``broadcast_terms`` query terms, counted first, are
        broadcast, so that the postings of a frequent term stay where they are; more are joined by term, and as nothing
        is grouped between the postings' exchange and the join, Spark can split a frequent term."""
        words = queries.select(F.col(query_key).alias("qid"), F.explode(tokens(F.col(text))).alias("term"))
        asked = words.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
        asked = asked.join(self.document_frequency(), "term")
        few = asked.limit(broadcast_terms + 1).count() <= broadcast_terms
        rows = self._scored(self.postings.join(F.broadcast(asked) if few else asked, "term"), None)
        if round_to is not None:
            rows = rows.withColumn("score", F.round("score", round_to))
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
