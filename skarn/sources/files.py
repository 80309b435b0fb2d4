"""File sources: whole text files, pages of extracted PDF text, names from URLs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CODE_EXTENSIONS, trimmed, url_filename

#: Extensions that are read as text.
TEXT_EXTENSIONS = ["txt", "md", "markdown", "csv", "log", *CODE_EXTENSIONS]


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, text, size_bytes): a row per file, the whole file as one text."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size_bytes"))
    named = F.lower(F.element_at(F.split("name", r"\."), -1)).isin(TEXT_EXTENSIONS)
    return rows.where(named).select("name", F.col("value").alias("text"), "size_bytes")


def pdf_text(pages: DataFrame) -> DataFrame:
    """(name, text, page_count) of extracted pages (name, page_no, items array<string>): items joined by spaces, each page
    under its marker, the whole trimmed. Extraction itself needs a PDF library, which is the caller's choice."""
    part = F.concat(F.lit("\n\n--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n\n"), F.array_join("items", " "))
    grouped = pages.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("page_no", part.alias("p")))).alias("ps"), F.count(F.lit(1)).cast("int").alias("page_count"))
    return grouped.select("name", trimmed(F.array_join(F.transform("ps", lambda x: x["p"]), "")).alias("text"), "page_count")


def named_by_url(rows: DataFrame, url: str = "url") -> DataFrame:
    """With a column ``name``, the last segment of the URL's path."""
    return rows.withColumn("name", url_filename(F.col(url)))


def samples(spark: SparkSession) -> DataFrame:
    """(name, text, size_bytes) of the documents that come with the package. They are read on the driver, as the
    package's folder need not be shared, and are few."""
    folder = Path(__file__).parent.parent / "samples"
    rows = [(p.name, p.read_text(encoding="utf-8"), p.stat().st_size) for p in sorted(folder.glob("*.md"))]
    return spark.createDataFrame(rows, "name string, text string, size_bytes long")
