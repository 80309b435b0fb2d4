"""Streams: documents into a collection as they come, and token streams back into texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(stream: DataFrame, add: Callable[[DataFrame], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Every micro-batch goes through ``add``, an upsert by key, so a batch that is run again after a failure changes
    nothing. ``once``: what is there now, then stop; else until stopped."""
    writer = stream.writeStream.foreachBatch(lambda rows, _: add(rows)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def token_stream(lines: DataFrame, key: str = "stream", order: str = "seq", value: str = "line", field: str = "response") -> DataFrame:
    """(key, text, tokens): the tokens of NDJSON lines, joined in order; malformed lines and lines without the field are
    passed over. For parts that split a line, see ``lines_of``."""
    token = F.get_json_object(F.col(value), f"$.{field}")
    rows = lines.select(key, order, token.alias("t")).where("t is not null")
    parts = F.sort_array(F.collect_list(F.struct(order, "t")))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"), F.count(F.lit(1)).alias("tokens"))


def lines_of(parts: DataFrame, key: str = "stream", order: str = "seq", value: str = "part") -> DataFrame:
    """(key, seq, line) of a byte stream's parts, which may end within a line: the rest waits for the next part. One
    stream is one response, so its parts fit in a row."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda p: p[value]), "")
    rows = parts.groupBy(key).agg(whole.alias("w"))
    return rows.select(key, F.posexplode(F.split("w", "\n")).alias("seq", "line")).where("line <> ''")


def progress_events(items: DataFrame, step: int = 5, batch: str = "batch") -> DataFrame:
    """(batch, done, total, percent): an event after every ``step`` items of a batch and after its last; items are counted
    by batch, so an event is made from a count and not from the items."""
    totals = items.groupBy(batch).agg(F.count(F.lit(1)).alias("total"))
    done = F.explode(F.array_distinct(F.concat(F.when(F.col("total") >= step, F.sequence(F.lit(step).cast("long"), F.col("total"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>")), F.array("total"))))
    return totals.select(batch, done.alias("done"), "total").withColumn("percent", F.floor(F.col("done") / F.col("total") * 100 + 0.5).cast("int"))
