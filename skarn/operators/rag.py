"""Extractive answers with citations, prompts, and conversation windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt, query_terms, sentences, term_matches, trimmed


@dataclass(frozen=True)
class Preset:
    """Fixed values of one way to answer."""

    sentences: int
    key: int
    base: float
    most: float
    excerpt: int
    trim: bool
    fallback: int | None


LIBRARY = Preset(4, 40, 0.6, 0.98, 180, False, None)
WORKER = Preset(3, 35, 0.55, 0.88, 160, True, 140)
NOTHING = "No relevant information found in the indexed documents to answer this query."


def scored_sentences(contexts: DataFrame, question: Column | str) -> DataFrame:
    """(qid, ord, pos, sentence, matches, score): the sentences of contexts (qid, ord from 1, text) that hold a term of
    the question: the share of its terms, less for later contexts."""
    q = F.lit(question) if isinstance(question, str) else question
    rows = contexts.where("ord <= 5").select("qid", "ord", query_terms(q).alias("terms"), F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    rows = rows.withColumn("matches", term_matches(F.col("sentence"), F.col("terms"))).where("matches > 0")
    return rows.withColumn("score", F.col("matches") / F.greatest(F.lit(1), F.size("terms")) * (1 / (1 + (F.col("ord") - 1) * 0.25))).drop("terms")


def picked_sentences(contexts: DataFrame, question: Column | str, preset: Preset = LIBRARY) -> DataFrame:
    """(qid, rank, ord, sentence, score): the best sentences, of those that begin alike only the best."""
    order = [F.desc("score"), "ord", "pos"]
    rows = scored_sentences(contexts, question).withColumn("key", F.lower(F.substring("sentence", 1, preset.key)))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("qid", "key").orderBy(*order))).where("n = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= preset.sentences)
    return rows.select("qid", "rank", "ord", "sentence", "score")


def answer(contexts: DataFrame, question: Column | str, preset: Preset = LIBRARY, asked: DataFrame | None = None) -> DataFrame:
    """(qid, summary, bullet_points, citations, confidence) for contexts (qid, ord, id, document_name, chunk_index, text),
    a row per qid that has a context; the first context's lead stands in where no sentence holds a term. Of ``asked``,
    a table with a column qid, each question without a context gets the answer that nothing was found, of confidence 0."""
    picked = picked_sentences(contexts, question, preset).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", F.concat("sentence", F.lit(" ["), F.col("ord").cast("string"), F.lit("]")).alias("s")))).alias("picked"))
    cited = contexts.where("ord <= 5").withColumn("c", F.struct(F.col("ord").cast("int").alias("index"), F.col("id").cast("string").alias("chunk_id"), "document_name", "chunk_index", excerpt(F.col("text"), preset.excerpt, preset.trim).alias("excerpt")))
    lead = F.element_at(F.split("text", r"(?<=[.!?])\s+"), 1)
    lead = F.concat(F.when(lead == "", F.substring("text", 1, 150)).otherwise(lead), F.lit(" [1]")) if preset.fallback is None else F.concat(F.substring("text", 1, preset.fallback), F.lit("... [1]"))
    grouped = cited.groupBy("qid").agg(F.sort_array(F.collect_list("c")).alias("citations"), F.min_by(lead, "ord").alias("lead"))
    rows = grouped.join(picked, "qid", "left")
    n = F.coalesce(F.size("picked"), F.lit(0))
    found = F.coalesce(F.size("picked") > 0, F.lit(False))
    texts = F.transform(F.col("picked"), lambda p: p["s"])
    none = 0.5 if preset.fallback is None else preset.base
    citations = F.when(found, F.col("citations")).otherwise(F.slice("citations", 1, 1)) if preset.fallback is None else F.col("citations")
    answers = rows.select(
        "qid",
        F.when(found, F.element_at(texts, 1)).otherwise(F.col("lead")).alias("summary"),
        F.when(found, F.slice(texts, F.lit(2), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("bullet_points"),
        citations.alias("citations"),
        F.when(found, F.least(F.lit(preset.most), F.lit(preset.base) + n * 0.1)).otherwise(F.lit(none)).alias("confidence"),
    )
    if asked is None:
        return answers
    types = dict(answers.dtypes)
    without = asked.select("qid").distinct().join(contexts.select("qid"), "qid", "left_anti")
    return answers.unionByName(without.select("qid", F.lit(NOTHING).alias("summary"), *(F.array().cast(types[c]).alias(c) for c in ("bullet_points", "citations")), F.lit(0.0).alias("confidence")))


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last n turns of each conversation."""
    return turns.withColumn("__r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("__r") <= n).drop("__r")


def prior_turns(turns: DataFrame, n: int = 2) -> DataFrame:
    """All but the last n turns."""
    return turns.withColumn("__r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("__r") > n).drop("__r")


def _joined(turns: DataFrame, line: Column, between: str) -> DataFrame:
    """Lines in turn order, of the few turns a window left of each conversation."""
    parts = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), between).alias("history"))


def chat_history(turns: DataFrame, n: int = 6) -> DataFrame:
    """(conv_id, history): the last turns as lines of a chat."""
    return _joined(last_turns(turns, n), F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("text")), "\n")


def small_history(turns: DataFrame, n: int = 4) -> DataFrame:
    """(conv_id, history): the last turns, cut short, on one line."""
    line = F.when(F.col("role") == "user", F.concat(F.lit("Q: "), F.substring("text", 1, 80))).otherwise(F.concat(F.lit("A: "), F.substring("text", 1, 120)))
    return _joined(last_turns(turns, n), line, " ")


def exchanges(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.floor(F.count(F.lit(1)) / 2).alias("exchanges"))


#: Fixed value: the instruction of the chat prompt.
SYSTEM = "You are a factual, concise grounded RAG assistant. Answer the user query using only the supplied context. Use bracketed citation numbers like [1], [2] when referencing source facts."


def chat_prompt(contexts: DataFrame, question: Column | str, history: Column | str = "") -> DataFrame:
    """(qid, prompt): instruction, conversation if any, four contexts of 500 characters, question."""
    q, h = (F.lit(x) if isinstance(x, str) else x for x in (question, history))
    block = F.concat(F.lit("[Source "), F.col("ord").cast("string"), F.lit("] ("), F.col("document_name"), F.lit("):\n"), F.substring("text", 1, 500))
    rows = contexts.where("ord <= 4").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("ord", block.alias("b")))).alias("c"))
    before = F.when(F.length(h) > 0, F.concat(F.lit("Previous conversation:\n"), h, F.lit("\n\n"))).otherwise(F.lit(""))
    return rows.select("qid", F.concat(F.lit(SYSTEM + "\n\n"), before, F.lit("Context:\n"), F.array_join(F.transform("c", lambda x: x["b"]), "\n\n"), F.lit("\n\nUser Question: "), q, F.lit("\n\nConcise Grounded Answer:")).alias("prompt"))


def small_prompt(contexts: DataFrame, question: Column | str, history: Column | str = "") -> DataFrame:
    """(qid, prompt): for a small model, on one line, three contexts of 350 characters."""
    q, h = (F.lit(x) if isinstance(x, str) else x for x in (question, history))
    block = F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("] "), F.substring("text", 1, 350))
    rows = contexts.where("ord <= 3").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("ord", block.alias("b")))).alias("c"))
    before = F.when(F.length(h) > 0, F.concat(h, F.lit(" "))).otherwise(F.lit(""))
    return rows.select("qid", F.concat(before, F.lit("Context: "), F.array_join(F.transform("c", lambda x: x["b"]), " "), F.lit(" Question: "), q, F.lit(" Answer the question concisely using the context:")).alias("prompt"))


def chat_answer(text: Column) -> Column:
    """struct(summary, bullet_points, confidence) from a chat model's lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != "")
    return F.struct(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("Answer synthesized from the model.")).alias("summary"), F.slice(lines, 2, 3).alias("bullet_points"), F.lit(0.95).alias("confidence"))


def small_answer(text: Column) -> Column:
    """struct(summary, bullet_points, confidence) from a small model's sentences."""
    clean = F.when(trimmed(text) == "", F.lit("Could not synthesize answer from context.")).otherwise(trimmed(text))
    parts = F.filter(F.split(clean, r"(?<=[.!?])\s+"), lambda x: F.length(x) > 15)
    return F.struct(F.coalesce(F.try_element_at(parts, F.lit(1)), clean).alias("summary"), F.when(F.size(parts) > 1, F.slice(parts, 2, 2)).otherwise(F.array().cast("array<string>")).alias("bullet_points"), F.lit(0.92).alias("confidence"))


def answer_text(answers: DataFrame) -> DataFrame:
    """(qid, text): summary, bullets and sources as plain text."""
    bullets = F.concat_ws("\n", F.transform("bullet_points", lambda b: F.concat(F.lit("• "), b)))
    sources = F.concat_ws("\n", F.transform("citations", lambda c: F.concat(F.lit("["), c["index"].cast("string"), F.lit("] "), c["document_name"], F.lit(" (Chunk #"), c["chunk_index"].cast("string"), F.lit(")"))))
    return answers.select("qid", F.concat(F.col("summary"), F.lit("\n\n"), bullets, F.lit("\n\nSources:\n"), sources).alias("text"))
