"""Small relational operators: filters, lookups, histograms, histories (FLT-xx, JOI-xx, AGG-xx, WIN-10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import values as V
from quillstone.operators.topk import keep_first, last_wins, top_k


def facet_filter(rows: DataFrame, facets: dict[str, str], query: str, searched: tuple[str, ...]) -> DataFrame:
    """FLT-09: equality on every chosen facet and free text in any searched column; empty choices do not filter."""
    conditions = [F.col(name) == value for name, value in facets.items() if value]
    if query.strip():
        haystack = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in searched]))
        conditions.append(F.contains(haystack, F.lit(query.strip().lower())))
    return rows.where(reduce(lambda a, b: a & b, conditions)) if conditions else rows


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """JOI-06: left lookup; of several rows with one key the last counts."""
    return rows.join(last_wins(table, keys, ordinal).drop(ordinal), keys, "left")


def card_details(cards: DataFrame, knowledge_points: DataFrame, chunks: DataFrame, cases: DataFrame) -> DataFrame:
    """JOI-13 / RET-18: per card, how many of its knowledge points, chunks and first 20 cases exist."""
    kps = cards.select("answer_id", F.explode(F.array_distinct("related_kps")).alias("kp_id")).join(
        knowledge_points.select("kp_id"), "kp_id", "left_semi"
    )
    evidence = cards.select("answer_id", F.explode(F.array_distinct("evidence_chunks")).alias("chunk_id")).join(
        chunks.select("chunk_id"), "chunk_id", "left_semi"
    )
    tests = top_k(
        cases.select(F.col("expected_answer_card").alias("answer_id"), "ordinal"), ["answer_id"], [F.col("ordinal")], 20
    )
    result = cards.select("answer_id")
    for name, part in (("knowledge_points", kps), ("source_chunks", evidence), ("qa_cases", tests)):
        result = result.join(part.groupBy("answer_id").agg(F.count(F.lit(1)).alias(name)), "answer_id", "left")
    return result.na.fill(0)


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """AGG-08: how often every value occurs; empty values count as missing."""
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("missing"))
    return rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def hit_summary(rows: DataFrame, flag: Column, by: list[str]) -> DataFrame:
    """AGG-13: hit, miss and total."""
    return rows.groupBy(*by).agg(
        F.count_if(flag).alias("hit"), (F.count(F.lit(1)) - F.count_if(flag)).alias("miss"), F.count(F.lit(1)).alias("total")
    )


def history(entries: DataFrame, key: str, time: list[Column], owner: str, limit: int) -> DataFrame:
    """WIN-10: the latest entry per key, newest first, at most ``limit`` per owner."""
    latest = keep_first(entries, [owner, key], time)
    return top_k(latest, [owner], time, limit)


def operation_support(cards: DataFrame, task_hits: DataFrame, kp_hits: DataFrame) -> DataFrame:
    """AUD-10: a card is supported by its task, else by a knowledge point, else not."""
    by_kp = (
        cards.select("answer_id", F.explode("related_kps").alias("kp_id"))
        .join(kp_hits.select("kp_id").distinct(), "kp_id", "left_semi")
        .select("answer_id")
        .distinct()
        .withColumn("_kp", F.lit(True))
    )
    by_task = task_hits.select(F.col("task_id").alias("related_task")).distinct().withColumn("_task", F.lit(True))
    rows = cards.join(by_task, "related_task", "left").join(by_kp, "answer_id", "left")
    return rows.select(
        "answer_id",
        F.when(F.col("_task"), "word_task_supported").when(F.col("_kp"), "word_kp_supported").otherwise("word_direct_question_missing").alias("support"),
    )


def student_visible(text: Column) -> Column:
    """REN-05: the lines of an answer that students see; evidence lines go, all other line breaks stay."""
    lines = F.split(T.text_or_empty(text), r"\r?\n")
    blank = r"(?U)^\s+|\s+$"
    hidden = lambda x: F.regexp_replace(x, blank, "").startswith(V.HIDDEN_LINE_START) | F.contains(x, F.lit(V.HIDDEN_LINE_WORDS))
    return F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~hidden(x)), "\n"), blank, "")
