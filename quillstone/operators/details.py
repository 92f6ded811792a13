"""Details of cards, resources and interactive scripts (RET-18), for all of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.topk import last_wins, top_k

#: Test cases shown with a card.
CASES = 20


def available(exists: Column, resource_type: Column, formula: Column, columns: Column, rows: Column) -> Column:
    """A resource can be shown if its file exists or it is a structured formula or table."""
    as_formula = (resource_type == "formula") & (F.coalesce(formula, F.lit("")) != "")
    as_table = (resource_type == "table") & (F.coalesce(F.size(columns), F.lit(0)) > 0) & (F.coalesce(F.size(rows), F.lit(0)) > 0)
    return F.coalesce(exists, F.lit(False)) | as_formula | as_table


def resource_payloads(resources: DataFrame, scripts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Resources with ``url_path``, ``exists``, ``available`` and their script.

    resources(resource_id, resource_type, title, file_path, expression, columns, rows), the last three null where they do not apply;
    scripts(script_id, resource_id, title, interaction_theme, operation_steps, ordinal); files(file_path): those that exist.  Of several scripts of a
    resource the last one counts.
    """
    path = F.coalesce("file_path", F.lit(""))
    script = last_wins(scripts, ["resource_id"]).select(
        F.col("resource_id").alias("_r"), F.struct("script_id", F.col("title").alias("title"), "interaction_theme", "operation_steps").alias("interactive_script")
    )
    rows = resources.join(script, F.col("resource_id") == F.col("_r"), "left").drop("_r")
    if files is None:
        rows = rows.withColumn("exists", F.lit(False))
    else:
        known = files.select(F.col("file_path").alias("_f")).distinct().withColumn("exists", F.lit(True))
        rows = rows.join(known, path == F.col("_f"), "left").drop("_f").withColumn("exists", F.coalesce("exists", F.lit(False)) & (path != ""))
    return rows.withColumns(
        {
            "available": available(F.col("exists"), F.col("resource_type"), F.col("expression"), F.col("columns"), F.col("rows")),
            "url_path": F.when(path != "", F.concat(F.lit("/"), F.translate(path, "\\", "/"))).otherwise(""),
        }
    )


def _listed(pairs: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """The values of a card in order; a card's own list."""
    found = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_x"))
    return found.select(F.col(key).alias("_id"), F.transform("_x", lambda x: x[value]).alias(name))


def card_details(cards: DataFrame, points: DataFrame, chunks: DataFrame, recommended: DataFrame, payloads: DataFrame, cases: DataFrame, answer: Column) -> DataFrame:
    """RET-18: every card with its rendered answer, knowledge points, source chunks, recommended resources and first test cases.

    cards(answer_id, related_kps, evidence_chunks and what ``answer`` needs); points(ordinal, kp_id, title); chunks(ordinal, chunk_id,
    source_excerpt); recommended(answer_id, rank, resource_id); payloads as of ``resource_payloads``; cases(ordinal, test_id, expected_answer_card).
    Ids that name nothing are left out; points and chunks stand in the order of their own tables.
    """
    named = cards.select("answer_id", F.explode(F.array_distinct("related_kps")).alias("kp_id")).join(points, "kp_id")
    quoted = cards.select("answer_id", F.explode(F.array_distinct("evidence_chunks")).alias("chunk_id")).join(chunks.select("ordinal", "chunk_id"), "chunk_id")
    shown = recommended.join(payloads.select("resource_id", F.struct("resource_id", "available", "url_path", "interactive_script").alias("resource")), "resource_id")
    tests = top_k(cases.select(F.col("expected_answer_card").alias("answer_id"), "ordinal", "test_id"), ["answer_id"], [F.col("ordinal"), F.col("test_id")], CASES, "_rank")
    parts = [
        _listed(named.select("answer_id", "ordinal", F.struct("kp_id", "title").alias("kp")), "answer_id", "ordinal", "kp", "knowledge_points"),
        _listed(quoted, "answer_id", "ordinal", "chunk_id", "source_chunks"),
        _listed(shown.select("answer_id", "rank", "resource"), "answer_id", "rank", "resource", "recommended_resources"),
        _listed(tests.select("answer_id", "_rank", "test_id"), "answer_id", "_rank", "test_id", "qa_cases"),
    ]
    out = cards.select("answer_id", answer.alias("rendered_answer"))
    for part in parts:
        name = part.columns[1]
        kind = dict(part.dtypes)[name]
        out = out.join(part, F.col("answer_id") == F.col("_id"), "left").drop("_id").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def script_details(scripts: DataFrame, payloads: DataFrame) -> DataFrame:
    """RET-18: every script with its resource, null where it names none that exists; of equal resource ids the last counts."""
    last = last_wins(payloads.select("ordinal", "resource_id", "title", "resource_type", "available", "url_path"), ["resource_id"])
    told = last.select(F.col("resource_id").alias("_r"), F.struct("resource_id", "title", "resource_type", "available", "url_path").alias("resource"))
    return scripts.join(told, F.col("resource_id") == F.col("_r"), "left").drop("_r")
