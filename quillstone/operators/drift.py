"""Packages whose fields drift in name and type, read as VARIANT in one pass (SRC-02, ETL-03, ETL-04).

A row of a package table stays a VARIANT; every field is asked for under all its names, and what it holds, an array, an object, a number
or a delimited text, is decided row by row.  Nothing is inferred over the data, so packages of any mixture share one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.topk import last_wins

NO_TEXTS = "array<string>"
XML_MARKS = ("<w:", "</w:")
NEEDS_REVIEW = "该证据片段原始稿中残留Word XML格式内容，需结合教材正文人工复核。"
PRIORITIES = {"highest": 120, "high": 100, "medium": 70, "low": 40}


def variant_table(packages: DataFrame, name: str) -> DataFrame:
    """SRC-02: (chapter_id, ordinal, row) of one table of every package; entries that are no objects are left out.

    packages(chapter_id, json).  A table that is missing or no list has no rows.
    """
    table = F.try_variant_get(F.try_parse_json("json"), f"$.{name}", "array<variant>")
    rows = packages.select("chapter_id", F.posexplode(table).alias("ordinal", "row"))
    return rows.where(F.startswith(F.schema_of_variant("row"), F.lit("OBJECT")))


def _plain(value: Column) -> Column:
    """A value as trimmed text; objects and lists as JSON; null where it says nothing (null, blank, false, zero, empty)."""
    kind = F.schema_of_variant(value)
    nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    text = F.when(nested, F.to_json(value)).otherwise(F.trim(F.try_variant_get(value, "$", "string")))
    nothing = text.isin("", "[]", "{}") | (~F.startswith(kind, F.lit("STRING")) & text.isin("false", "0", "0.0"))
    return F.when(~nothing, text)


def text(*names: str, row: str = "row", default: str = "") -> Column:
    """The first of the fields that says something, as text."""
    return F.coalesce(*[_plain(F.try_variant_get(row, f"$.{n}", "variant")) for n in names], F.lit(default))


def _pieces(value: Column) -> Column:
    """The parts of a delimited text."""
    return F.filter(F.transform(F.split(F.translate(value, "；;\n", "|||"), r"\|"), lambda p: F.trim(p)), lambda p: p != "")


def _split(value: Column) -> Column:
    """Texts of one item: an object is one JSON text, anything else is split."""
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.array(F.to_json(value))).otherwise(
        F.coalesce(_pieces(F.try_variant_get(value, "$", "string")), F.array().cast(NO_TEXTS))
    )


def values(name: str, row: str = "row") -> Column:
    """A field as a list of distinct texts, whether it is a list (of lists), an object or a delimited text."""
    value = F.try_variant_get(row, f"$.{name}", "variant")
    items = F.try_variant_get(value, "$", "array<variant>")
    deeper = lambda x: F.try_variant_get(x, "$", "array<variant>")
    of_item = lambda x: F.when(deeper(x).isNotNull(), F.flatten(F.transform(deeper(x), _split))).otherwise(_split(x))
    found = F.when(items.isNotNull(), F.flatten(F.transform(F.filter(items, lambda x: ~F.is_variant_null(x)), of_item))).otherwise(_split(value))
    return F.array_distinct(F.coalesce(found, F.array().cast(NO_TEXTS)))


def first_list(*lists: Column) -> Column:
    """The first list with an item."""
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast(NO_TEXTS))


def has_residue(value: Column) -> Column:
    return F.contains(value, F.lit(XML_MARKS[0])) | F.contains(value, F.lit(XML_MARKS[1]))


def without_residue(value: Column) -> Column:
    """A text without tags; empty where marks of the word processor remain."""
    bare = F.trim(F.replace(F.trim(F.regexp_replace(F.regexp_replace(value, "<[^>]+>", " "), r"(?U)\s+", " ")), F.lit("w:tab"), F.lit(" ")))
    return F.when(has_residue(bare), "").otherwise(bare)


def normalize_chunks(rows: DataFrame) -> DataFrame:
    """ETL-03: source chunks with repaired excerpts, never put out directly, keywords as a list."""
    excerpt, summary = text("source_excerpt"), text("summary", "chunk_summary")
    broken = has_residue(excerpt) | has_residue(summary)
    blank = lambda c: F.nullif(c, F.lit(""))
    repaired = F.coalesce(blank(without_residue(excerpt)), blank(without_residue(summary)), F.lit(NEEDS_REVIEW))
    return rows.select(
        "chapter_id", text("chunk_id").alias("chunk_id"), F.when(broken, repaired).otherwise(excerpt).alias("source_excerpt"),
        F.when(broken & has_residue(summary), repaired).otherwise(summary).alias("summary"), broken.alias("repaired"), F.lit("no_direct_output").alias("usable_for_answer"),
        text("review_status", "status", default="checked").alias("review_status"), values("keywords").alias("keywords"),
    )


def normalize_points(rows: DataFrame) -> DataFrame:
    """ETL-03: knowledge points; without key points of their own, definition, explanation and meaning stand for them."""
    told = F.filter(F.array(*[text(c) for c in ("definition", "core_explanation", "engineering_meaning")]), lambda x: x != "")
    return rows.select(
        "chapter_id", text("kp_id").alias("kp_id"), text("title").alias("title"), first_list(values("key_points"), told).alias("key_points"),
        values("keywords").alias("keywords"), F.slice(values("student_question_patterns"), 1, 4).alias("aliases"), values("related_kps").alias("related_kps"),
        values("common_mistakes").alias("common_mistakes"),
        F.coalesce(F.nullif(text("source_hint"), F.lit("")), F.array_join(values("evidence_chunks"), ";")).alias("source_hint"),
    )


def normalize_cards(cards: DataFrame, tasks: DataFrame) -> DataFrame:
    """ETL-03 / ETL-04: answer cards of operation chapters: points from steps, points and checks, texts from their task where they have none.

    Both as of ``variant_table``; of tasks of one id and chapter the last counts.
    """
    named = tasks.withColumn("_id", text("task_id")).where("_id <> ''").select("chapter_id", "_id", F.col("row").alias("_task"), "ordinal")
    last = last_wins(named, ["chapter_id", "_id"]).select(F.col("chapter_id").alias("_c"), "_id", "_task")
    rows = cards.withColumn("_related", text("related_task")).join(last, (F.col("chapter_id") == F.col("_c")) & (F.col("_related") == F.col("_id")), "left")
    steps, points = values("operation_steps"), values("answer_points")
    checks = first_list(values("must_check"), values("must_include"))
    own = F.when((text("question_type") == "operation_steps") & (F.size(steps) > 0), steps).otherwise(first_list(points, steps))
    rows = rows.withColumns({"_points": F.array_distinct(F.concat(own, checks)), "_checks": checks})
    has = F.col("_task").isNotNull()
    of_task = lambda name: F.coalesce(F.try_variant_get("_task", f"$.{name}", "string"), F.lit("None"))
    concise = F.when(has, F.concat(of_task("task_name"), F.lit("的目标是："), of_task("task_goal"))).otherwise(F.array_join(F.slice("_points", 1, 3), "；"))
    must = values("must_check")
    parts = F.array(
        *[F.when(has, F.concat(F.lit(label), of_task(name))) for label, name in (("操作目标：", "task_goal"), ("前置条件：", "prerequisite"), ("预期结果：", "output_result"))],
        F.when(F.size("_points") > 0, F.concat(F.lit("操作要点："), F.array_join("_points", "；"))),
        F.when(F.size(must) > 0, F.concat(F.lit("结果检查："), F.array_join(must, "；"))),
    )
    mode = text("answer_mode")
    related = first_list(values("related_kps"), F.when(has, values("related_kps", "_task")).otherwise(F.array().cast(NO_TEXTS)))
    given = lambda name, made: F.coalesce(F.try_variant_get("row", f"$.{name}", "string"), made).alias(name)
    return rows.select(
        "chapter_id", text("answer_id").alias("answer_id"), F.when(mode == "steps", "step").otherwise(mode).alias("answer_mode"), related.alias("related_kps"),
        values("student_question_patterns").alias("student_question_patterns"), F.col("_points").alias("answer_points"), F.col("_checks").alias("must_include"),
        values("avoid_content").alias("avoid_content"), values("evidence_chunks").alias("evidence_chunks"), F.array().cast(NO_TEXTS).alias("recommended_resources"),
        given("concise_answer", concise), given("expanded_answer", F.array_join(F.array_compact(parts), "\n")),
    )


def normalize_cases(cases: DataFrame, cards: DataFrame) -> DataFrame:
    """ETL-03: test cases with what their expected card demands; cases as of ``variant_table``, cards as of ``normalize_cards``."""
    known = cards.select(F.col("chapter_id").alias("_c"), F.col("answer_id").alias("_id"), "related_kps", "must_include", "answer_mode").dropDuplicates(["_c", "_id"])
    rows = cases.withColumn("_expected", text("expected_answer_card", "must_hit"))
    rows = rows.join(known, (F.col("chapter_id") == F.col("_c")) & (F.col("_expected") == F.col("_id")) & (F.col("_id") != ""), "left")
    none = F.array().cast(NO_TEXTS)
    return rows.select(
        "chapter_id", text("test_id", "eval_id").alias("test_id"), F.col("_expected").alias("expected_answer_card"), F.coalesce("related_kps", none).alias("expected_kps"),
        first_list(values("must_include"), F.coalesce("must_include", none)).alias("expected_answer_points"), values("must_not_include").alias("should_not_include"),
        F.coalesce(F.nullif("answer_mode", F.lit("")), F.lit("bullet")).alias("required_response_mode"),
        text("pass_rule", "pass_criteria", default="top1_answer_and_point_coverage").alias("pass_rule"),
    )


def normalize_rag(rows: DataFrame) -> DataFrame:
    """ETL-03: retrieval configuration; priorities in words become numbers."""
    said = F.lower(text("retrieval_priority"))
    number = F.coalesce(*[F.when(said == word, F.lit(n)) for word, n in PRIORITIES.items()], said.try_cast("int"), F.lit(50))
    kind = text("object_type")
    return rows.select(
        "chapter_id", text("object_id").alias("object_id"), kind.alias("object_type"), number.alias("retrieval_priority"),
        text("index_text", "embedding_text", "retrieval_keywords").alias("index_text"), (kind == "answer_card").alias("primary_output"),
    )


def normalize_embeddings(rows: DataFrame) -> DataFrame:
    """ETL-03: the embedding corpus under either set of names."""
    return rows.select(
        "chapter_id", text("embedding_id").alias("embedding_id"), text("source_type", "object_type").alias("source_type"),
        text("source_id", "object_id").alias("source_id"), text("embedding_text", "text_for_embedding").alias("embedding_text"),
    )
