"""Normalisers for packages whose fields drift in name and type (ETL-01 .. ETL-05).

A field is asked for by all names it is known under; names that a table does not have are left out of the plan, so the
same operator serves every package.  Lists may come as arrays or as delimited texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

NO_TEXTS = "cast(array() as array<string>)"


def text_of(df: DataFrame, name: str) -> Column:
    """A field as trimmed text; a list's items are joined by blanks."""
    kind = df.schema[name].dataType.simpleString()
    if kind.startswith("array"):
        items = F.filter(F.transform(F.col(name).cast("array<string>"), lambda x: F.trim(x)), lambda x: x != "")
        return F.array_join(items, " ")
    return F.trim(F.col(name).cast("string"))


def first_text_of(df: DataFrame, *names: str, default: str = "") -> Column:
    """ETL-01: the first non-blank of the fields that the table has."""
    values = [F.nullif(text_of(df, n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*values, F.lit(default))


def list_of(df: DataFrame, *names: str, splitter=T.split_b) -> Column:
    """ETL-02: the first non-empty of the fields as a list of texts, whatever its type."""
    found = []
    for name in names:
        if name in df.columns:
            kind = df.schema[name].dataType.simpleString()
            items = F.col(name).cast("array<string>") if kind.startswith("array") else splitter(F.col(name).cast("string"))
            items = F.filter(F.coalesce(items, F.expr(NO_TEXTS)), lambda x: x.isNotNull() & (F.trim(x) != ""))
            found.append(F.when(F.size(items) > 0, items))
    return F.coalesce(*found, F.expr(NO_TEXTS))


def given(df: DataFrame, name: str, default: Column) -> Column:
    """A field where the table has it and it is set, else ``default``."""
    return F.coalesce(F.col(name), default) if name in df.columns else default


def normalize_synonyms(rows: DataFrame) -> DataFrame:
    """ETL-01: alias, target, term, type, priority and id of synonym rows."""
    alias = first_text_of(rows, "alias_or_question", "alias", "question", "term", "text", "standard_term")
    target = first_text_of(rows, "target_id", "answer_id", "kp_id", "standard_term")
    named = rows.withColumns({"_alias": alias, "_target": target})
    term = F.coalesce(F.nullif(first_text_of(rows, "standard_term", "term"), F.lit("")), F.nullif("_alias", F.lit("")), F.col("_target"))
    named = named.withColumn("_term", term)
    shown = F.coalesce(F.nullif("_target", F.lit("")), F.nullif("_term", F.lit("")), F.lit("target"))
    said = F.coalesce(F.nullif("_alias", F.lit("")), F.nullif("_term", F.lit("")), F.lit("alias"))
    safe = F.regexp_replace(F.regexp_replace(shown, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    safe = F.coalesce(F.nullif(safe, F.lit("")), F.lit("target"))
    made = F.concat(F.lit("syn_"), safe, F.lit("_"), F.substring(F.sha1(F.concat_ws("|", shown, said)), 1, 10))
    number = F.regexp_extract(first_text_of(rows, "priority"), r"-?\d+", 0)
    return named.select(
        F.coalesce(F.nullif(first_text_of(rows, "synonym_id", "id"), F.lit("")), made).alias("synonym_id"),
        F.col("_alias").alias("alias_or_question"), F.col("_target").alias("target_id"), F.col("_term").alias("standard_term"),
        first_text_of(rows, "type", default="alias").alias("type"),
        F.coalesce(F.nullif(number, F.lit("")).try_cast("int"), F.lit(0)).alias("priority"),
    )


def normalize_relations(rows: DataFrame) -> DataFrame:
    """ETL-01: ends, kind, weight and id of relation rows."""
    source = first_text_of(rows, "source_id", "source_kp", "source_answer", "source")
    target = first_text_of(rows, "target_id", "target_kp", "target_answer", "target")
    kind = first_text_of(rows, "relation_type", "relation", "type", default="related")
    shown = lambda c, word: F.coalesce(F.nullif(c, F.lit("")), F.lit(word))
    made = T.surrogate_id("rel_", shown(source, "source"), kind, shown(target, "target"))
    return rows.select(
        F.coalesce(F.nullif(first_text_of(rows, "relation_id"), F.lit("")), made).alias("relation_id"),
        source.alias("source_id"), target.alias("target_id"), kind.alias("relation_type"),
        given(rows, "weight", F.lit(1)).cast("int").alias("weight"),
        given(rows, "use_in_recommendation", F.lit(True)).alias("use_in_recommendation"),
        given(rows, "use_in_rag", F.lit(False)).alias("use_in_rag"),
    )


def normalize_resources(rows: DataFrame, chapter: str) -> DataFrame:
    """ETL-01: type, title, lists, status and chapter of resource rows."""
    title = first_text_of(rows, "title", "caption_or_name", "resource_id")
    keywords = list_of(rows, "keywords")
    kind = first_text_of(rows, "resource_type")
    return rows.select(
        first_text_of(rows, "resource_id").alias("resource_id"), first_text_of(rows, "chapter_id", default=chapter).alias("chapter_id"),
        F.when(kind == "figure", "image").otherwise(kind).alias("resource_type"), title.alias("title"),
        F.when(F.size(keywords) > 0, keywords).otherwise(F.filter(F.split(title, r"[\s、，,；;：:（）()与和的]+"), lambda w: F.length(w) >= 2)).alias("keywords"),
        list_of(rows, "related_kps").alias("related_kps"), first_text_of(rows, "status", default="placeholder").alias("status"),
    )


def normalize_comparisons(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """ETL-02: ids, titles and dimensions of concept comparisons under either set of names."""
    left, right = first_text_of(rows, "concept_a", "object_a"), first_text_of(rows, "concept_b", "object_b")
    chapter = first_text_of(rows, "chapter_id")
    made = F.concat(F.lit("cmp_"), chapter, F.lit("_"), F.format_string("%03d", F.col(ordinal)))
    both = F.regexp_replace(F.concat(left, F.lit("与"), right, F.lit("的比较")), "^[与的比较]+|[与的比较]+$", "")
    titled = F.when((left != "") | (right != ""), both).otherwise("")
    return rows.select(
        F.coalesce(F.nullif(first_text_of(rows, "comparison_id"), F.lit("")), made).alias("comparison_id"),
        F.coalesce(F.nullif(first_text_of(rows, "title"), F.lit("")), titled).alias("title"),
        left.alias("object_a"), right.alias("object_b"),
        list_of(rows, "dimensions", "comparison_dimensions", "comparison_dimension", "dimension").alias("dimensions"),
        list_of(rows, "related_kps").alias("related_kps"), first_text_of(rows, "status", default="checked").alias("status"),
    )


def normalize_exercises(rows: DataFrame) -> DataFrame:
    """ETL-05: exercises under either set of names, with lists as lists."""
    return rows.select(
        first_text_of(rows, "exercise_id").alias("exercise_id"), first_text_of(rows, "question").alias("question"),
        first_text_of(rows, "question_type", "exercise_type", default="short_answer").alias("question_type"),
        list_of(rows, "standard_answer_points", "answer_points").alias("standard_answer_points"),
        list_of(rows, "common_mistakes").alias("common_mistakes"), first_text_of(rows, "grading_rubric", "scoring_rule").alias("grading_rubric"),
    )


def normalize_tasks(rows: DataFrame) -> DataFrame:
    """ETL-03 / ETL-04: operation tasks whose relations come as delimited texts."""
    return rows.select(
        first_text_of(rows, "task_id").alias("task_id"), first_text_of(rows, "task_name", "title").alias("task_name"),
        first_text_of(rows, "software", "tool").alias("software"), list_of(rows, "related_kps", splitter=T.split_c).alias("related_kps"),
        list_of(rows, "common_errors", splitter=T.split_c).alias("common_errors"),
        first_text_of(rows, "status", default="checked").alias("status"),
    )
