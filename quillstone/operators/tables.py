"""Tables of a manuscript as structured resources (ETL-14, second half; SRC-14 as a set operation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.topk import keep_first

#: A table begins and ends within this many lines of its caption; its context stands within so many lines before it.
REACH, CONTEXT = 12, 7
TABLE_LABEL = r"表\s*(\d+)\s*[-－]\s*(\d+)"
RESOURCE_LABEL = r"(?:table|表)[_\s]*(\d+)[_\-－\s]*(\d+)"


def table_key(resource_id: Column, title: Column) -> Column:
    """The number of a table resource, as 2-1; empty where neither id nor title has one."""
    text = F.concat_ws(" ", F.coalesce(resource_id, F.lit("")), F.coalesce(title, F.lit("")))
    key = lambda x, pattern: F.when(x.rlike(pattern), F.concat_ws("-", F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)))
    return F.coalesce(key(text, RESOURCE_LABEL), key(F.coalesce(title, F.lit("")), TABLE_LABEL), F.lit(""))


def captioned_tables(lines: DataFrame, captions: DataFrame, only: Column | None = None, best: bool = False) -> DataFrame:
    """(label_key, label, title, doc_id, ordinal, columns, rows, context_before, extraction_status) of every caption line.

    lines(doc_id, ordinal, text), trimmed; captions(label_key, label, title).  Islands of consecutive lines with a pipe are found by
    one window over a document's lines, which also tells every line the next island's start and the last plain line before it;
    a caption then joins the lines of its island.  Short rows are dropped; of columns of one name the last counts.
    ``only``, a condition on label_key and doc_id, says which captions count, and ``best`` keeps those of ``best_tables``: both hold before
    any table is put together, so a line that is a caption of many numbers is not carried on for each of them.
    """
    titles = captions.select("label_key", "label", "title").withColumn("_title", F.trim("title")).dropDuplicates(["label_key", "_title"])
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    pipe = F.contains("text", F.lit("|"))
    plain = (F.trim("text") != "") & ~pipe & ~F.col("text").rlike(TABLE_LABEL)
    rows = lines.select("doc_id", "ordinal", "text").withColumn("_pipe", pipe)
    joined = F.coalesce(F.lag("_pipe").over(order) & (F.lag("ordinal").over(order) == F.col("ordinal") - 1), F.lit(False))
    rows = rows.withColumn("_start", F.when(F.col("_pipe") & ~joined, F.col("ordinal"))).withColumn("_plain", F.when(plain, F.struct("ordinal", "text")))
    rows = rows.withColumns(
        {
            "_island": F.when(F.col("_pipe"), F.last("_start", True).over(order)),
            "_next": F.first("_start", True).over(order.rowsBetween(1, Window.unboundedFollowing)),
            "_before": F.last("_plain", True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    found = rows.join(titles, F.trim(F.col("text")) == F.col("_title"))
    # before anything else is carried on: a line may be a caption of very many numbers
    found = (found if only is None else found.where(only)).select(
        "doc_id", F.col("ordinal").alias("_caption"), "label_key", "label", "title",
        F.when(F.col("_next") <= F.col("ordinal") + REACH, F.col("_next")).alias("_island"),
        F.coalesce(F.when(F.col("_before.ordinal") >= F.col("ordinal") - CONTEXT, F.trim("_before.text")), F.lit("")).alias("context_before"),
    )
    if best:
        found = best_tables(found.withColumnRenamed("_caption", "ordinal")).withColumnRenamed("ordinal", "_caption")
    cells = F.transform(F.split("text", r"\|"), lambda c: F.trim(c))
    parts = rows.where("_pipe").select("doc_id", "_island", "ordinal", cells.alias("cells"))
    own = found.where("_island is not null").select("doc_id", "_caption", "label_key", "_island").join(parts, ["doc_id", "_island"])
    own = own.where(F.col("ordinal") <= F.col("_caption") + REACH)
    bodies = own.groupBy("doc_id", "_caption", "label_key").agg(F.array_sort(F.collect_list(F.struct("ordinal", "cells"))).alias("_rows"))  # REACH rows at most
    columns = F.get("_rows", F.lit(0))["cells"]
    full = F.filter(F.slice("_rows", 2, REACH), lambda r: F.size(r["cells"]) >= F.size(columns))
    # of equal names the last cell counts, at the place of the first
    named = lambda r: F.map_from_entries(
        F.transform(
            F.array_distinct(columns),
            lambda c: F.struct(c.alias("key"), F.get(r["cells"], F.size(columns) - F.array_position(F.reverse(columns), c).cast("int")).alias("value")),
        )
    )
    tables = bodies.select("doc_id", "_caption", "label_key", columns.alias("columns"), F.transform(full, named).alias("rows"))
    out = found.join(tables, ["doc_id", "_caption", "label_key"], "left")
    whole = F.coalesce((F.size("columns") > 0) & (F.size("rows") > 0), F.lit(False))
    return out.select(
        "label_key", "label", "title", "doc_id", F.col("_caption").alias("ordinal"), F.coalesce("columns", F.array().cast("array<string>")).alias("columns"),
        F.coalesce("rows", F.array().cast("array<map<string,string>>")).alias("rows"), "context_before",
        F.when(whole, "extracted").otherwise("needs_manual_review").alias("extraction_status"),
    )


def best_tables(tables: DataFrame) -> DataFrame:
    """One table per number: the last caption of the manuscript, as later ones correct earlier ones."""
    return keep_first(tables, ["label_key"], [F.desc("doc_id"), F.desc("ordinal"), F.col("title")])


def enrich_tables(resources: DataFrame, tables: DataFrame, cards: DataFrame) -> DataFrame:
    """ETL-14: table resources with their table's detail, status and keywords; those without a table stay as they are, unresolved.

    resources(resource_id, title, status, qa_use, teaching_use, keywords); cards(answer_id, recommended_resources).
    """
    related = cards.select("answer_id", F.explode("recommended_resources").alias("resource_id")).groupBy("resource_id").agg(
        F.array_sort(F.collect_set("answer_id")).alias("_cards")
    )
    best = best_tables(tables).select("label_key", F.struct("label", F.col("title").alias("title"), "columns", "rows", "context_before", "doc_id", "ordinal", "extraction_status").alias("_t"))
    rows = resources.withColumn("label_key", table_key(F.col("resource_id"), F.col("title"))).join(best, "label_key", "left").join(related, "resource_id", "left")
    hit, whole = F.col("_t").isNotNull(), F.coalesce(F.col("_t.extraction_status") == "extracted", F.lit(False))
    blank = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    none = F.array().cast("array<string>")
    words = F.concat(F.coalesce("keywords", none), F.array("_t.label", "label_key", "_t.title", F.coalesce("title", F.lit(""))), F.col("_t.columns"))
    unique = F.array_distinct(F.filter(words, lambda w: w.isNotNull() & (w != "")))
    either = lambda c, text: F.when(hit, F.coalesce(blank(c), F.lit(text))).otherwise(F.col(c)).alias(c)
    return rows.select(
        "resource_id", "label_key", F.when(whole, "structured").when(hit, F.coalesce(blank("status"), F.lit("placeholder"))).otherwise(F.col("status")).alias("status"),
        either("qa_use", "当学生询问对应教材表格、对比项或适用场景时作为结构化资源。"), either("teaching_use", "用于比较类知识点解释、课堂讲解和自学复习。"),
        F.when(hit, unique).otherwise(F.col("keywords")).alias("keywords"), F.when(hit, F.col("_t")).alias("table_detail"),
        F.when(hit, F.coalesce("_cards", none)).alias("related_answer_cards"), (~whole).alias("unresolved"),
    )
