"""Formulas found in running text (ETL-14, WIN-08) and evidence profiles (AUD-01, AUD-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import values as V
from quillstone.operators.align import backward_first, nearest_row
from quillstone.operators.matching import contains_pairs

REACH = 3


def label_keys(line: Column) -> Column:
    """The number labels of a line, as 5-12."""
    found = F.regexp_extract_all(line, F.lit("(?U)" + V.FORMULA_LABEL), F.lit(0))
    return F.transform(found, lambda x: F.translate(F.regexp_replace(x, r"(?U)[（()）\s]", ""), "－", "-"))


def formula_occurrences(lines: DataFrame) -> DataFrame:
    """Every number label with its formula: before the label on its line, else on one of the next or last three lines.

    lines(doc_id, ordinal, text).  Neighbours come from one window per document.
    """
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    near = lambda step: F.array(*[F.trim(F.coalesce(step("text", i + 1).over(order), F.lit(""))) for i in range(REACH)])
    rows = lines.withColumns({"_before": near(F.lag), "_after": near(F.lead), "_keys": label_keys(F.col("text"))}).where("size(_keys) > 0")
    parts = F.split("text", "(?U)" + V.FORMULA_LABEL)
    labels = F.regexp_extract_all("text", F.lit("(?U)" + V.FORMULA_LABEL), F.lit(0))
    rows = rows.withColumns({"_parts": parts, "_labels": labels}).select("*", F.posexplode("_keys").alias("_k", "label_key"))
    head = F.concat(
        F.array_join(F.transform(F.slice("_parts", F.lit(1), F.col("_k")), lambda p, i: F.concat(p, F.get("_labels", i))), ""), F.get("_parts", F.col("_k"))
    )
    rows = rows.withColumn("_head", F.regexp_replace(head, r"^[ \t:：，,。]+|[ \t:：，,。]+$", ""))

    def first_formula(candidates: str) -> Column:
        fits = F.filter(
            candidates,
            lambda x: (x != "") & T.formula_expression(x) & ((F.size(label_keys(x)) == 0) | F.array_contains(label_keys(x), F.col("label_key"))),
        )
        return F.get(fits, F.lit(0))

    own = F.when(T.formula_expression("_head"), F.nullif("_head", F.lit("")))
    around = F.when(F.col("_head") != "", F.coalesce(first_formula("_after"), first_formula("_before"))).otherwise(
        F.coalesce(first_formula("_before"), first_formula("_after"))
    )
    bare = F.regexp_replace(T.collapse_spaces(F.coalesce(own, around, F.lit(""))), "(?U)" + V.FORMULA_LABEL, "")
    context = F.coalesce(F.get(F.filter("_before", lambda x: (x != "") & ~T.looks_like_formula(x)), F.lit(0)), F.lit(""))
    return rows.select("doc_id", "ordinal", "label_key", T.collapse_spaces(bare).alias("expression"), T.collapse_spaces(context).alias("context_before"))


def best_occurrences(occurrences: DataFrame) -> DataFrame:
    """WIN-08: the best occurrence of every label: a formula, without prose, with an equals sign, long; the first of equals."""
    text = F.col("expression")
    score = F.struct(
        T.formula_expression(text).cast("int").alias("formula"), (~T.any_word(text, V.PROSE_FORMULA_MARKERS)).cast("int").alias("plain"),
        F.contains(text, F.lit("=")).cast("int").alias("equals"), F.least(F.length(text), F.lit(220)).alias("size"),
        (-F.col("doc_id")).alias("doc"), (-F.col("ordinal")).alias("line"),
    )
    best = occurrences.groupBy("label_key").agg(
        F.max_by(F.struct("doc_id", "ordinal", "expression", "context_before"), score).alias("o"), F.count(F.lit(1)).alias("occurrences")
    )
    return best.select("label_key", "o.*", "occurrences")


def enrich_formulas(resources: DataFrame, occurrences: DataFrame) -> DataFrame:
    """ETL-14: formula resources with their best occurrence; those without one need manual review.

    resources(resource_id, title, status, label_key).
    """
    best = best_occurrences(occurrences)
    found = F.coalesce(F.col("expression") != "", F.lit(False))
    return resources.join(best, "label_key", "left").select(
        "resource_id", "label_key", F.coalesce("expression", F.lit("")).alias("expression"), F.coalesce("context_before", F.lit("")).alias("context_before"),
        F.when(found, "extracted").otherwise("needs_manual_review").alias("extraction_status"),
        F.when(found, "structured").otherwise(F.coalesce(F.nullif("status", F.lit("")), F.lit("placeholder"))).alias("status"),
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
    )


def evidence_profile(status: Column, has_terms: Column) -> Column:
    """AUD-10: class, confidence, boundary and review state of a chunk from its alignment status."""
    result = None
    for name, values in V.EVIDENCE_PROFILES.items():
        entry = F.struct(*[F.lit(v).alias(k) for k, v in zip(V.EVIDENCE_PROFILE_FIELDS, values)], F.lit(False).alias("needs_textbook_anchor_review"))
        result = F.when(F.trim(status) == name, entry) if result is None else result.when(F.trim(status) == name, entry)
    terms = F.coalesce(has_terms, F.lit(False))
    low = [F.when(terms, F.lit(a)).otherwise(F.lit(b)) for a, b in zip(V.OPERATION_SUMMARY_WITH_TERMS, V.OPERATION_SUMMARY)]
    return result.otherwise(F.struct(*[c.alias(k) for k, c in zip(V.EVIDENCE_PROFILE_FIELDS, low)], (~terms).alias("needs_textbook_anchor_review")))


def supported_by_comparison(cards: DataFrame, comparisons: DataFrame) -> DataFrame:
    """AUD-10: ids of comparing cards whose question and points hold two strong terms of one comparison.

    cards(answer_id, canonical_question, answer_points); comparisons(comparison_id, title, object_a, object_b).  A term is a
    field or a part of it; terms of three characters and more are strong.  A substring join, nothing is compared all with all.
    """
    compact = lambda c: T.compact_spaces(c)
    asked = cards.where(T.any_word(F.col("canonical_question"), V.COMPARISON_WORDS)).select(
        "answer_id", F.concat_ws(" ", compact(F.col("canonical_question")), compact(T.list_text(F.col("answer_points")))).alias("hay")
    )
    fields = F.filter(F.array(*[F.trim(T.text_or_empty(c)) for c in ("title", "object_a", "object_b")]), lambda x: x != "")
    pieces = F.flatten(F.transform(fields, lambda x: F.concat(F.array(x), F.split(x, V.COMPARISON_SPLIT))))
    strong = F.filter(F.transform(pieces, compact), lambda x: F.length(x) >= 3)
    terms = comparisons.select("comparison_id", F.posexplode(strong).alias("place", "term"))
    hits = contains_pairs(asked, "answer_id", "hay", terms.select("term").distinct(), "term", "term")
    counted = hits.join(terms, "term").groupBy("answer_id", "comparison_id").agg(F.count(F.lit(1)).alias("n"))  # a repeated term counts again
    return counted.where("n >= 2").select("answer_id").distinct()


def answer_support(direct: Column, by_task: Column, by_point: Column, by_comparison: Column) -> Column:
    """AUD-10: how a card is supported: by its question, its task or a point, a comparison, or not at all."""
    return (
        F.when(direct, "direct_word_question_hit").when(by_task | by_point, "teaching_rewrite_supported_by_task_or_kp")
        .when(by_comparison, "teaching_rewrite_supported_by_concept_comparison").otherwise("word_direct_question_missing")
    )


def source_quality(rows: DataFrame, evidence_chapters: list[str]) -> DataFrame:
    """AUD-01: word status, confidence and anchor need of a chunk; its profile goes before alignment and correspondence.

    rows(chunk_id, chapter_id, word_verification, review_status, profile, word_alignment, word_correspondence), the last
    three structs or null.
    """
    from quillstone.operators.quality import evidence_confidence

    blank = lambda c: F.nullif(T.text_or_empty(c), F.lit(""))
    alignment = F.coalesce(blank(F.col("word_alignment.status")), blank(F.col("word_correspondence.status")), F.lit(""))
    missing = F.when(F.col("chapter_id").isin(evidence_chapters), "missing").otherwise("ungraded")
    raw = F.coalesce(blank(F.col("profile.word_verification")), blank(F.col("word_verification")), F.nullif(alignment, F.lit("")), missing)
    graded = F.col("profile").isNotNull() | F.col("word_alignment").isNotNull() | F.col("word_correspondence").isNotNull() | blank(F.col("word_verification")).isNotNull()
    confidence = F.coalesce(blank(F.col("profile.evidence_confidence")), F.when(~graded, "ungraded").otherwise(evidence_confidence(alignment, raw)))
    needs = F.coalesce(F.col("profile.needs_textbook_anchor_review"), F.lit(False)) | ((alignment == "missing") & (F.col("profile").isNull() | raw.isin("auto_anchor_missing_or_weak", "missing")))
    return rows.select(
        "chunk_id", "chapter_id", confidence.alias("confidence"), raw.alias("word_status"),
        F.coalesce(F.nullif(alignment, F.lit("")), F.lit("missing")).alias("alignment_status"),
        F.coalesce(blank(F.col("profile.review_status")), blank(F.col("review_status")), F.lit("missing")).alias("review_status"),
        needs.alias("needs_textbook_anchor_review"),
    )


def bind_figures(blocks: DataFrame, resources: DataFrame, reach: int = 8) -> DataFrame:
    """ETL-15: image resources bound to the first picture whose nearest figure label is theirs.

    blocks(doc_id, ordinal, text, picture), picture null or the picture's name; resources(resource_id, label_key, status,
    reference_aliases).  A label is looked for on the picture's own block, then alternately before and after it.
    """
    pattern = r"图\s*(\d+)\s*[-－—]\s*(\d+)"
    label = F.concat_ws("-", F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")), F.nullif(F.regexp_extract("text", pattern, 2), F.lit("")))
    labelled = blocks.where(F.col("text").rlike(pattern)).select("doc_id", "ordinal", label.alias("label_key"))
    near = nearest_row(blocks.where("picture is not null"), labelled, backward_first(reach), "label_key")
    named = near.join(blocks.select("doc_id", "ordinal", "picture"), ["doc_id", "ordinal"])
    first = named.groupBy("label_key").agg(F.min_by(F.struct("doc_id", "ordinal", "picture", "offset"), F.struct("doc_id", "ordinal")).alias("f"))
    bound = F.col("f").isNotNull()
    aliases = F.array(F.concat(F.lit("图"), "label_key"), F.concat(F.lit("图 "), "label_key"), F.col("label_key"))
    return resources.join(first, "label_key", "left").select(
        "resource_id", "label_key", F.when(bound, F.col("f.picture")).alias("file_path"), F.when(bound, "bound").otherwise(F.col("status")).alias("status"),
        F.when(bound, F.array_distinct(F.concat("reference_aliases", aliases))).otherwise(F.col("reference_aliases")).alias("reference_aliases"),
        F.abs(F.col("f.offset")).alias("distance"),
    )
