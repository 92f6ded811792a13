"""Evidence audit over chapters: answer quality, field integrity, totals and attention list (AUD-03, AGG-09, AGG-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOWN = 140
MISSING_QUESTION = "word_direct_question_missing"


def _given(value: Column) -> Column:
    return F.nullif(F.coalesce(value, F.lit("")), F.lit(""))


def answer_quality(cards: DataFrame) -> DataFrame:
    """Support, confidence and anchor need of every card; cards(answer_id, chapter_id, canonical_question, word_alignment), the last a struct or null."""
    support = F.coalesce(_given(F.col("word_alignment.support_type")), F.lit("ungraded"))
    confidence = F.coalesce(_given(F.col("word_alignment.evidence_confidence")), F.when(F.contains(support, F.lit("missing")), "low").otherwise("ungraded"))
    needs = F.coalesce(F.col("word_alignment.needs_textbook_anchor_review"), F.lit(False)) | (support == MISSING_QUESTION)
    return cards.select(
        "answer_id", "chapter_id", F.left(F.coalesce("canonical_question", F.lit("")), F.lit(SHOWN)).alias("canonical_question"), support.alias("support_type"),
        confidence.alias("confidence"), needs.alias("needs_textbook_anchor_review"),
    )


def field_integrity(sources: DataFrame, answers: DataFrame, evidence_chapters: list[str], graded_chapters: list[str]) -> DataFrame:
    """AUD-03: (chapter_id, issue, n) of what is wrong in the chapters that carry evidence; counted before the shuffle.

    sources(chapter_id, alignment_status, word_status, usable_for_answer); answers as of ``answer_quality``.
    """
    missing = (F.col("alignment_status") == "missing") & (F.col("word_status") == "missing")
    direct = ~F.col("usable_for_answer").eqNullSafe(F.lit("no_direct_output"))
    of_source = F.array_compact(F.array(F.when(missing, F.lit("source_missing_word_alignment")), F.when(direct, F.lit("source_direct_output_policy_not_explicit"))))
    found = sources.where(F.col("chapter_id").isin(evidence_chapters)).select("chapter_id", F.explode(of_source).alias("issue"))
    open_answers = answers.where(F.col("chapter_id").isin([c for c in graded_chapters if c in evidence_chapters]) & (F.col("support_type") == "ungraded"))
    found = found.unionByName(open_answers.select("chapter_id", F.lit("answer_missing_word_alignment").alias("issue")))
    return found.groupBy("chapter_id", "issue").agg(F.count(F.lit(1)).alias("n"))


def chapter_summary(chapters: DataFrame, sources: DataFrame, answers: DataFrame) -> DataFrame:
    """AGG-16: sources, cards and their anchor needs per chapter; chapters(chapter_id, exists).  Chapters without a package have no counts."""
    need = F.count_if(F.coalesce("needs_textbook_anchor_review", F.lit(False)))
    of = lambda rows, total, name: rows.groupBy("chapter_id").agg(F.count(F.lit(1)).alias(total), need.alias(name))
    out = chapters.join(of(sources, "source_chunks", "source_needs_textbook_anchor_review"), "chapter_id", "left")
    out = out.join(of(answers, "answer_cards", "answer_needs_textbook_anchor_review"), "chapter_id", "left")
    counts = ("source_chunks", "answer_cards", "source_needs_textbook_anchor_review", "answer_needs_textbook_anchor_review")
    return out.select("chapter_id", "exists", *[F.when(F.col("exists"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in counts])


def totals(summary: DataFrame) -> DataFrame:
    """AGG-16: one row over all chapters."""
    names = ("source_chunks", "answer_cards", "source_needs_textbook_anchor_review", "answer_needs_textbook_anchor_review")
    return summary.agg(F.count(F.lit(1)).alias("chapters"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def attention(chapters: DataFrame, text_issues: DataFrame, field_issues: DataFrame) -> DataFrame:
    """AGG-16: (chapter_id, issue, details) of chapters to look at: without a package, with faulty texts, with faulty fields.

    text_issues and field_issues(chapter_id, issue, n); details are the issues with their numbers.
    """
    here = chapters.where("exists").select("chapter_id")
    none = F.lit(None).cast("map<string,bigint>")

    def listed(rows: DataFrame, name: str) -> DataFrame:
        found = rows.join(here, "chapter_id", "left_semi").groupBy("chapter_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("issue", "n")))).alias("details"))
        return found.select("chapter_id", F.lit(name).alias("issue"), "details")  # an entry per kind of issue

    absent = chapters.where("not exists").select("chapter_id", F.lit("missing_package").alias("issue"), none.alias("details"))
    return absent.unionByName(listed(text_issues, "text_issue")).unionByName(listed(field_issues, "field_integrity"))


def media_summary(tasks: DataFrame, steps: DataFrame, errors: DataFrame, segments: DataFrame, screenshots: DataFrame) -> DataFrame:
    """AGG-09: how many different video segments and screenshots a task names, and how many of them can be shown.

    steps(task_id, video_segment_id, screenshot_id); errors(task_id, video_segment_id); segments(segment_id, available);
    screenshots(screenshot_id, available).  Sets are made before look-ups, so an id that many steps name is looked up once per task.
    """
    def counted(rows: DataFrame, key: str, known: DataFrame, known_key: str, name: str) -> DataFrame:
        ids = rows.where(F.trim(F.coalesce(key, F.lit(""))) != "").select("task_id", F.col(key).alias("_id")).distinct()
        shown = known.groupBy(F.col(known_key).alias("_k")).agg(F.max("available").alias("_a"))
        found = ids.join(shown, F.col("_id") == F.col("_k"), "left")
        return found.groupBy("task_id").agg(F.count(F.lit(1)).alias(name), F.count_if(F.coalesce("_a", F.lit(False))).alias(f"available_{name}"))

    videos = steps.select("task_id", "video_segment_id").unionByName(errors.select("task_id", "video_segment_id"))
    out = tasks.select("task_id").join(counted(videos, "video_segment_id", segments, "segment_id", "video_segments"), "task_id", "left")
    out = out.join(counted(steps, "screenshot_id", screenshots, "screenshot_id", "screenshots"), "task_id", "left")
    names = [f"{a}{n}" for n in ("video_segments", "screenshots") for a in ("", "available_")]
    return out.select("task_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
