"""Review workflow (REV-01 .. REV-08, AGG-14, AGG-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import values as V
from quillstone.operators.quality import validate_decisions


def suggested_decision(status: Column) -> Column:
    """REV-01/02."""
    result = F.lit("manual_anchor_pending")
    for name, decision in V.SUGGESTED_DECISION.items():
        result = F.when(status == name, decision).otherwise(result)
    return result


def excerpt_role(status: Column) -> Column:
    result = F.lit("needs_evidence_boundary_review")
    for name, role in V.EXCERPT_ROLES.items():
        result = F.when(status == name, role).otherwise(result)
    return result


def priority_group(chapter: Column, status: Column, first: str = "ch10", second: str = "ch11") -> Column:
    """REV-01: order in which review items are worked on: the ``first`` chapter's, then all others as the ``second``'s."""
    quick, manual = status == "candidate_anchor_review", status == "manual_anchor_required"
    return (
        F.when((chapter == first) & quick, f"P1_{first}_quick_confirm")
        .when((chapter == first) & manual, f"P1_{first}_formula_gap")
        .when(chapter == first, f"P2_{first}_boundary_summary")
        .when((chapter == second) & quick, f"P2_{second}_quick_confirm")
        .when((chapter == second) & manual, f"P3_{second}_application_scene_manual")
        .otherwise(f"P4_{second}_boundary_summary")
    )


def risk_level(decision: Column, status: Column) -> Column:
    """REV-02."""
    return (
        F.when(decision == "manual_anchor_pending", "high")
        .when(status.isin("boundary_fragment_review", "term_supported_summary_review"), "medium")
        .otherwise("low")
    )


def approval_template(items: DataFrame) -> DataFrame:
    """REV-01: empty approvals with suggestions."""
    status = F.col("review_status")
    return items.select(
        "chapter_id", "chunk_id", priority_group(F.col("chapter_id"), status).alias("priority_group"), "review_status",
        suggested_decision(status).alias("suggested_decision"), F.lit("").alias("decision"),
        excerpt_role(status).alias("source_excerpt_role"),
    )


def fill_empty(approvals: DataFrame, proposals: DataFrame) -> DataFrame:
    """REV-03: a proposal fills only a decision that is still empty."""
    offered = proposals.select("chapter_id", "chunk_id", F.col("decision").alias("_proposed"))
    empty = F.trim(T.text_or_empty("decision")) == ""
    return approvals.join(offered, ["chapter_id", "chunk_id"], "left").withColumn(
        "decision", F.when(empty & F.col("_proposed").isNotNull(), F.col("_proposed")).otherwise(F.col("decision"))
    ).drop("_proposed")


def context_packet(items: DataFrame, lines: DataFrame, reach: int = 2) -> DataFrame:
    """REV-04 / WIN-11: the lines of an item's span and ``reach`` lines around it, with their role.

    items(item_id, doc_id, line_start, line_end); lines(doc_id, ordinal, text).
    Spans are short, so their positions are exploded into an equi-join.
    """
    wanted = items.select(
        "item_id", "doc_id", "line_start", "line_end",
        F.explode(F.sequence(F.col("line_start") - reach, F.col("line_end") + reach)).alias("ordinal"),
    )
    role = F.when(F.col("ordinal").between(F.col("line_start"), F.col("line_end")), "candidate").otherwise("context")
    return wanted.join(lines, ["doc_id", "ordinal"]).select("item_id", "doc_id", "ordinal", role.alias("role"), "text")


def infer_scene(text: Column, rules: list[tuple[str, tuple[str, ...]]]) -> Column:
    """REV-05 / SRT-05: the scene with most matching terms; the first rule wins a tie, none gives other."""
    scores = F.array(
        *[
            F.struct(T.count_words(text, terms).alias("n"), F.lit(-i).alias("p"), F.lit(name).alias("scene"))
            for i, (name, terms) in enumerate(rules)
        ]
    )
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["scene"]).otherwise("other")


def progress(items: DataFrame, fields: list[str]) -> DataFrame:
    """REV-06 / AGG-14: filled and open per value of every field and in total, in one aggregation.

    Grouping sets give all views from a single pass over the items.
    """
    rows = items.select(
        *[F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit("(empty)")).alias(f) for f in fields],
        (F.trim(T.text_or_empty("decision")) != "").alias("_filled"),
    )
    total, filled = F.count(F.lit(1)), F.count_if("_filled")
    grouped = rows.groupingSets([[F.col(f)] for f in fields] + [[]], *[F.col(f) for f in fields]).agg(
        F.grouping_id().alias("_g"), total.alias("total"), filled.alias("filled"), (total - filled).alias("open"),
        F.round(F.try_divide(filled * 100.0, total), 2).alias("completion_percent"),
    )
    view, name = F.lit("total"), F.lit("total")
    for i, field in enumerate(fields):
        own = (1 << len(fields)) - 1 - (1 << (len(fields) - 1 - i))
        view = F.when(F.col("_g") == own, field).otherwise(view)
        name = F.when(F.col("_g") == own, F.col(field)).otherwise(name)
    return grouped.select(view.alias("view"), name.alias("name"), "total", "filled", "open", "completion_percent")


def promotion_blockers(
    draft: DataFrame, items: DataFrame, write: bool, confirmed: bool, formal_exists: bool, allow_overwrite: bool
) -> list[str]:
    """REV-07: reasons why a draft may not become the formal approvals; empty when it may."""
    if not write:
        return ["dry_run"]
    blockers = [] if confirmed else ["not_confirmed"]
    if not validate_decisions(draft, items).where("severity = 'error'").isEmpty():
        blockers.append("draft_invalid")
    if formal_exists and not allow_overwrite:
        blockers.append("formal_exists")
    return blockers


def promotion_states(drafts: DataFrame, problems: DataFrame) -> DataFrame:
    """REV-07 for many drafts: (draft_id, blockers, promoted).

    drafts(draft_id, write, confirmed, formal_exists, allow_overwrite); problems(draft_id, severity) as found by the validation.
    """
    invalid = problems.where("severity = 'error'").select("draft_id").distinct().withColumn("_bad", F.lit(True))
    rows = drafts.join(invalid, "draft_id", "left")
    found = F.array_compact(
        F.array(
            F.when(~F.coalesce("confirmed", F.lit(False)), "not_confirmed"), F.when(F.coalesce("_bad", F.lit(False)), "draft_invalid"),
            F.when(F.coalesce("formal_exists", F.lit(False)) & ~F.coalesce("allow_overwrite", F.lit(False)), "formal_exists"),
        )
    )
    blockers = F.when(F.coalesce("write", F.lit(False)), found).otherwise(F.array(F.lit("dry_run")))
    return rows.select("draft_id", blockers.alias("blockers")).withColumn("promoted", F.size("blockers") == 0)


def graded_evidence(chunks: DataFrame, reviews: DataFrame, approvals: DataFrame) -> DataFrame:
    """REV-08: a manual approval beats the automatic grading, which beats the review state.

    chunks(chunk_id, automatic); reviews(chunk_id, review_status); approvals(chunk_id, decision).
    """
    rows = chunks.join(reviews, "chunk_id", "left").join(approvals, "chunk_id", "left")
    decided = F.nullif(F.trim(T.text_or_empty("decision")), F.lit(""))
    grade = F.coalesce(decided, F.nullif("automatic", F.lit("")), F.col("review_status"), F.lit("ungraded"))
    origin = F.when(decided.isNotNull(), "approval").when(F.coalesce("automatic", F.lit("")) != "", "automatic").when(
        F.col("review_status").isNotNull(), "review"
    ).otherwise("none")
    return rows.select("chunk_id", grade.alias("grade"), origin.alias("origin"))


def with_scenes(items: DataFrame, scenes: DataFrame) -> DataFrame:
    """JOI-21: scene metadata by chapter and chunk; an item without a decision is open."""
    decision = F.trim(T.text_or_empty("decision"))
    return items.join(scenes, ["chapter_id", "chunk_id"], "left").withColumn("decision", decision).withColumn("is_open", F.col("decision") == "")
