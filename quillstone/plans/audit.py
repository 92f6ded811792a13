"""Registered queries: the evidence audit's totals, attention list and integrity counters, media of tasks, promotion of drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import audit as A
from quillstone.plans.kb import KB, sql
from quillstone.plans.registry import register

EVIDENCE, GRADED = ["en", "fr", "de"], ["en", "fr", "es"]
#: SQL: sources, answers and chapters of the audit.
CTES = {
    "src": """select lang as chapter_id, d.doc_id, text, case when quality is null then 'missing' else 'exact' end as alignment_status, case when coalesce(toxic, 1) = 1 then 'missing' else 'exact' end as word_status,
        case when n_chars % 7 = 0 then 'direct' else 'no_direct_output' end as usable, quality is null as needs from documents d left join labels l on l.doc_id = d.doc_id""",
    "ans": """select *, support = 'word_direct_question_missing' as needs, case when support like '%missing%' then 'low' when support = 'ungraded' then 'ungraded' else 'high' end as confidence from (
        select c.answer_id, c.chapter_id, left(canonical_question, 140) as question, case when l.toxic = 1 then 'word_direct_question_missing' when l.quality is null then 'ungraded' else 'direct' end as support
        from cards c left join labels l on l.doc_id = c.ordinal)""",
    "fld": """select chapter_id, issue, count(*) as n from (
        select chapter_id, 'source_missing_word_alignment' as issue from src where chapter_id in ('en', 'fr', 'de') and alignment_status = 'missing' and word_status = 'missing'
        union all select chapter_id, 'source_direct_output_policy_not_explicit' from src where chapter_id in ('en', 'fr', 'de') and usable <> 'no_direct_output'
        union all select chapter_id, 'answer_missing_word_alignment' from ans where chapter_id in ('en', 'fr') and support = 'ungraded') group by 1, 2""",
    "chp": "select distinct lang as chapter_id, true as here from documents union select 'xx', false",
}


def sources(kb: KB) -> DataFrame:
    rows = kb.raw("documents").join(kb.raw("labels"), "doc_id", "left")
    return rows.select(
        F.col("lang").alias("chapter_id"), "doc_id", "text", F.when(F.col("quality").isNull(), "missing").otherwise("exact").alias("alignment_status"),
        F.when(F.coalesce("toxic", F.lit(1)) == 1, "missing").otherwise("exact").alias("word_status"),
        F.when(F.col("n_chars") % 7 == 0, "direct").otherwise("no_direct_output").alias("usable_for_answer"), F.col("quality").isNull().alias("needs_textbook_anchor_review"),
    )


def answers(kb: KB) -> DataFrame:
    rows = kb.cards.join(kb.raw("labels").select(F.col("doc_id").alias("_d"), "quality", "toxic"), F.col("ordinal") == F.col("_d"), "left")
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    support = F.when(toxic, A.MISSING_QUESTION).when(F.col("quality").isNotNull(), "direct")
    confidence = F.when(~toxic & F.col("quality").isNotNull(), "high")
    alignment = F.struct(support.alias("support_type"), confidence.alias("evidence_confidence"), F.lit(None).cast("boolean").alias("needs_textbook_anchor_review"))
    return A.answer_quality(rows.withColumn("word_alignment", F.when(support.isNotNull(), alignment)))


def chapters(kb: KB) -> DataFrame:
    here = kb.raw("documents").select(F.col("lang").alias("chapter_id")).distinct().withColumn("exists", F.lit(True))
    return here.unionByName(kb.spark.range(1).select(F.lit("xx").alias("chapter_id"), F.lit(False).alias("exists")))


@register("aud_01_answer_quality", sql("select answer_id, chapter_id, question as canonical_question, support as support_type, confidence, needs as needs_textbook_anchor_review from ans", **CTES))
def _(kb: KB) -> DataFrame:
    return answers(kb)


@register("aud_03_field_issues", sql("select * from fld", **CTES))
def _(kb: KB) -> DataFrame:
    return A.field_integrity(sources(kb), answers(kb), EVIDENCE, GRADED)


@register(
    "agg_16_audit_totals",
    sql(
        """select (select count(*) from chp) as chapters, (select count(*) from src) as source_chunks, (select count(*) from ans) as answer_cards,
        (select count(*) from src where needs) as source_needs_textbook_anchor_review, (select count(*) from ans where needs) as answer_needs_textbook_anchor_review""",
        **CTES,
    ),
)
def _(kb: KB) -> DataFrame:
    return A.totals(A.chapter_summary(chapters(kb), sources(kb), answers(kb)))


@register(
    "agg_16_attention_items",
    sql(
        """select chapter_id, 'missing_package' as issue, '' as details from chp where not here
        union all select chapter_id, 'text_issue', string_agg(issue || '=' || n, ',' order by issue) from txt group by 1
        union all select chapter_id, 'field_integrity', string_agg(issue || '=' || n, ',' order by issue) from fld group by 1""",
        **CTES,
        txt="""select lang as chapter_id, issue, count(*) as n from (
            select lang, 'duplicate_period' as issue from documents where contains(text, '..') union all select lang, 'markup' from documents where regexp_matches(text, '<[a-z]+')) group by 1, 2""",
    ),
)
def _(kb: KB) -> DataFrame:
    issues = F.array_compact(F.array(F.when(F.contains("text", F.lit("..")), F.lit("duplicate_period")), F.when(F.col("text").rlike("<[a-z]+"), F.lit("markup"))))
    texts = sources(kb).select("chapter_id", F.explode(issues).alias("issue")).groupBy("chapter_id", "issue").agg(F.count(F.lit(1)).alias("n"))
    found = A.attention(chapters(kb), texts, A.field_integrity(sources(kb), answers(kb), EVIDENCE, GRADED))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return found.select("chapter_id", "issue", F.coalesce(shown, F.lit("")).alias("details"))


@register(
    "agg_09_media_summary",
    sql(
        """select t.task_id, count(distinct v) filter (v <> '') as video_segments, count(distinct v) filter (v <> '' and v in ('g1', 'g2')) as available_video_segments,
        count(distinct s) filter (s <> '') as screenshots, count(distinct s) filter (s <> '' and s like '%2') as available_screenshots
        from tasks t left join (
          select task_id, case when step_no % 3 = 0 then '' else 'g' || (step_no % 5) end as v, 'p' || (length(step_title) % 4) as s from steps
          union all select task_id, 'g' || (length(phenomenon) % 6), '' from errors where task_id is not null) m on m.task_id = t.task_id group by 1"""
    ),
)
def _(kb: KB) -> DataFrame:
    steps = kb.steps.select(
        "task_id", F.when(F.col("step_no") % 3 == 0, "").otherwise(F.concat(F.lit("g"), F.col("step_no") % 5)).alias("video_segment_id"),
        F.concat(F.lit("p"), F.length("step_title") % 4).alias("screenshot_id"),
    )
    errors = kb.errors.where("task_id is not null").select("task_id", F.concat(F.lit("g"), F.length("phenomenon") % 6).alias("video_segment_id"))
    numbers = kb.raw("region").select(F.col("r_regionkey").alias("n"))
    segments = numbers.select(F.concat(F.lit("g"), "n").alias("segment_id"), F.col("n").isin(1, 2).alias("available"))
    shots = numbers.select(F.concat(F.lit("p"), "n").alias("screenshot_id"), (F.col("n") == 2).alias("available"))
    return A.media_summary(kb.tasks, steps, errors, segments, shots)


@register(
    "rev_07_promotion_states",
    """select o_orderkey as draft_id, array_to_string(b, ',') as blockers, len(b) = 0 as promoted from (
      select o_orderkey, case when o_orderkey % 5 = 0 then ['dry_run'] else list_concat(list_concat(
        case when o_orderstatus = 'O' then ['not_confirmed'] else []::varchar[] end, case when bad then ['draft_invalid'] else []::varchar[] end),
        case when o_totalprice > 200000 and o_orderpriority not like '1%' then ['formal_exists'] else []::varchar[] end) end as b
      from orders left join (select distinct l_orderkey, true as bad from lineitem where l_returnflag = 'R') on l_orderkey = o_orderkey)""",
)
def _(kb: KB) -> DataFrame:
    """Orders stand for drafts, returned lines for errors that the validation found."""
    from quillstone.operators.review import promotion_states

    drafts = kb.raw("orders").select(
        F.col("o_orderkey").alias("draft_id"), (F.col("o_orderkey") % 5 != 0).alias("write"), (F.col("o_orderstatus") != "O").alias("confirmed"),
        (F.col("o_totalprice") > 200000).alias("formal_exists"), F.col("o_orderpriority").startswith("1").alias("allow_overwrite"),
    )
    problems = kb.raw("lineitem").select(F.col("l_orderkey").alias("draft_id"), F.when(F.col("l_returnflag") == "R", "error").otherwise("warning").alias("severity"))
    found = promotion_states(drafts, problems)
    return found.select("draft_id", F.array_join("blockers", ",").alias("blockers"), "promoted")


@register(
    "etl_10_relations_if_empty",
    """select 'none' as package, 'card' as kind, doc_id as id from labels where quality = 1 union all select 'some', 'point', doc_id from labels where toxic = 1""",
)
def _(kb: KB) -> DataFrame:
    """A package without relations takes those of its resources, one with relations keeps its own."""
    from quillstone.operators.merge import relations_if_empty

    rows = kb.raw("labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    own = rows.where("toxic = 1").select(F.lit("point").alias("kind"), "id")
    other = rows.where("quality = 1").select(F.lit("card").alias("kind"), "id")
    found = [(name, relations_if_empty(own.where(keep), other)) for name, keep in (("none", "false"), ("some", "true"))]
    first, second = (df.select(F.lit(name).alias("package"), "kind", "id") for name, df in found)
    return first.unionByName(second)


@register(
    "txt_21_mapping_terms",
    r"""select conv_id, turn, coalesce(string_agg(t, ' ' order by i) filter (r <= 18), '') as result from (
      select conv_id, turn, t, i, row_number() over (partition by conv_id, turn order by i) as r from (
        select conv_id, turn, k, arg_min(t, i) as t, min(i) as i from (
          select conv_id, turn, t, i, lower(replace(t, '-', '')) as k from (
            select conv_id, turn, unnest(ts) as t, generate_subscripts(ts, 1) as i from (
              select conv_id, turn, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+*.-]+') as ts from conversations)))
        where length(k) >= 2 and t <> 'GIS' group by 1, 2, 3)) group by 1, 2
      union all select conv_id, turn, '' from conversations where len([w for w in regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+*.-]+')
        if length(replace(w, '-', '')) >= 2 and w <> 'GIS']) = 0""",
)
def _(kb: KB) -> DataFrame:
    """First eighteen distinct terms of every turn, as the line mapping takes them."""
    from quillstone.functions.text import mapping_terms

    return kb.raw("conversations").select("conv_id", "turn", F.array_join(mapping_terms(F.array("text")), " ").alias("result"))
