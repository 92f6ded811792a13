"""Registered queries: validation, audits, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import evaluate as E
from quillstone.operators import quality as Q
from quillstone.operators import resources as R
from quillstone.operators.keyword import keyword_scores
from quillstone.operators.vector import vector_top_k
from quillstone.plans.answers import rendered_sql
from quillstone.plans.functions import COVERAGE
from quillstone.plans.kb import KB, norm, sql
from quillstone.plans.registry import register
from quillstone.plans.resources import RES_CTES, WORDS
from quillstone.plans.retrieval import keyword_ctes

REQUIRED = {
    "cards": ("answer_id", "chapter_id", "section_id", "canonical_question", "question_type", "answer_mode", "status"),
    "knowledge_points": (),
    "chunks": (), "tests": (), "resources": (), "scripts": (), "embeddings": (), "resource_tests": (),
}


def package(kb: KB) -> dict[str, DataFrame]:
    docs = kb.raw("documents")
    return {
        "cards": kb.cards,
        "chunks": docs.select(
            F.concat(F.lit("c"), F.col("n_chars")).alias("chunk_id"),
            F.when(F.col("n_chars") % 7 == 0, "direct").otherwise("no_direct_output").alias("usable_for_answer"),
        ),
        "tests": kb.turns.select(
            F.col("question_id").alias("test_id"), "question",
            F.concat(F.lit("a"), F.split("question_id", "_")[1].cast("long") * 40).alias("expected_answer_card"),
        ).unionByName(
            kb.cards.select(F.concat(F.lit("w"), "answer_id").alias("test_id"), F.col("canonical_question").alias("question"), F.col("answer_id").alias("expected_answer_card"))
        ),
        "resources": kb.resources,
        "scripts": docs.select(
            F.concat(F.lit("sc"), "doc_id").alias("script_id"), F.concat(F.lit("r"), "doc_id").alias("resource_id")
        ),
        "embeddings": kb.raw("embeddings").select(
            F.concat(F.lit("e"), "label").alias("embedding_id"),
            F.when(F.col("label") < 8, "answer_card").otherwise("resource").alias("source_type"),
            F.concat(F.when(F.col("label") < 8, "a").otherwise("r"), F.col("vec_id") * 3).alias("source_id"),
            F.when(F.col("label") == 3, "").otherwise(F.concat(F.lit("a"), F.col("vec_id") * 3)).alias("embedding_text"),
        ),
    }


VALIDATE = f"""
  select severity, rule, object_id, count(*) as n from (
    select 'error' as severity, 'missing_table' as rule, unnest(['knowledge_points', 'resource_tests']) as object_id
    union all select 'error', 'missing_cards:canonical_question', answer_id from cards where canonical_question = ''
    union all select 'error', 'empty_answer_points', answer_id from cards where len(answer_points) = 0
    union all select 'warning', 'empty_must_include', answer_id from cards where len(must_include) = 0
    union all select 'warning', 'not_checked', answer_id from cards where status <> 'checked'
    union all select 'warning', 'duplicate_canonical', k from (select {norm('canonical_question')} as k, answer_id from cards)
       where k <> '' group by k having count(distinct answer_id) > 1
    union all select 'error', 'duplicate_chunks', 'c' || n_chars from (select n_chars, unnest(range(2, count(*) + 1)) from documents group by 1)
    union all select 'warning', 'chunk_policy', 'c' || n_chars from documents where n_chars % 7 = 0
    union all select 'warning', 'unknown_card', question_id from turns t
       where not exists (select 1 from documents where doc_id = cast(split_part(question_id, '_', 2) as bigint) * 40)
    union all select 'warning', 'ambiguous_question', k from (
       select {norm("question")} as k, 'a' || cast(split_part(question_id, '_', 2) as bigint) * 40 as c from turns
       union all select {norm("canonical_question")}, answer_id from cards) where k <> '' group by k having count(distinct c) > 1
    union all select 'error', 'unknown_resource', 'sc' || doc_id from documents where doc_id not in (select page_id from pages)
    union all select 'error', 'duplicate_embeddings', 'e' || label from (select label, unnest(range(2, count(*) + 1)) from embeddings group by 1)
    union all select 'error', 'empty_embedding_text', 'e' || label from embeddings where label = 3
    union all select 'warning', 'id_as_text', 'e' || label from embeddings where label < 8 and label <> 3
    union all select 'error', 'unknown_answer_card', 'e' || label from embeddings where label < 8 and vec_id * 3 not in (select doc_id from documents)
    union all select 'error', 'unknown_resource', 'e' || label from embeddings where label >= 8 and vec_id * 3 not in (select page_id from pages)
  ) group by all"""


@register("val_01_package_validation", sql(VALIDATE))
def _(kb: KB) -> DataFrame:
    found = Q.validate_package(package(kb), REQUIRED)
    return found.groupBy("severity", "rule", "object_id").agg(F.count(F.lit(1)).alias("n"))


@register(
    "val_02_ambiguous_questions",
    sql(
        f"""select 'warning' as severity, 'ambiguous_question' as rule, {norm('canonical_question')} as object_id
        from cards where {norm('canonical_question')} <> '' group by 3 having count(distinct answer_id) > 1"""
    ),
)
def _(kb: KB) -> DataFrame:
    return Q.ambiguous(kb.cards, "canonical_question", "answer_id", "warning", "ambiguous_question")


DECISIONS = """select o_orderkey as k, case o_orderstatus when 'O' then 'ch10' when 'F' then 'ch11' else '' end as chapter_id,
   cast(o_custkey as varchar) as chunk_id,
   ['', 'confirm_candidate_anchor', 'confirm_teaching_summary', 'split_required', 'bad_value'][cast(o_orderkey % 5 + 1 as int)] as decision,
   o_orderkey % 7 - 1 as s, o_orderkey % 4 as e, case when o_orderkey % 3 = 0 then '' else 'note' end as notes from orders"""
ITEMS = """select cast(c_custkey as varchar) as chunk_id, case when c_custkey % 2 = 0 then 'ch10' else 'ch11' end as chapter_id,
   ['candidate_anchor_review', 'term_supported_summary_review', 'boundary_fragment_review', 'manual_anchor_required'][cast(c_custkey % 4 + 1 as int)] as review_status
   from customer"""


@register(
    "val_03_review_decisions",
    f"""with d as ({DECISIONS}), i as ({ITEMS}),
      k as (select d.*, review_status, chapter_id || '/' || chunk_id as key from d join i using (chapter_id, chunk_id)),
      a as (select * from k where decision not in ('', 'bad_value')), c as (select * from a where decision like 'confirm_%')
      select severity, rule, object_id, count(*) as n from (
      select 'error' as severity, 'missing_key' as rule, '/' || chunk_id as object_id from d where chapter_id = ''
      union all select 'error', 'duplicate_decision', chapter_id || '/' || chunk_id from (
        select chapter_id, chunk_id, unnest(range(2, count(*) + 1)) from d where chapter_id <> '' group by 1, 2)
      union all select 'error', 'unknown_item', chapter_id || '/' || chunk_id from d where chapter_id <> '' and (chapter_id, chunk_id) not in (select (chapter_id, chunk_id) from i)
      union all select 'error', 'invalid_decision', key from k where decision = 'bad_value'
      union all select 'error', 'invalid_span', key from c where s <= 0 or e < s
      union all select 'warning', 'no_notes', key from c where notes = ''
      union all select 'warning', 'unusual_decision', key from a where not (
        review_status = 'candidate_anchor_review' and decision = 'confirm_candidate_anchor'
        or review_status = 'term_supported_summary_review' and decision = 'confirm_teaching_summary'
        or review_status = 'boundary_fragment_review' and decision = 'split_required'
        or review_status = 'manual_anchor_required' and decision = 'confirm_candidate_anchor')) group by all""",
)
def _(kb: KB) -> DataFrame:
    """Orders stand for decisions, customers for review items."""
    decisions = kb.raw("orders").select(
        F.when(F.col("o_orderstatus") == "O", "ch10").when(F.col("o_orderstatus") == "F", "ch11").otherwise("").alias("chapter_id"),
        F.col("o_custkey").cast("string").alias("chunk_id"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("", "confirm_candidate_anchor", "confirm_teaching_summary", "split_required", "bad_value")]),
            (F.col("o_orderkey") % 5 + 1).cast("int"),
        ).alias("decision"),
        (F.col("o_orderkey") % 7 - 1).alias("approved_paragraph_start"),
        (F.col("o_orderkey") % 4).alias("approved_paragraph_end"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("note").alias("reviewer_notes"),
    )
    items = kb.raw("customer").select(
        F.col("c_custkey").cast("string").alias("chunk_id"),
        F.when(F.col("c_custkey") % 2 == 0, "ch10").otherwise("ch11").alias("chapter_id"),
        F.element_at(
            F.array(
                *[
                    F.lit(x)
                    for x in (
                        "candidate_anchor_review", "term_supported_summary_review", "boundary_fragment_review", "manual_anchor_required"
                    )
                ]
            ),
            (F.col("c_custkey") % 4 + 1).cast("int"),
        ).alias("review_status"),
    )
    return Q.validate_decisions(decisions, items).groupBy("severity", "rule", "object_id").agg(F.count(F.lit(1)).alias("n"))


@register(
    "aud_01_evidence_quality",
    """select d.lang as chapter_id, case when l.quality is null then 'ungraded' when quality = 1 and toxic = 0 then 'high'
       when quality = 1 then 'medium' else 'low' end as confidence, count(*) as n,
       count(*) filter (quality = 0) as needs_anchor from documents d left join labels l using (doc_id) group by 1, 2""",
)
def _(kb: KB) -> DataFrame:
    """Labels stand for alignment states: good = exact, good but toxic = partial, bad = missing (AGG-08)."""
    state = F.when(F.col("quality").isNull(), "").when((F.col("quality") == 1) & (F.col("toxic") == 0), "exact").when(
        F.col("quality") == 1, "partial"
    ).otherwise("missing")
    rows = kb.raw("documents").join(kb.raw("labels"), "doc_id", "left").select(F.col("lang").alias("chapter_id"), state.alias("state"))
    return rows.groupBy("chapter_id", Q.evidence_confidence(F.col("state"), F.lit("ungraded")).alias("confidence")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "missing").alias("needs_anchor")
    )


@register(
    "aud_02_text_issues",
    """select issue, count(*) as n, min(page_id) as first_page from (
       select page_id, 'duplicate_period_fragment' as issue from pages where regexp_matches(replace(html, '***', '。。'), '。。+')
       union all select page_id, 'word_xml_residue' from pages where regexp_matches(replace(html, '<b>', '<w:b>'), '</?w:|<w\\b')) group by 1""",
)
def _(kb: KB) -> DataFrame:
    """Page markup rewritten so that two of the four patterns occur."""
    text = F.replace(F.replace("html", F.lit("***"), F.lit("。。")), F.lit("<b>"), F.lit("<w:b>"))
    rows = kb.raw("pages").select("page_id", F.explode(Q.text_issues(text)).alias("issue"))
    return rows.groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@register(
    "aud_03_field_integrity",
    """select lang as chapter_id, count(*) filter (l.doc_id is null) as ungraded, count(*) filter (n_chars % 7 = 0) as policy_not_explicit,
       count(*) as chunks from documents d left join labels l using (doc_id) group by 1""".replace("l.doc_id is null", "quality is null"),
)
def _(kb: KB) -> DataFrame:
    rows = kb.raw("documents").join(kb.raw("labels"), "doc_id", "left")
    return rows.groupBy(F.col("lang").alias("chapter_id")).agg(
        F.count_if(F.col("quality").isNull()).alias("ungraded"),
        F.count_if(F.col("n_chars") % 7 == 0).alias("policy_not_explicit"),
        F.count(F.lit(1)).alias("chunks"),
    )


@register(
    "aud_04_resource_coverage",
    sql(
        """select resource_id, eval_cases, array_to_string([x for x in [case when status like '%placeholder%' then 'placeholder_status' end,
        case when not starts_with(file_path, 'https') then 'missing_file' end,
        case when eval_cases = 0 then 'no_resource_eval_case' end] if x is not null], ',') as issues
        from (select r.*, (select count(*) from benchmark where item_id % 11 = r.ordinal) as eval_cases from resources r)"""
    ),
)
def _(kb: KB) -> DataFrame:
    cases = kb.raw("benchmark").select(F.concat(F.lit("r"), F.col("item_id") % 11).alias("expected_resource_id"))
    files = kb.resources.where("file_path like 'https%'").select(
        F.col("file_path").alias("path"), F.col("resource_id").alias("stem")
    )
    return Q.resource_issues(kb.resources, cases, files).select(
        "resource_id", "eval_cases", F.array_join("issues", ",").alias("issues")
    )


@register(
    "aud_05_media_readiness",
    """select count(*) as video_segments, count(*) filter (o_orderstatus = 'F' and c_custkey is not null and c_mktsegment <> 'BUILDING') as available,
         count(*) filter (o_orderstatus <> 'F' or c_custkey is null or c_mktsegment = 'BUILDING') as placeholders,
         count(*) filter (not coalesce(c_custkey % 3 <> 0, false) and c_custkey is not null) as missing_files,
         (select count(distinct l_orderkey) from lineitem) as step_refs,
         (select count(*) from (select distinct l_orderkey from lineitem) where l_orderkey not in (select o_orderkey from orders)) as missing_metadata
       from orders left join customer on c_custkey = o_custkey""".replace(
        "available,", "available0,"
    ).replace(
        "count(*) filter (o_orderstatus = 'F' and c_custkey is not null and c_mktsegment <> 'BUILDING') as available0",
        "count(*) filter (o_orderstatus = 'F' and c_custkey is not null and c_mktsegment <> 'BUILDING' and c_custkey % 3 <> 0) as available",
    ),
)
def _(kb: KB) -> DataFrame:
    """Orders stand for segments, customers for videos, line items for steps."""
    segments = kb.raw("orders").select(
        F.col("o_orderkey").cast("string").alias("segment_id"), F.col("o_custkey").alias("video_id"),
        F.when(F.col("o_orderstatus") == "F", "ready").otherwise("placeholder_open").alias("status"), F.lit("").alias("file_path"),
    )
    videos = kb.raw("customer").select(
        F.col("c_custkey").alias("video_id"), F.concat(F.lit("v/"), "c_custkey").alias("file_path"),
        F.when(F.col("c_mktsegment") == "BUILDING", "needs_upload").otherwise("ready").alias("status"),
    )
    files = kb.raw("customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("v/"), "c_custkey").alias("path"))
    steps = kb.raw("lineitem").select(F.col("l_orderkey").cast("string").alias("segment_id"))
    return Q.media_readiness(steps, segments, videos, files)


CASES = {
    "ec": """select 'q' || item_id as question_id, item_id as test_id, text,
        coalesce((select 'a' || min(doc_id) from documents d where contains(d.text, b.text)), '') as expected,
        [trim(x) for x in string_split(text, chr(10)) if trim(x) <> ''] as pts,
        ['bullet','table','step','paragraph'][cast(item_id % 4 + 1 as int)] as mode from benchmark b""",
    "khits": """select * from (select question_id, answer_id, score, row_number() over (partition by question_id
        order by score desc, ordinal) as rank from kscored where score > 0) where rank <= 3""",
    "ev0": f"""select e.*, h.answer_id as actual, h.score, coalesce({rendered_sql(False)}, '') as answer
        from ec e left join khits h on h.question_id = e.question_id and h.rank = 1 left join cards c on c.answer_id = h.answer_id""",
    "ev1": f"""select * exclude (pts), [{norm('p')} for p in pts] as pts, pts as raw, {norm('answer')} as ans from ev0""",
    "ev": f"""select test_id, mode, expected, coalesce(actual, '') as actual, score, coalesce(actual, '') = expected as top1,
        coalesce(expected in (select answer_id from khits k where k.question_id = ev1.question_id), false) as top3,
        {COVERAGE} as cov, [p for p in raw if not contains(answer, p)] as missing,
        case mode when 'table' then contains(answer, '|') and contains(answer, '---') when 'step' then contains(answer, '步骤') or contains(answer, '1.')
          when 'bullet' then contains(answer, '1.') else trim(answer) <> '' end as fmt,
        contains(answer, 'nicht') as bad from ev1""",
}


def eval_cases(kb: KB) -> DataFrame:
    """QA cases: the expected card is the first document holding the passage."""
    from quillstone.operators.matching import contains_pairs
    from quillstone.plans.kb import lines

    bench = kb.raw("benchmark")
    holders = contains_pairs(kb.raw("documents"), "doc_id", "text", bench, "item_id", "text")
    first = holders.groupBy("item_id").agg(F.min("doc_id").alias("_doc"))
    modes = F.array(*[F.lit(m) for m in ("bullet", "table", "step", "paragraph")])
    return bench.join(first, "item_id", "left").select(
        F.col("item_id").alias("test_id"), F.concat(F.lit("q"), "item_id").alias("question_id"),
        F.coalesce(F.concat(F.lit("a"), "_doc"), F.lit("")).alias("expected_answer_card"),
        lines(F.col("text")).alias("expected_answer_points"), F.array(F.lit("nicht")).alias("should_not_include"),
        F.element_at(modes, (F.col("item_id") % 4 + 1).cast("int")).alias("required_response_mode"),
    )


def eval_rows(kb: KB) -> DataFrame:
    hits = keyword_scores(kb.questions, kb.cards, kb.synonyms, kb.rag, 3)
    cards = kb.cards.withColumns({"concise_answer": F.lit(""), "expanded_answer": F.lit("")})
    return E.evaluate_cases(eval_cases(kb), hits, cards)


@register(
    "eva_01_qa_cases",
    sql(
        """select test_id, expected as expected_answer_card, actual as actual_answer_card, round(score, 6) as score, top1, top3,
        round(cov, 6) as point_coverage, len(missing) as missing, fmt as format_ok, bad as unexpected,
        top1 and cov >= 0.7 and not bad and fmt as passed from ev""",
        **keyword_ctes("questions"), **CASES,
    ),
)
def _(kb: KB) -> DataFrame:
    return eval_rows(kb).select(
        "test_id", "expected_answer_card", "actual_answer_card", F.round("score", 6).alias("score"), "top1", "top3",
        F.round("point_coverage", 6).alias("point_coverage"), F.size("missing_points").alias("missing"), "format_ok",
        (F.size("unexpected_content") > 0).alias("unexpected"), "passed",
    )


@register(
    "eva_02_qa_summary",
    sql(
        """select mode as required_response_mode, count(*) as total, count(*) filter (top1) as top1_hits, count(*) filter (top3) as top3_hits,
        count(*) filter (top1 and cov >= 0.7 and not bad and fmt) as passed, round(count(*) filter (top1) / count(*), 6) as top1_rate,
        round(count(*) filter (top3) / count(*), 6) as top3_rate,
        round(count(*) filter (top1 and cov >= 0.7 and not bad and fmt) / count(*), 6) as pass_rate from ev group by 1""",
        **keyword_ctes("questions"), **CASES,
    ),
)
def _(kb: KB) -> DataFrame:
    return E.summarize(eval_rows(kb), "required_response_mode")


@register(
    "eva_04_latest_runs",
    """select user_id as run_id, arg_max(event_type, (ts, event_id)) as version_id, arg_max(props, (ts, event_id)) as metrics, arg_max(value > 50, (ts, event_id)) as finished
       from events group by 1""",
)
def _(kb: KB) -> DataFrame:
    """The latest row of every run (WIN-09); events stand for run rows."""
    runs = kb.raw("events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("version_id"), F.col("props").alias("metrics"), (F.col("value") > 50).alias("finished"),
        F.struct("ts", "event_id").alias("written_at"),
    )
    return E.latest_runs(runs)
