"""Registered queries: operations, routing, answer assembly, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import answers as A
from quillstone.operators import evaluate as E
from quillstone.operators import operations as O
from quillstone.operators import render, resources as R
from quillstone.operators.hybrid import direct_matches, direct_override
from quillstone.operators.keyword import keyword_scores
from quillstone.plans.kb import ASKED, KB, PRELUDE_CTES, norm, sql, toks
from quillstone.plans.registry import register
from quillstone.plans.resources import REC_CTES, RES_CTES, WORDS
from quillstone.plans.retrieval import keyword_ctes

OP_WORDS = O.OperationWords(error=("nicht", "erthth"), check=("eaux", "ble"), step=("the", "que", "los", "und"))


def has_word(x: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


OP_CTES = {
    "oq": f"""select question_id, question, {norm('question')} as qn, {toks('question')} as qt,
        case when {has_word('qn0', OP_WORDS.error)} then 'troubleshoot' when {has_word('qn0', OP_WORDS.check)} then 'checklist'
        when {has_word('qn0', OP_WORDS.step)} then 'step' else '' end as intent
        from (select *, {norm('question')} as qn0 from questions)""",
    "ot": f"""select *, {norm('task_name')} as tn, {norm('task_goal')} as gn, {toks('task_name')} as tt, {toks('task_goal')} as gt
        from tasks where task_name <> ''""",
    "op": """select question_id, intent, task_id, ordinal,
        (case when tn <> '' and contains(qn, tn) then 140.0 when contains(tn, qn) then 100.0
              when gn <> '' and len(list_intersect(qt, tt)) >= 2 then 60.0 else 0.0 end)
        + (case when gn <> '' and len(list_intersect(qt, gt)) > 0 then 15.0 else 0.0 end) as score
        from oq cross join ot where intent <> '' and qn <> ''""",
    "om": """select * from (select *, row_number() over (partition by question_id order by score desc, ordinal) as r from op)
        where r = 1 and score >= 80""",
    "oc": """select question_id, task_id, intent, score, card_id from (select m.*, c.answer_id as card_id,
        row_number() over (partition by question_id order by coalesce(c.answer_mode = m.intent, false) desc, c.ordinal) as r2
        from om m left join cards c on c.related_task = m.task_id) where r2 = 1""",
}


@register("ret_13_operation_intent", sql("select question_id, intent from oq", **OP_CTES))
def _(kb: KB) -> DataFrame:
    return kb.questions.select("question_id", O.operation_intent("question", OP_WORDS).alias("intent"))


@register("ret_14_operation_match", sql("select question_id, task_id, intent, score, card_id from oc", **OP_CTES))
def _(kb: KB) -> DataFrame:
    matches = O.match_tasks(kb.questions, kb.tasks, OP_WORDS)
    return O.card_for_task(matches, kb.cards).select("question_id", "task_id", "intent", "score", "card_id")


@register(
    "ret_14_operation_match_turns",
    sql("select question_id, task_id, intent, score from om", questions="select 'u_' || conv_id || '_' || turn as question_id, text as question from conversations where role = 'user'", **OP_CTES),
)
def _(kb: KB) -> DataFrame:
    return O.match_tasks(kb.turns, kb.tasks, OP_WORDS).select("question_id", "task_id", "intent", "score")


KW_TOP = """select question_id, answer_id, score from (select *, row_number() over (partition by question_id
   order by score desc, ordinal) as rank from kscored where score > 0) where rank = 1"""

ARBITRATION = """coalesce(r.score >= 180 and r.tr = 120 or r.intent >= 1 and r.score >= 180 and r.title_match
   or r.wants and r.intent >= 1 and r.score >= 80 or r.intent >= 1 and r.score >= 120 or r.intent >= 2 and r.score >= 55
   or r.intent >= 1 and r.score >= 90 and coalesce(k.score, 0) < 110 or k.score is null and r.score >= 45, false)"""


ASSEMBLED = f"""select question_id, case when byop then coalesce(card_id, 'operation:' || task_id) when byres then 'resource:' || resource_id
      else answer_id end as answer_id,
      case when byop then 'operation' when byres then 'resource' when answer_id is null then 'none' else 'card' end as branch,
      case when byop then 'high' when byres then case when rscore >= 110 then 'high' else 'medium' end
           when answer_id is not null then case when kscore >= 110 then 'high' when kscore >= 70 then 'medium' else 'low' end end as confidence,
      case when byop then ointent when byres then 'resource_guidance' else top_mode end as answer_mode,
      round(case when byop then oscore when byres then rscore else kscore end, 3) as selected_score from (
      select q.question_id, k.answer_id, k.score as kscore, r.resource_id, r.score as rscore, o.task_id, o.card_id, o.score as oscore,
        o.intent as ointent, c.answer_mode as top_mode,
        coalesce(o.card_id = k1.answer_id, false) or coalesce(c1.related_task = o.task_id, false) or coalesce(o.score >= 120, false)
          or (o.task_id is not null and coalesce(r.suppress_recommendation, false)) as byop,
        {ARBITRATION} as byres
      from questions q left join kfirst k1 on k1.question_id = q.question_id left join cards c1 on c1.answer_id = k1.answer_id
      left join ktop k on k.question_id = q.question_id left join cards c on c.answer_id = k.answer_id
      left join (select * from rtop where rank = 1) r on r.question_id = q.question_id
      left join oc o on o.question_id = q.question_id)"""
#: The best five hits; the card whose own question is asked; the first hit after it has moved to the top.
DIRECT = {
    "kfive": """select * from (select question_id, answer_id, score, row_number() over (partition by question_id
       order by score desc, ordinal) as rank from kscored where score > 0) where rank <= 5""",
    "kfirst": "select question_id, answer_id, score from kfive where rank = 1",
    "dmatch": f"""select {norm('canonical_question')} as key, answer_id, ordinal, 120.0 as priority, 0 as position from cards
       union all select {norm('x')}, answer_id, ordinal, 180.0, i from (select answer_id, ordinal, unnest(student_question_patterns) as x,
         generate_subscripts(student_question_patterns, 1) as i from cards)""",
    "dbest": f"""select * from (select question_id, answer_id, priority, row_number() over (partition by question_id order by priority desc, ordinal, position) as n
       from questions join dmatch on key = {norm('question')} and key <> '') where n = 1""",
    "ktop": """select q.question_id, coalesce(d.answer_id, f.answer_id) as answer_id,
       case when d.answer_id is not null then greatest(coalesce(k.score, 0), d.priority + 220) else f.score end as score
       from questions q left join kfirst f on f.question_id = q.question_id left join dbest d on d.question_id = q.question_id
       left join kfive k on k.question_id = d.question_id and k.answer_id = d.answer_id
       where coalesce(d.answer_id, f.answer_id) is not null""",
}
ASSEMBLY_CTES = {**keyword_ctes("questions"), **DIRECT, **RES_CTES, **OP_CTES}


def assembled(kb: KB, questions: DataFrame, found: DataFrame) -> DataFrame:
    hits = keyword_scores(questions, kb.cards, kb.synonyms, kb.rag, 5)
    operations = O.card_for_task(O.match_tasks(questions, kb.tasks, OP_WORDS), kb.cards)
    return A.assemble(questions, hits, found, operations, R.question_flags(questions, WORDS), kb.cards)


@register(
    "ret_06_direct_override",
    sql(
        """select question_id, answer_id, row_number() over (partition by question_id order by place) as rank, round(score, 6) as score from (
          select coalesce(k.question_id, d.question_id) as question_id, coalesce(k.answer_id, d.answer_id) as answer_id,
            case when d.answer_id is not null then 0 else k.rank end as place, case when d.answer_id is not null then greatest(coalesce(k.score, 0), d.priority + 220) else k.score end as score
          from kfive k full join dbest d on k.question_id = d.question_id and k.answer_id = d.answer_id)""",
        **{**keyword_ctes("questions"), "kfive": DIRECT["kfive"], "dmatch": DIRECT["dmatch"], "dbest": DIRECT["dbest"], "questions": ASKED},
    ),
)
def _(kb: KB) -> DataFrame:
    """A card whose own question is asked moves to the top of the real hits."""
    hits = keyword_scores(kb.asked, kb.cards, kb.synonyms, kb.rag, 5)
    moved = direct_override(kb.asked, hits, direct_matches(kb.cards))
    return moved.select("question_id", "answer_id", "rank", F.round("score", 6).alias("score"))


@register("ret_17_answer_assembly", sql(ASSEMBLED, **{**ASSEMBLY_CTES, "questions": ASKED}))
def _(kb: KB) -> DataFrame:
    return assembled(kb, kb.asked, R.search_resources(kb.asked, kb.resources, None, 1, WORDS))


#: Every other question is the title of the resource that is expected for it.
TITLED = """select 'q' || item_id as question_id, item_id, case when item_id % 2 = 0 and ordinal is not null then title else text end as question
    from benchmark left join resources on ordinal = item_id"""


@register(
    "eva_03_resource_cases",
    sql(
        """select item_id as test_id, expected_resource_id, actual as actual_resource_id, actual = expected_resource_id as top1,
        actual = expected_resource_id as passed from (
          select item_id, 'r' || item_id as expected_resource_id, case when a.branch = 'resource' then substr(a.answer_id, 10) else '' end as actual
          from questions q left join assembled a on a.question_id = q.question_id)""",
        **{
            **ASSEMBLY_CTES, "assembled": ASSEMBLED, "questions": TITLED.replace("resources", f"({PRELUDE_CTES['resources']})"),
        },
    ),
)
def _(kb: KB) -> DataFrame:
    """Every question goes through the whole assembly before its resource is judged."""
    own = kb.resources.select(F.col("ordinal").alias("item_id"), "title")
    text = F.when((F.col("item_id") % 2 == 0) & F.col("title").isNotNull(), F.col("title")).otherwise(F.col("question"))
    asked = kb.questions.join(own, "item_id", "left").select("question_id", "item_id", text.alias("question"))
    found = R.search_resources(asked, kb.resources, None, 3, WORDS)
    cases = asked.select(F.col("item_id").alias("test_id"), "question_id", F.concat(F.lit("r"), "item_id").alias("expected_resource_id"), F.lit("any").alias("expected_resource_type"))
    return E.evaluate_resources(cases, assembled(kb, asked, found), found).select(
        "test_id", "expected_resource_id", "actual_resource_id", "top1", "passed"
    )


@register(
    "ret_12_resource_arbitration",
    sql(
        f"""select q.question_id, {ARBITRATION} as use_resource from questions q
        left join ktop k on k.question_id = q.question_id
        left join (select * from rtop where rank = 1) r on r.question_id = q.question_id""",
        **{**keyword_ctes("questions"), "ktop": KW_TOP, **RES_CTES},
    ),
)
def _(kb: KB) -> DataFrame:
    hits = keyword_scores(kb.questions, kb.cards, kb.synonyms, kb.rag, 1)
    found = R.search_resources(kb.questions, kb.resources, None, 1, WORDS)
    rows = (
        kb.questions.select("question_id")
        .join(hits.select("question_id", F.col("score").alias("answer_score")), "question_id", "left")
        .join(
            found.select(
                "question_id", F.col("score").alias("resource_score"), F.col("reasons").alias("resource_reasons"),
                "intent", "wants_to_see",
            ),
            "question_id",
            "left",
        )
    )
    return rows.select("question_id", R.answer_with_resource(rows).alias("use_resource"))


ROUTE_CTES = {
    "chap": "select distinct lang as chapter_id from documents",
    "rreq": "select question_id, question, c.chapter_id as preferred from questions cross join chap c",
    "dmm": f"""select key, chapter_id, max(priority) as priority from (
        select {norm('canonical_question')} as key, chapter_id, 120.0 as priority from cards
        union all select {norm('student_question_patterns[1]')}, chapter_id, 180.0 from cards where len(student_question_patterns) > 0)
        where key <> '' group by 1, 2""",
    "dms": """select key, list(distinct chapter_id) as chs from dmm join (select key, max(priority) as p from dmm group by 1) using (key)
        where priority = p group by 1""",
    "dr": f"""select question_id, preferred, case when len(chs) = 1 then chs[1] else preferred end as resolved,
        case when len(chs) = 1 and chs[1] = preferred then 'keep_direct_match' when len(chs) = 1 then 'switch_direct_match'
             else 'keep_direct_match_tie' end as decision
        from rreq join dms on key = {norm('question')} where len(chs) = 1 or list_contains(chs, preferred)""",
    "cs": """select question_id, chapter_id, max(score) as score from (
        select k.question_id, c.chapter_id, k.score from kscored k join cards c on c.answer_id = k.answer_id where k.score > 0
        union all select question_id, chapter_id, score from rtop where intent > 0) group by 1, 2""",
    "bs": "select question_id, arg_max(chapter_id, (score, -ascii(chapter_id) * 1000 - ascii(substr(chapter_id, 2)))) as bc, max(score) as bs from cs group by 1",
}


@register(
    "ret_16_chapter_routing",
    sql(
        """select q.question_id, q.preferred, coalesce(d.resolved, case when sw then bc else q.preferred end) as resolved,
        coalesce(d.decision, case when st then 'switch_strong_match' when sw then 'switch_clear_margin' else 'keep_preferred' end) as decision
        from (select r.*, b.bc, b.bs, coalesce(c.score, 0) as ps,
                coalesce(bc <> preferred and bs >= 110 and bs - coalesce(c.score, 0) >= 35, false) as st,
                coalesce(bc <> preferred and (bs >= 110 and bs - coalesce(c.score, 0) >= 35 or bs >= 70 and bs - coalesce(c.score, 0) >= 45), false) as sw
              from rreq r left join bs b using (question_id)
              left join cs c on c.question_id = r.question_id and c.chapter_id = r.preferred) q
        left join dr d on d.question_id = q.question_id and d.preferred = q.preferred""",
        **{**keyword_ctes("questions"), **RES_CTES, **ROUTE_CTES},
    ),
)
def _(kb: KB) -> DataFrame:
    return routed(kb, kb.questions).select("question_id", "preferred", "resolved", "decision")


def routed(kb: KB, questions: DataFrame) -> DataFrame:
    """Every question asked from every chapter (JOI-11): chapters are few and join as a frame."""
    chapters = kb.raw("documents").select(F.col("lang").alias("preferred")).distinct().withColumn("_all", F.lit(1))
    requests = questions.withColumn("_all", F.lit(1)).join(chapters, "_all").drop("_all")
    answers = keyword_scores(questions, kb.cards, kb.synonyms, kb.rag, 1, scope="chapter_id").withColumnRenamed("scope", "chapter_id")
    found = R.search_resources(questions, kb.resources, None, 1, WORDS, scope="chapter_id").withColumnRenamed("scope", "chapter_id")
    return A.route(requests, kb.cards, A.chapter_scores(answers, found, R.question_flags(questions, WORDS)))


@register(
    "joi_15_task_errors",
    sql(
        """select distinct t.task_id, e.error_id from tasks t join errors e on e.task_id = t.task_id
           union select s.task_id, e.error_id from errors e join steps s on s.step_id = e.related_step"""
    ),
)
def _(kb: KB) -> DataFrame:
    return O.task_errors(kb.tasks, kb.steps, kb.errors)


@register(
    "ret_18_task_overview",
    sql(
        """select task_id, task_name, task_goal, coalesce(sc, 0) as step_count, coalesce(ec, 0) as error_count, coalesce(ac, 0) as answer_count
           from tasks left join (select task_id, count(*) as sc from steps group by 1) using (task_id)
           left join (select task_id, count(*) as ec from errors where task_id is not null group by 1) using (task_id)
           left join (select related_task as task_id, count(*) as ac from cards group by 1) using (task_id)"""
    ),
)
def _(kb: KB) -> DataFrame:
    return O.task_overview(kb.tasks, kb.steps, kb.errors, kb.cards)


@register(
    "ret_19_task_resources",
    sql(
        """select task_id, rank, resource_id from (select task_id, resource_id,
           row_number() over (partition by task_id order by src, co, rank, resource_id) as rank from (
             select task_id, resource_id, src, co, rank, row_number() over (partition by task_id, resource_id order by src, co, rank) as once
             from (select c.related_task as task_id, r.resource_id, 0 as src, c.ordinal as co, r.rank from rectop r
                     join cards c on c.answer_id = r.answer_id where r.rank <= 3
                   union all select 't' || (ordinal % 50), resource_id, 1, 0, ordinal from resources)) where once = 1)
           where rank <= 8""",
        **REC_CTES,
    ),
)
def _(kb: KB) -> DataFrame:
    """The text search stands in from the resource order."""
    searched = kb.resources.select(
        F.concat(F.lit("t"), F.col("ordinal") % 50).alias("task_id"), "resource_id", F.col("ordinal").cast("int").alias("rank")
    )
    return O.resources_for_tasks(R.recommend_resources(kb.cards, kb.resources, 3), searched, kb.cards, 8)


COLON = """case when contains(p, '：') then '| ' || trim(split_part(p, '：', 1)) || ' | ' || trim(substr(p, strpos(p, '：') + 1)) || ' |'
  when contains(p, ':') then '| ' || trim(split_part(p, ':', 1)) || ' | ' || trim(substr(p, strpos(p, ':') + 1)) || ' |'
  else '| 比较要点 | ' || trim(p) || ' |' end"""


def rendered_sql(evidence: bool) -> str:
    tail = " || case when trim(source_excerpt) <> '' then chr(10) || chr(10) || '教材依据：' || trim(source_excerpt) else '' end" if evidence else ""
    return f"""case when canonical_question <> '' then '针对“' || canonical_question || '”，教材知识库可概括为：' || chr(10) || chr(10) else '' end
      || case answer_mode
        when 'table' then case when len(answer_points) = 0 then '教材知识库未提供比较维度。' else '| 维度 | 教材要点 |' || chr(10) || '|---|---|' || chr(10)
          || array_to_string([{COLON} for p in answer_points], chr(10)) end
        when 'step' then case when len(answer_points) = 0 then '教材知识库未提供流程步骤。' else
          array_to_string([('步骤' || i || '：' || answer_points[i]) for i in range(1, len(answer_points) + 1)], chr(10)) end
        when 'paragraph' then array_to_string(answer_points, chr(10))
        else case when len(answer_points) = 0 then '教材知识库未提供可直接输出的答案要点。' else
          array_to_string([(i || '. ' || answer_points[i]) for i in range(1, len(answer_points) + 1)], chr(10)) end end{tail}"""


def rendered(cards: DataFrame, evidence: bool = True):
    return render.render_answer(
        F.col("answer_mode"), F.col("canonical_question"), F.col("answer_points"),
        F.col("source_excerpt") if evidence else None, F.lit(""), F.lit(""),
    )


@register("ren_01_render_answer", sql(f"select answer_id, md5({rendered_sql(True)}) as answer from cards"))
def _(kb: KB) -> DataFrame:
    return kb.cards.select("answer_id", F.md5(rendered(kb.cards)).alias("answer"))


@register(
    "ren_02_render_operation",
    sql(
        """select task_id, '针对“' || task_name || '”，可按操作任务“' || task_name || '”来处理。' || chr(10) || chr(10)
          || case when task_goal <> '' then '- 操作目标：' || task_goal || chr(10) || chr(10) else '' end || '操作步骤：' || chr(10)
          || coalesce(lines, '- 暂无结构化步骤。') as answer
          from tasks left join (select task_id, string_agg('步骤' || n || '：' || step_title
             || case when trim(check_point) <> '' then '（检查：' || trim(check_point) || '）' else '' end, chr(10) order by n) as lines
             from (select *, row_number() over (partition by task_id order by step_no, step_id) as n from steps) group by 1) using (task_id)"""
    ),
)
def _(kb: KB) -> DataFrame:
    """Tasks with their steps in order; a task's steps are its own bounded list."""
    steps = kb.steps.groupBy("task_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    O.step_number(F.col("step_no")).alias("n"), "step_id", "step_title", "check_point",
                    F.lit("").alias("command"), F.lit("").alias("expected_result"),
                )
            )
        ).alias("steps")
    )
    none = F.array().cast(
        "array<struct<n:int,step_id:string,step_title:string,check_point:string,command:string,expected_result:string>>"
    )
    no_errors = F.array().cast("array<struct<phenomenon:string,cause:string,solution:string,related_step:string>>")
    rows = kb.tasks.join(steps, "task_id", "left").withColumn("steps", F.coalesce("steps", none))
    empty = F.array().cast("array<string>")
    answer = render.render_operation(
        F.lit(""), F.col("task_name"), F.col("task_goal"), F.lit("step"), F.lit(""), F.col("steps"), no_errors, empty, empty
    )
    return rows.select("task_id", answer.alias("answer"))


@register(
    "ren_03_render_resource",
    sql(
        """select resource_id, '这个问题更适合先查看配套学习资源。' || chr(10) || '- 推荐资源：**' || title || '**' || chr(10) || '- 资源类型：'
        || case resource_type when 'interactive_html' then '互动脚本' when 'image' then '教材图片' when 'formula' then '结构化公式' else '结构化表格' end
        || case when description <> '' then chr(10) || '- 资源说明：' || description else '' end
        || case when resource_type = 'image' and len(keywords) > 0 and array_to_string(keywords[1:6], '、') <> '' then chr(10) || '- 看图要点：' || array_to_string(keywords[1:6], '、') else '' end
        || chr(10) || '- 关联知识点：' || array_to_string(related_kps[1:6], '、') || chr(10)
        || case resource_type when 'formula' then '- 可在右侧资源卡片中查看结构化公式详情。' when 'table' then '- 可在右侧资源卡片中查看结构化表格详情。'
           else '- 可在右侧“推荐资源”卡片中打开文件。' end as answer from resources"""
    ),
)
def _(kb: KB) -> DataFrame:
    answer = render.render_resource(
        F.col("title"), F.col("resource_type"), F.col("description"), F.col("keywords"), F.col("related_kps")
    )
    return kb.resources.select("resource_id", answer.alias("answer"))
