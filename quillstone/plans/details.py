"""Registered queries: details of cards and scripts, all branches of operation and resource answers, drifting packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import details as D
from quillstone.operators import operations as O
from quillstone.operators import render
from quillstone.plans.kb import KB, lines, sql
from quillstone.plans.registry import register

EMPTY = "array<string>"


def scripts(kb: KB) -> DataFrame:
    """One script per document: its second line is the theme, the others are its steps."""
    rows = kb.raw("documents").withColumn("ls", lines(F.col("text")))
    return rows.select(
        F.col("doc_id").alias("ordinal"), F.concat(F.lit("sc"), "doc_id").alias("script_id"), F.concat(F.lit("r"), F.col("doc_id") % 700).alias("resource_id"),
        F.coalesce(F.get("ls", F.lit(0)), F.lit("")).alias("title"), F.coalesce(F.get("ls", F.lit(1)), F.lit("")).alias("interaction_theme"),
        F.slice("ls", F.lit(3), F.size("ls")).alias("operation_steps"),
    )


SCRIPTS = """select doc_id as ordinal, 'sc' || doc_id as script_id, 'r' || (doc_id % 700) as resource_id, coalesce(ls[1], '') as title, coalesce(ls[2], '') as theme, ls[3:] as steps from doc_lines"""
LAST_SCRIPTS = "select resource_id, arg_max(script_id, ordinal) as script_id, arg_max(theme, ordinal) as theme, arg_max(steps, ordinal) as steps from sc group by 1"
PAYLOADS = """select r.*, s.script_id, theme, steps, resource_type = 'formula' and description <> '' or resource_type = 'table' and len(keywords) > 0 as available,
    '/' || replace(file_path, chr(92), '/') as url_path from resources r left join ls s using (resource_id)"""


def payloads(kb: KB) -> DataFrame:
    """A formula's expression is the resource's description, a table's columns and rows are its keywords."""
    rows = kb.resources.withColumns({"expression": F.col("description"), "columns": F.col("keywords"), "rows": F.col("keywords")})
    return D.resource_payloads(rows, scripts(kb))


@register(
    "ret_18_card_details",
    sql(
        """select c.answer_id, rendered_answer, coalesce(kps, '') as knowledge_points, coalesce(chunks, '') as source_chunks, coalesce(res, '') as recommended_resources, coalesce(tests, '') as qa_cases
        from cards c
        join (select answer_id, md5(concise || '/' || array_to_string(answer_points, '|')) as rendered_answer from (select *, canonical_question as concise from cards)) using (answer_id)
        left join (select answer_id, string_agg(k.kp_id || ':' || k.title, '|' order by k.ordinal) as kps
          from (select answer_id, unnest(list_distinct(related_kps)) as kp_id from cards) join kp k using (kp_id) group by 1) using (answer_id)
        left join (select answer_id, string_agg('c' || d, '|' order by d) as chunks from (
          select answer_id, ordinal as d from cards union select c.answer_id, c.ordinal + 1 from cards c join cards n on n.ordinal = c.ordinal + 1) group by 1) using (answer_id)
        left join (select answer_id, string_agg(p.resource_id || ':' || p.available || ':' || coalesce(p.script_id, ''), '|' order by rank) as res
          from (select answer_id, unnest(recommended_resources) as resource_id, generate_subscripts(recommended_resources, 1) as rank from cards) join pay p using (resource_id) group by 1) using (answer_id)
        left join (select answer_id, string_agg(test_id, '|' order by o, test_id) as tests from (
          select 'a' || (conv_id % 60) as answer_id, 'u_' || conv_id || '_' || turn as test_id, conv_id * 1000 + turn as o,
            row_number() over (partition by conv_id % 60 order by conv_id * 1000 + turn) as r from conversations where role = 'user') where r <= 20 group by 1) using (answer_id)""",
        sc=SCRIPTS,
        ls=LAST_SCRIPTS,
        pay=PAYLOADS,
        kp="select min(p_partkey) as ordinal, 'kp' || (p_partkey % 97) as kp_id, min(p_name) as title from part group by p_partkey % 97",
    ),
)
def _(kb: KB) -> DataFrame:
    """Parts are the knowledge points; a card quotes its own document and the next one; user turns are test cases."""
    own = F.concat(F.lit("c"), F.col("ordinal"))
    cards = kb.cards.withColumn("evidence_chunks", F.array(own, F.concat(F.lit("c"), F.col("ordinal") + 1)))
    points = kb.raw("part").groupBy(F.concat(F.lit("kp"), F.col("p_partkey") % 97).alias("kp_id")).agg(F.min("p_partkey").alias("ordinal"), F.min("p_name").alias("title"))
    chunks = kb.raw("documents").select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("c"), "doc_id").alias("chunk_id"))
    recommended = kb.cards.select("answer_id", F.posexplode("recommended_resources").alias("rank", "resource_id"))
    cases = kb.raw("conversations").where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.concat_ws("_", F.lit("u"), "conv_id", "turn").alias("test_id"),
        F.concat(F.lit("a"), F.col("conv_id") % 60).alias("expected_answer_card"),
    )
    answer = F.md5(F.concat("canonical_question", F.lit("/"), F.array_join("answer_points", "|")))
    found = D.card_details(cards, points, chunks, recommended, payloads(kb), cases, answer)
    kp = lambda x: F.concat_ws(":", x["kp_id"], x["title"])
    resource = lambda x: F.concat_ws(":", x["resource_id"], x["available"].cast("string"), F.coalesce(x["interactive_script"]["script_id"], F.lit("")))
    return found.select(
        "answer_id", "rendered_answer", F.array_join(F.transform("knowledge_points", kp), "|").alias("knowledge_points"),
        F.array_join("source_chunks", "|").alias("source_chunks"), F.array_join(F.transform("recommended_resources", resource), "|").alias("recommended_resources"),
        F.array_join("qa_cases", "|").alias("qa_cases"),
    )


@register(
    "ret_18_script_details",
    sql(
        "select s.script_id, s.title, len(s.steps) as n_steps, p.title as resource_title, p.resource_type, p.available, p.url_path from sc s left join pay p using (resource_id)",
        sc=SCRIPTS,
        ls=LAST_SCRIPTS,
        pay=PAYLOADS,
    ),
)
def _(kb: KB) -> DataFrame:
    found = D.script_details(scripts(kb), payloads(kb))
    return found.select(
        "script_id", "title", F.size("operation_steps").cast("long").alias("n_steps"), F.col("resource.title").alias("resource_title"), "resource.resource_type",
        "resource.available", "resource.url_path",
    )


@register(
    "ren_03_render_script",
    sql(
        """select resource_id, '这个问题更适合先查看配套学习资源。' || chr(10) || '- 推荐资源：**' || title || '**' || chr(10) || '- 资源类型：'
        || case resource_type when 'interactive_html' then '互动脚本' when 'image' then '教材图片' when 'formula' then '结构化公式' else '结构化表格' end
        || case when description <> '' then chr(10) || '- 资源说明：' || description else '' end
        || case when theme <> '' then chr(10) || '- 互动主题：' || theme else '' end
        || case when len(steps) > 0 then chr(10) || '- 建议操作：' || chr(10) || array_to_string(list_transform(steps[1:4], lambda x: '- ' || x), chr(10)) else '' end
        || case when script_id is null and resource_type = 'image' and len(keywords) > 0 and array_to_string(keywords[1:6], '、') <> '' then chr(10) || '- 看图要点：' || array_to_string(keywords[1:6], '、') else '' end
        || chr(10) || '- 关联知识点：' || array_to_string(related_kps[1:6], '、') || chr(10)
        || case resource_type when 'formula' then '- 可在右侧资源卡片中查看结构化公式详情。' when 'table' then '- 可在右侧资源卡片中查看结构化表格详情。'
           else '- 可在右侧“推荐资源”卡片中打开文件。' end as answer from pay""",
        sc=SCRIPTS,
        ls=LAST_SCRIPTS,
        pay=PAYLOADS,
    ),
)
def _(kb: KB) -> DataFrame:
    """Resources with their scripts' themes and steps."""
    script = F.col("interactive_script")
    answer = render.render_resource(
        F.col("title"), F.col("resource_type"), F.col("description"), F.col("keywords"), F.col("related_kps"), script["interaction_theme"], script["operation_steps"]
    )
    return payloads(kb).select("resource_id", answer.alias("answer"))


@register(
    "ren_02_operation_modes",
    sql(
        """select task_id, mode, '针对“' || task_name || '”，可按操作任务“' || task_name || '”来处理。' || chr(10) || chr(10)
          || case when task_goal <> '' then '- 操作目标：' || task_goal || chr(10) || chr(10) else '' end
          || trim(case mode when 'troubleshoot' then wrong || chr(10) || chr(10) || checks when 'checklist' then checks || coalesce(chr(10) || chr(10) || '常见风险：' || chr(10) || risks, '')
            else '操作步骤：' || chr(10) || done || coalesce(chr(10) || chr(10) || '容易出错的地方：' || chr(10) || pitfalls, '') end) as answer
        from (select *, '检查要点：' || chr(10) || coalesce(own_checks, array_to_string(list_transform(case when len(must) > 0 then must else points end[1:8], lambda x: '- ' || x), chr(10)), '- 暂无结构化检查项。') as checks,
            '排查顺序：' || chr(10) || coalesce(own_errors, array_to_string(list_transform(points[1:8], lambda x: '- ' || x), chr(10)), '- 暂无结构化错误记录。') as wrong,
            coalesce(own_steps, array_to_string([ '步骤' || i || '：' || points[i] for i in range(1, len(points) + 1)], chr(10)), '- 暂无结构化步骤。') as done from facts)""",
        tk="select *, ['step', 'checklist', 'troubleshoot', 'steps'][(ordinal % 4 + 1)::int] as mode from tasks",
        st="""select *, row_number() over (partition by task_id order by step_no, step_id) as n from steps join tk using (task_id) where mode <> 'steps'""",
        sl="""select task_id, string_agg('步骤' || n || '：' || step_title || case when trim(check_point) <> '' then '（检查：' || trim(check_point) || '）' else '' end, chr(10) order by n) as own_steps from st group by 1""",
        ck="""select task_id, string_agg('- ' || trim(step_title) || '：' || trim(check_point), chr(10) order by n) as own_checks from (
            select *, row_number() over (partition by task_id order by n) as r from st where trim(check_point) <> '') where r <= 8 group by 1""",
        er="""select t.task_id, e.*, row_number() over (partition by t.task_id order by e.error_id) as r from (
            select distinct t.task_id, e.error_id from tasks t join errors e on e.task_id = t.task_id union select s.task_id, e.error_id from errors e join steps s on s.step_id = e.related_step) t
            join (select error_id, phenomenon, related_step, split_part(phenomenon, ' ', 2) as solution from errors) e using (error_id)""",
        el="""select task_id, string_agg(case when r <= 5 then '- ' || phenomenon || '（可能原因：' || error_id || case when trim(solution) <> '' then '；处理：' || trim(solution) else '' end || '；关联步骤：' || related_step || '）' end, chr(10) order by r) as own_errors,
            string_agg(case when r <= 3 then '- ' || phenomenon end, chr(10) order by r) as risks,
            string_agg(case when r <= 3 then '- ' || phenomenon || case when solution <> '' then '：' || solution else '' end end, chr(10) order by r) as pitfalls from er group by 1""",
        facts="""select tk.*, own_steps, own_checks, own_errors, risks, pitfalls, nullif(c.answer_points, []) as points, nullif(c.must_include, []) as must
            from tk left join sl using (task_id) left join ck using (task_id) left join el using (task_id) left join cards c on c.ordinal = tk.ordinal""",
    ),
)
def _(kb: KB) -> DataFrame:
    """All modes by the task's number; a quarter of the tasks has no steps and falls back on points; errors by task or step."""
    modes = F.array(*[F.lit(m) for m in ("step", "checklist", "troubleshoot", "steps")])
    tasks = kb.tasks.withColumn("mode", F.element_at(modes, (F.col("ordinal") % 4 + 1).cast("int")))
    step = F.struct(O.step_number(F.col("step_no")).alias("n"), "step_id", "step_title", "check_point", F.lit("").alias("command"), F.lit("").alias("expected_result"))
    steps = kb.steps.groupBy("task_id").agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    wrong = O.task_errors(kb.tasks, kb.steps, kb.errors).join(kb.errors.drop("task_id"), "error_id")
    fields = F.struct("error_id", "phenomenon", F.col("error_id").alias("cause"), F.coalesce(F.get(F.split("phenomenon", " "), F.lit(1)), F.lit("")).alias("solution"), "related_step")
    wrong = wrong.groupBy("task_id").agg(F.array_sort(F.collect_list(fields)).alias("_errors"))
    rows = tasks.join(steps, "task_id", "left").join(wrong, "task_id", "left").join(kb.cards.select("ordinal", "answer_points", "must_include"), "ordinal", "left")
    kinds = dict(rows.dtypes)
    none = lambda c: F.array().cast(kinds[c])
    has = F.when(F.col("mode") == "steps", none("_steps")).otherwise(F.coalesce("_steps", none("_steps")))
    rows = rows.withColumns({"_steps": has, "_errors": F.coalesce("_errors", none("_errors")), **{c: F.coalesce(c, F.array().cast(EMPTY)) for c in ("answer_points", "must_include")}})
    answer = render.render_operation(
        F.lit(""), F.col("task_name"), F.col("task_goal"), F.col("mode"), F.lit(""), F.col("_steps"), F.col("_errors"), F.col("answer_points"), F.col("must_include")
    )
    return rows.select("task_id", "mode", answer.alias("answer"))


@register(
    "etl_03_drifting_cards",
    sql(
        """select answer_id, answer_mode, len(pts)::bigint as n_points, md5(array_to_string(pts, '|')) as points, len(chk)::bigint as n_checks,
          case when doc_id % 2 = 0 then concise else '' end as concise_answer from (
          select *, list_sort(list_distinct(list_concat(own, chk))) as pts from (
            select doc_id, 'a' || doc_id as answer_id, case when doc_id % 4 = 1 then 'step' else 'bullet' end as answer_mode, source || '的目标是：' || lang as concise,
              case when doc_id % 3 = 2 then ['{"first":' || n_chars || '}'] else list_distinct(list_filter(list_transform(string_split(translate(array_to_string(ls, chr(10)), '；;' || chr(10), '|||'), '|'), lambda x: trim(x)), lambda x: x <> '')) end as own,
              case when doc_id % 5 = 0 then [lang, source] else [n_chars::varchar] end as chk from doc_lines))"""
    ),
)
def _(kb: KB) -> DataFrame:
    """Every document is a package: its lines are the steps of its card as a list, a text or an object, its checks a text or a number."""
    from quillstone.operators import drift as N

    docs = kb.raw("documents").withColumn("ls", lines(F.col("text")))
    field = lambda value: F.struct(
        F.concat(F.lit("a"), "doc_id").alias("answer_id"), F.when(F.col("doc_id") % 4 == 1, "steps").otherwise("bullet").alias("answer_mode"),
        F.lit("operation_steps").alias("question_type"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("t"), "doc_id")).alias("related_task"), value.alias("operation_steps"),
    )
    shapes = [F.col("ls"), F.array_join("ls", "\n"), F.struct(F.col("n_chars").alias("first"))]
    checks = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('"'), "lang", F.lit("；"), "source", F.lit('"'))).otherwise(F.col("n_chars").cast("string"))
    card = F.when(F.col("doc_id") % 3 == 0, F.to_json(field(shapes[0]))).when(F.col("doc_id") % 3 == 1, F.to_json(field(shapes[1]))).otherwise(F.to_json(field(shapes[2])))
    card = F.concat(F.regexp_replace(card, r"\}$", ""), F.lit(',"must_check":'), checks, F.lit("}"))
    task = F.to_json(F.struct(F.concat(F.lit("t"), "doc_id").alias("task_id"), F.col("source").alias("task_name"), F.col("lang").alias("task_goal")))
    package = F.concat(F.lit('{"Answer_Cards":['), card, F.lit('],"Operation_Tasks":['), task, F.lit("]}"))
    packages = docs.select(F.concat(F.lit("d"), "doc_id").alias("chapter_id"), package.alias("json"))
    found = N.normalize_cards(N.variant_table(packages, "Answer_Cards"), N.variant_table(packages, "Operation_Tasks"))
    even = F.substring("answer_id", 2, 20).cast("long") % 2 == 0
    return found.select(
        "answer_id", "answer_mode", F.size("answer_points").cast("long").alias("n_points"), F.md5(F.array_join(F.array_sort("answer_points"), "|")).alias("points"),
        F.size("must_include").cast("long").alias("n_checks"), F.when(even, F.col("concise_answer")).otherwise("").alias("concise_answer"),
    )
