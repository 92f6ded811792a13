"""Answer texts as column expressions (REN-01 .. REN-04)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import values as V

EMPTY = "array<string>"


def numbered(points: Column, pattern: str) -> Column:
    """Points joined line by line; ``pattern`` holds {n} for the number and {p} for the point."""
    before, after = pattern.split("{n}")
    middle = after.split("{p}")[0]
    return F.array_join(
        F.transform(points, lambda p, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(middle), p)), "\n"
    )


def _table_row(point: Column) -> Column:
    """A point split at its first full-width colon, else at its first colon."""

    def at(mark: str) -> Column:
        position = F.position(F.lit(mark), point)
        left = F.trim(F.substring(point, F.lit(1), position - 1))
        right = F.trim(F.substring(point, position + 1, F.length(point)))
        return F.concat(F.lit("| "), left, F.lit(" | "), right, F.lit(" |"))

    return (
        F.when(F.contains(point, F.lit("：")), at("："))
        .when(F.contains(point, F.lit(":")), at(":"))
        .otherwise(F.concat(F.lit("| 比较要点 | "), F.trim(point), F.lit(" |")))
    )


def render_answer(
    mode: Column, question: Column, points: Column, excerpt: Column | None, expanded: Column, concise: Column
) -> Column:
    """REN-01: the answer of a card; ``excerpt=None`` leaves the evidence out."""
    points = F.coalesce(points, F.array().cast(EMPTY))
    none = F.size(points) == 0
    mode = F.coalesce(F.nullif(mode, F.lit("")), F.lit("bullet"))
    table = F.when(none, V.NO_ROWS).otherwise(
        F.concat(F.lit("| 维度 | 教材要点 |\n|---|---|\n"), F.array_join(F.transform(points, _table_row), "\n"))
    )
    steps = F.when(none, V.NO_STEPS).otherwise(numbered(points, "步骤{n}：{p}"))
    bullets = F.when(none, V.NO_POINTS).otherwise(numbered(points, "{n}. {p}"))
    paragraph = F.coalesce(F.nullif(expanded, F.lit("")), F.nullif(concise, F.lit("")), F.array_join(points, "\n"))
    body = F.when(mode == "table", table).when(mode == "step", steps).when(mode == "paragraph", paragraph).otherwise(bullets)
    prefix = F.when(question != "", F.concat(F.lit("针对“"), question, F.lit("”，教材知识库可概括为：\n\n"))).otherwise("")
    answer = F.concat(prefix, body)
    if excerpt is None:
        return answer
    evidence = F.trim(F.coalesce(excerpt, F.lit("")))
    return F.concat(answer, F.when(evidence != "", F.concat(F.lit("\n\n教材依据："), evidence)).otherwise(""))


def _line(label: str, value: Column) -> Column:
    value = F.coalesce(value, F.lit(""))
    return F.when(value != "", F.concat(F.lit(label), value))


def render_resource(
    title: Column, resource_type: Column, description: Column, keywords: Column, related_kps: Column,
    theme: Column | None = None, steps: Column | None = None,
) -> Column:
    """REN-03: guidance to a resource; script details replace the details of its kind."""
    label = (
        F.when(resource_type == "interactive_html", "互动脚本")
        .when(resource_type == "image", "教材图片")
        .when(resource_type == "formula", "结构化公式")
        .when(resource_type == "table", "结构化表格")
        .otherwise(F.coalesce(F.nullif(resource_type, F.lit("")), F.lit("学习资源")))
    )
    has_script = theme.isNotNull() if theme is not None else F.lit(False)
    steps = F.coalesce(steps if steps is not None else F.lit(None).cast(EMPTY), F.array().cast(EMPTY))
    first = lambda xs, n: F.array_join(F.slice(F.coalesce(xs, F.array().cast(EMPTY)), 1, n), "、")
    closing = (
        F.when(resource_type == "formula", "- 可在右侧资源卡片中查看结构化公式详情。")
        .when(resource_type == "table", "- 可在右侧资源卡片中查看结构化表格详情。")
        .otherwise("- 可在右侧“推荐资源”卡片中打开文件。")
    )
    lines = F.array(
        F.lit("这个问题更适合先查看配套学习资源。"),
        F.concat(F.lit("- 推荐资源：**"), title, F.lit("**")),
        F.concat(F.lit("- 资源类型："), label),
        _line("- 资源说明：", description),
        F.when(has_script, _line("- 互动主题：", theme if theme is not None else F.lit(""))),
        F.when(
            has_script & (F.size(steps) > 0),
            F.concat(
                F.lit("- 建议操作：\n"),
                F.array_join(F.transform(F.slice(steps, 1, 4), lambda s: F.concat(F.lit("- "), s)), "\n"),
            ),
        ),
        F.when(~has_script & (resource_type == "image"), _line("- 看图要点：", first(keywords, 6))),
        _line("- 关联知识点：", first(related_kps, 6)),
        closing,
    )
    return F.array_join(F.array_compact(lines), "\n")


def render_operation(
    question: Column, task_name: Column, goal: Column, mode: Column, question_type: Column, steps: Column,
    errors: Column, points: Column, must: Column,
) -> Column:
    """REN-02: the answer of an operation task.

    steps: array<struct<step_title,expected_result,check_point,command>>;
    errors: array<struct<phenomenon,cause,solution,related_step>>.
    """
    blank = F.lit("")
    clean = lambda xs: F.filter(F.coalesce(xs, F.array().cast(EMPTY)), lambda p: F.trim(p) != "")
    dash = lambda xs, n: F.transform(F.slice(xs, 1, n), lambda p: F.concat(F.lit("- "), p))
    note = lambda label, v: F.when(F.trim(F.coalesce(v, blank)) != "", F.concat(F.lit(label), F.trim(v)))
    bracket = lambda parts: F.when(
        F.size(F.array_compact(parts)) > 0,
        F.concat(F.lit("（"), F.array_join(F.array_compact(parts), "；"), F.lit("）")),
    ).otherwise(blank)

    step_lines = F.when(
        F.size(steps) > 0,
        F.transform(
            steps,
            lambda s, i: F.concat(
                F.lit("步骤"), (i + 1).cast("string"), F.lit("："), s["step_title"],
                bracket(F.array(note("命令/工具：", s["command"]), note("结果：", s["expected_result"]), note("检查：", s["check_point"]))),
            ),
        ),
    ).otherwise(
        F.when(
            F.size(clean(points)) > 0,
            F.transform(clean(points), lambda p, i: F.concat(F.lit("步骤"), (i + 1).cast("string"), F.lit("："), p)),
        ).otherwise(F.array(F.lit("- 暂无结构化步骤。")))
    )
    checks = F.array_compact(
        F.transform(
            steps,
            lambda s: F.when(
                F.trim(F.coalesce(s["check_point"], blank)) != "",
                F.concat(F.lit("- "), F.trim(s["step_title"]), F.lit("："), F.trim(s["check_point"])),
            ).when(
                F.trim(F.coalesce(s["expected_result"], blank)) != "",
                F.concat(F.lit("- "), F.trim(s["step_title"]), F.lit("：确认"), F.trim(s["expected_result"])),
            ),
        )
    )
    fallback = F.when(F.size(F.coalesce(must, F.array().cast(EMPTY))) > 0, clean(must)).otherwise(clean(points))
    check_lines = F.concat(
        F.array(F.lit("检查要点：")),
        F.when(F.size(checks) > 0, F.slice(checks, 1, 8))
        .when(F.size(fallback) > 0, dash(fallback, 8))
        .otherwise(F.array(F.lit("- 暂无结构化检查项。"))),
    )
    error_lines = F.concat(
        F.array(F.lit("排查顺序：")),
        F.when(
            F.size(errors) > 0,
            F.transform(
                F.slice(errors, 1, 5),
                lambda e: F.concat(
                    F.lit("- "), e["phenomenon"],
                    bracket(F.array(note("可能原因：", e["cause"]), note("处理：", e["solution"]), note("关联步骤：", e["related_step"]))),
                ),
            ),
        )
        .when(F.size(clean(points)) > 0, dash(clean(points), 8))
        .otherwise(F.array(F.lit("- 暂无结构化错误记录。"))),
    )
    risks = F.transform(F.slice(errors, 1, 3), lambda e: F.concat(F.lit("- "), e["phenomenon"]))
    pitfalls = F.transform(
        F.slice(errors, 1, 3),
        lambda e: F.concat(
            F.lit("- "), e["phenomenon"],
            F.when(F.coalesce(e["solution"], blank) != "", F.concat(F.lit("："), e["solution"])).otherwise(blank),
        ),
    )
    optional = lambda title, xs: F.when(
        F.size(errors) > 0, F.concat(F.array(blank, F.lit(title)), xs)
    ).otherwise(F.array().cast(EMPTY))
    body = (
        F.when((mode == "troubleshoot") | F.contains(question_type, F.lit("error")), F.concat(error_lines, F.array(blank), check_lines))
        .when(
            (mode == "checklist") | F.contains(question_type, F.lit("checklist")),
            F.concat(check_lines, optional("常见风险：", risks)),
        )
        .otherwise(F.concat(F.array(F.lit("操作步骤：")), step_lines, optional("容易出错的地方：", pitfalls)))
    )
    head = F.concat(
        F.array(
            F.concat(
                F.lit("针对“"), F.coalesce(F.nullif(question, blank), task_name), F.lit("”，可按操作任务“"), task_name, F.lit("”来处理。")
            ),
            blank,
        ),
        F.when(F.coalesce(goal, blank) != "", F.array(F.concat(F.lit("- 操作目标："), goal), blank)).otherwise(
            F.array().cast(EMPTY)
        ),
    )
    return F.trim(F.array_join(F.concat(head, body), "\n"))
