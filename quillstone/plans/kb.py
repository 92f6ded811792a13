"""The knowledge-base tables derived from the sample tables.

``kb(spark, sf_dir)`` gives the logical tables as DataFrames; ``PRELUDE`` gives
the same tables as SQL so that every registered query can be checked against
an independent engine.  The mapping:

* documents -> answer cards and source chunks (first line = canonical
  question, second line = question pattern, the rest = answer points, last
  line = must-include), chapter = language, section = source
* labels -> retrieval configuration, review state and evidence grade
* conversations -> synonyms (user turns), operation tasks and their steps
* benchmark -> student questions and the QA test set
* pages -> learning resources and interactive scripts
* embeddings -> embedding corpus; the vector of question i is vector i
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(text: Column) -> Column:
    parts = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


class KB:
    """Lazily built logical tables over one folder of sample tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def cards(self) -> DataFrame:
        d = self.raw("documents").withColumn("ls", lines(F.col("text")))
        labels = self.raw("labels")
        modes = F.array(*[F.lit(m) for m in ("bullet", "table", "step", "paragraph")])
        return d.join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("ordinal"),
            F.concat(F.lit("a"), "doc_id").alias("answer_id"),
            F.col("lang").alias("chapter_id"),
            F.concat("lang", F.lit("_kb_v1.0")).alias("version_id"),
            F.col("source").alias("section_id"),
            F.coalesce(F.try_element_at("ls", F.lit(1)), F.lit("")).alias("canonical_question"),
            F.slice("ls", 2, 1).alias("student_question_patterns"),
            F.slice("ls", F.lit(3), F.size("ls")).alias("answer_points"),
            F.when(F.size("ls") > 2, F.slice("ls", -1, 1))
            .otherwise(F.array().cast("array<string>"))
            .alias("must_include"),
            F.element_at(modes, (F.col("n_chars") % 4 + 1).cast("int")).alias("answer_mode"),
            F.when(F.col("n_chars") % 5 == 0, "why").otherwise("definition").alias("question_type"),
            F.when(F.coalesce(F.col("quality"), F.lit(1)) == 1, "checked").otherwise("draft").alias("status"),
            F.array(F.concat(F.lit("kp"), F.col("doc_id") % 97), F.concat(F.lit("kp"), F.col("n_chars") % 97)).alias(
                "related_kps"
            ),
            F.array(F.concat(F.lit("r"), "doc_id")).alias("recommended_resources"),
            F.concat(F.lit("t"), "doc_id").alias("related_task"),
            F.col("text").alias("source_excerpt"),
        )

    @property
    def questions(self) -> DataFrame:
        return self.raw("benchmark").select(
            F.concat(F.lit("q"), "item_id").alias("question_id"), F.col("item_id"), F.col("text").alias("question")
        )

    @property
    def asked(self) -> DataFrame:
        """The benchmark's questions, every other one in the words of a card's own question."""
        own = self.cards.select(F.col("ordinal").alias("item_id"), F.col("canonical_question").alias("_own"))
        rows = self.questions.join(own, "item_id", "left")
        text = F.when((F.col("item_id") % 2 == 0) & F.col("_own").isNotNull(), F.col("_own")).otherwise(F.col("question"))
        return rows.select("question_id", "item_id", text.alias("question"))

    @property
    def turns(self) -> DataFrame:
        """Every user turn as a question."""
        return self.raw("conversations").where("role = 'user'").select(
            F.concat_ws("_", F.lit("u"), "conv_id", "turn").alias("question_id"), F.col("text").alias("question")
        )

    @property
    def synonyms(self) -> DataFrame:
        return self.raw("conversations").where("role = 'user'").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"),
            F.concat(F.lit("a"), "conv_id").alias("target_id"),
            F.concat(F.lit("s"), "conv_id").alias("standard_id"),
            F.col("text").alias("alias_or_question"),
            F.col("turn").cast("string").alias("priority"),
        )

    @property
    def rag(self) -> DataFrame:
        return self.raw("labels").select(
            F.col("doc_id").alias("ordinal"),
            F.concat(F.lit("a"), "doc_id").alias("object_id"),
            F.lit("answer_card").alias("object_type"),
            (F.col("quality") * 100 + F.col("toxic") * 50).alias("retrieval_priority"),
            F.lit("").alias("index_text"),
            (F.col("quality") == 1).alias("primary_output"),
            (F.col("toxic") == 1).alias("fallback_only"),
        )

    @property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("ordinal"),
            F.concat(F.lit("a"), "vec_id").alias("source_id"),
            F.when(F.col("label") < 8, "answer_card").otherwise("knowledge_point").alias("source_type"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            "label",
        )

    @property
    def question_vectors(self) -> DataFrame:
        return (
            self.raw("benchmark")
            .join(self.raw("embeddings"), F.col("item_id") == F.col("vec_id"))
            .select(
                F.concat(F.lit("q"), "item_id").alias("question_id"),
                F.col("embedding").cast("array<double>").alias("embedding"),
            )
        )

    @property
    def resources(self) -> DataFrame:
        p = self.raw("pages")
        kinds = F.array(*[F.lit(k) for k in ("interactive_html", "image", "formula", "table")])
        title = F.trim(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
        anchors = F.regexp_extract_all(F.col("html"), F.lit('<a href="/[^"]*">([^<]*)</a>'), F.lit(1))
        return p.select(
            F.col("page_id").alias("ordinal"),
            F.concat(F.lit("r"), "page_id").alias("resource_id"),
            F.element_at(kinds, (F.length("url") % 4 + 1).cast("int")).alias("resource_type"),
            title.alias("title"),
            F.trim(F.regexp_extract("html", '(?s)<div class="ad">(.*?)</div>', 1)).alias("description"),
            anchors.alias("keywords"),
            F.array(F.split(title, " ")[0]).alias("reference_aliases"),
            F.array(F.trim(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1))).alias("trigger_questions"),
            F.array(
                F.concat(F.lit("kp"), F.col("page_id") % 97), F.concat(F.lit("kp"), F.length("url") % 97)
            ).alias("related_kps"),
            F.when(F.col("url").startswith("https"), "bound").otherwise("placeholder_to_bind").alias("status"),
            F.contains("url", F.lit("#")).alias("suppress_recommendation"),
            F.col("url").alias("file_path"),
            F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("chapter_id"),
        )

    @property
    def tasks(self) -> DataFrame:
        """One operation task per conversation: the first user sentence names it."""
        first = (
            self.raw("conversations")
            .groupBy("conv_id")
            .agg(
                F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias(
                    "ask"
                ),
                F.min_by(
                    F.when(F.col("role") == "assistant", F.col("text")),
                    F.when(F.col("role") == "assistant", F.col("turn")),
                ).alias("reply"),
            )
        )
        return first.select(
            F.col("conv_id").alias("ordinal"),
            F.concat(F.lit("t"), "conv_id").alias("task_id"),
            F.trim(F.split(F.coalesce("ask", F.lit("")), "[.]")[0]).alias("task_name"),
            F.trim(F.split(F.coalesce("reply", F.lit("")), "[.]")[0]).alias("task_goal"),
        )

    @property
    def steps(self) -> DataFrame:
        return self.raw("conversations").where("role = 'assistant'").select(
            F.concat_ws("_", F.lit("s"), "conv_id", "turn").alias("step_id"),
            F.concat(F.lit("t"), "conv_id").alias("task_id"),
            F.col("turn").alias("step_no"),
            F.trim(F.split("text", "\n")[0]).alias("step_title"),
            F.trim(F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit(""))).alias("check_point"),
        )

    @property
    def errors(self) -> DataFrame:
        """System turns stand for recorded errors; half name a task, half a step."""
        return self.raw("conversations").where("role = 'system'").select(
            F.concat_ws("_", F.lit("e"), "conv_id", "turn").alias("error_id"),
            F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("t"), "conv_id")).alias("task_id"),
            F.concat_ws("_", F.lit("s"), "conv_id", F.col("turn") + 1).alias("related_step"),
            F.trim(F.split("text", "\n")[0]).alias("phenomenon"),
        )


# The same tables for DuckDB.  CTEs that a query does not name cost nothing.
NORM = r"regexp_replace(lower({0}), '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{3000}}，。！？；：、“”‘’（）()\[\]【】《》<>.,!?;:\"''|]+', '', 'g')"
TOKENS = r"list_distinct([w for w in regexp_extract_all(lower({0}), '[a-z0-9+#_.-]+') if length(w) >= 2])"
COMPACT = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')"


def norm(x: str) -> str:
    return NORM.format(x)


def toks(x: str) -> str:
    return TOKENS.format(x)


def compact(x: str) -> str:
    return COMPACT.format(x)


ASKED = """select 'q' || item_id as question_id, item_id,
         case when item_id % 2 = 0 and ordinal is not null then canonical_question else text end as question
  from benchmark left join cards on ordinal = item_id"""
PRELUDE_CTES = {
    "doc_lines": """
  select d.*, [trim(x) for x in string_split(text, chr(10)) if trim(x) <> ''] as ls from documents d""",
    "cards": """
  select d.doc_id as ordinal, 'a' || d.doc_id as answer_id, lang as chapter_id, lang || '_kb_v1.0' as version_id,
         source as section_id, coalesce(ls[1], '') as canonical_question, ls[2:2] as student_question_patterns,
         ls[3:] as answer_points, case when len(ls) > 2 then ls[-1:] else [] end as must_include,
         ['bullet','table','step','paragraph'][cast(n_chars % 4 + 1 as int)] as answer_mode,
         case when n_chars % 5 = 0 then 'why' else 'definition' end as question_type,
         case when coalesce(quality, 1) = 1 then 'checked' else 'draft' end as status,
         ['kp' || (d.doc_id % 97), 'kp' || (n_chars % 97)] as related_kps,
         ['r' || d.doc_id] as recommended_resources, 't' || d.doc_id as related_task, text as source_excerpt
  from doc_lines d left join labels l on l.doc_id = d.doc_id""",
    "questions": "select 'q' || item_id as question_id, item_id, text as question from benchmark",
    "turns": "select 'u_' || conv_id || '_' || turn as question_id, text as question from conversations where role = 'user'",
    "synonyms": """
  select conv_id * 1000 + turn as ordinal, 'a' || conv_id as target_id, text as alias_or_question, turn as priority
  from conversations where role = 'user'""",
    "rag": """
  select 'a' || doc_id as object_id, 'answer_card' as object_type, quality * 100 + toxic * 50 as retrieval_priority,
         quality = 1 as primary_output, toxic = 1 as fallback_only from labels""",
    "vectors": """
  select vec_id as ordinal, 'a' || vec_id as source_id,
         case when label < 8 then 'answer_card' else 'knowledge_point' end as source_type,
         cast(embedding as double[]) as embedding, label from embeddings""",
    "question_vectors": """
  select 'q' || item_id as question_id, cast(embedding as double[]) as embedding
  from benchmark join embeddings on item_id = vec_id""",
    "resources": r"""
  select page_id as ordinal, 'r' || page_id as resource_id,
         ['interactive_html','image','formula','table'][cast(length(url) % 4 + 1 as int)] as resource_type,
         trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) as title,
         trim(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1)) as description,
         regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1) as keywords,
         [string_split(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), ' ')[1]] as reference_aliases,
         [trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1))] as trigger_questions,
         ['kp' || (page_id % 97), 'kp' || (length(url) % 97)] as related_kps,
         case when starts_with(url, 'https') then 'bound' else 'placeholder_to_bind' end as status,
         contains(url, '#') as suppress_recommendation, url as file_path,
         regexp_extract(html, 'lang="([a-z]+)"', 1) as chapter_id
  from pages""",
    "tasks": """
  select conv_id as ordinal, 't' || conv_id as task_id,
         trim(string_split(coalesce(arg_min(text, turn) filter (role = 'user'), ''), '.')[1]) as task_name,
         trim(string_split(coalesce(arg_min(text, turn) filter (role = 'assistant'), ''), '.')[1]) as task_goal
  from conversations group by conv_id""",
    "steps": """
  select 's_' || conv_id || '_' || turn as step_id, 't' || conv_id as task_id, turn as step_no,
         trim(string_split(text, chr(10))[1]) as step_title,
         trim(coalesce(string_split(text, chr(10))[2], '')) as check_point
  from conversations where role = 'assistant'""",
    "errors": """
  select 'e_' || conv_id || '_' || turn as error_id, case when conv_id % 2 = 0 then 't' || conv_id end as task_id,
         's_' || conv_id || '_' || (turn + 1) as related_step, trim(string_split(text, chr(10))[1]) as phenomenon
  from conversations where role = 'system'""",
}


def sql(body: str, **ctes: str) -> str:
    """A query over the derived tables; ``ctes`` are further named subqueries in order."""
    named = {**PRELUDE_CTES, **ctes}
    return "with " + ",\n".join(f"{name} as ({text})" for name, text in named.items()) + "\n" + body
