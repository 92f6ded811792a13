"""Registered queries: alignment, merging, review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import values as V
from quillstone.operators import align as A
from quillstone.operators import merge as M
from quillstone.operators import review as R
from quillstone.plans.functions import SUPPORT, SUPPORTED_LINES, gone, line_support, natural
from quillstone.plans.kb import KB, sql
from quillstone.plans.quality import ITEMS
from quillstone.plans.registry import register

LINES = """select doc_id, i - 1 as ordinal, ls[i] as text, source as section_id
  from (select *, unnest(range(1, len(ls) + 1)) as i from doc_lines)"""


def doc_lines(kb: KB) -> DataFrame:
    from quillstone.plans.kb import lines

    return kb.raw("documents").select(
        "doc_id", F.col("source").alias("section_id"), F.posexplode(lines(F.col("text"))).alias("ordinal", "text")
    )


@register(
    "win_05_line_windows",
    sql(
        """select a.doc_id, a.ordinal as line_start, a.ordinal + s.n - 1 as line_end,
        md5(a.text || case when s.n > 1 then ' ' || b.text else '' end || case when s.n > 2 then ' ' || c.text else '' end) as text
        from ls a cross join (values (1), (2), (3)) s(n)
        left join ls b on b.doc_id = a.doc_id and b.ordinal = a.ordinal + 1 left join ls c on c.doc_id = a.doc_id and c.ordinal = a.ordinal + 2
        where s.n = 1 or (s.n = 2 and b.text is not null) or (s.n = 3 and c.text is not null)""",
        ls=LINES,
    ),
)
def _(kb: KB) -> DataFrame:
    return A.line_windows(doc_lines(kb)).withColumn("text", F.md5("text"))


@register(
    "aud_06_alignment_status",
    f"""with d as (select lang, {gone('lower(text)', '')} as t from documents),
      b as (select item_id, ['en', 'fr', 'de', 'es'][(item_id % 4 + 1)::int] as ch, text, {gone('lower(text)', '')} as s from benchmark),
      w as (select distinct item_id, ch, lower(unnest(regexp_extract_all(text, '[A-Za-z]{{6,}}'))) as w from b),
      k as (select w, ch from (select distinct w, ch from w) where exists (select 1 from d where lang = ch and contains(t, w))),
      n as (select item_id, count(*) as n from w join k using (w, ch) group by 1)
      select b.item_id as chunk_id, case when exists (select 1 from d where lang = ch and contains(t, s)) then 'exact'
        when length(s) >= 20 and exists (select 1 from d where lang = ch and (contains(t, left(s, 40)) or contains(t, right(s, 40)))) then 'partial'
        when n >= 2 then 'concept_supported' else 'missing' end as status from b left join n using (item_id)""",
)
def _(kb: KB) -> DataFrame:
    chunks = kb.raw("benchmark").select(F.col("item_id").alias("chunk_id"), chapter_of(F.col("item_id")).alias("chapter_id"), F.col("text").alias("excerpt"))
    words = F.regexp_extract_all("excerpt", F.lit("[A-Za-z]{6,}"), F.lit(0))
    return A.alignment_status(chunks, chapters(kb), words)


def chapter_of(key):
    return F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (key % 4 + 1).cast("int"))


def chapters(kb: KB) -> DataFrame:
    return kb.raw("documents").select("doc_id", F.col("lang").alias("chapter_id"), "text")


@register(
    "aud_06_term_hits",
    sql(
        f"""select kind, item_id, coalesce(m, '') <> '' as word_hit, coalesce(m, '') as matched_term from items left join (
          select kind, item_id, arg_min(t, i) as m from (select kind, item_id, ch, unnest(ts) as t, generate_subscripts(ts, 1) as i from items) x
          where length({gone('lower(t)', '')}) >= 2 and exists (select 1 from d where lang = ch and contains(txt, {gone('lower(t)', '')})) group by 1, 2) using (kind, item_id)""",
        d=f"select lang, {gone('lower(text)', '')} as txt from documents",
        items="""select 'task' as kind, 't' || ordinal as item_id, ['en', 'fr', 'de', 'es'][(ordinal % 4 + 1)::int] as ch, [task_name, task_goal] as ts from (
            select ordinal, task_name, left(task_goal, 80) as task_goal from tasks)
          union all select 'point', 'p' || p_partkey, ['en', 'fr', 'de', 'es'][(p_partkey % 4 + 1)::int], string_split(p_name, ' ') from part
          union all select 'card', 'q' || item_id, ['en', 'fr', 'de', 'es'][(item_id % 4 + 1)::int], [left(text, 80), split_part(text, '.', 1), right(text, 40)] from benchmark""",
    ),
)
def _(kb: KB) -> DataFrame:
    """Tasks by name and goal, points by the words of a name, cards by parts of their text."""
    kind = lambda name: F.lit(name).alias("kind")
    tasks = kb.tasks.select(kind("task"), F.concat(F.lit("t"), "ordinal").alias("item_id"), chapter_of(F.col("ordinal")).alias("chapter_id"), F.array("task_name", F.left("task_goal", F.lit(80))).alias("terms"))
    points = kb.raw("part").select(kind("point"), F.concat(F.lit("p"), "p_partkey").alias("item_id"), chapter_of(F.col("p_partkey")).alias("chapter_id"), F.split("p_name", " ").alias("terms"))
    text = F.col("text")
    cards = kb.raw("benchmark").select(
        kind("card"), F.concat(F.lit("q"), "item_id").alias("item_id"), chapter_of(F.col("item_id")).alias("chapter_id"),
        F.array(F.left(text, F.lit(80)), F.split(text, "[.]")[0], F.right(text, F.lit(40))).alias("terms"),
    )
    return A.term_hits(tasks.unionByName(points).unionByName(cards), chapters(kb))


@register(
    "aud_06_heading_coverage",
    sql(
        f"""select chapter_id, heading, exists (select 1 from kb where ch = chapter_id and contains(txt, needle)) as kb_hit from (
          select lang as chapter_id, {gone('lower(x)', '')} as needle, arg_min(x, doc_id * 100000 + i) as heading from (select doc_id, lang, unnest(ls) as x, generate_subscripts(ls, 1) as i from doc_lines)
          where length(x) <= 80 and {gone('lower(x)', '')} <> '' group by 1, 2)""",
        kb=f"select ['en', 'fr', 'de', 'es'][(item_id % 4 + 1)::int] as ch, {gone('lower(text)', '')} as txt from benchmark",
    ),
)
def _(kb: KB) -> DataFrame:
    """Every short line is a heading; the benchmark's passages are the knowledge base of four chapters."""
    from quillstone.plans.kb import lines

    rows = kb.raw("documents").select("doc_id", F.col("lang").alias("chapter_id"), F.posexplode(lines(F.col("text"))).alias("i", "heading"))
    headings = rows.select("chapter_id", (F.col("doc_id") * 100000 + F.col("i")).alias("ordinal"), "heading")
    known = kb.raw("benchmark").select(F.col("item_id").alias("doc_id"), chapter_of(F.col("item_id")).alias("chapter_id"), "text")
    return A.heading_coverage(headings, known)


@register("aud_08_boundary_review")
def _(kb: KB) -> DataFrame:
    """Passages against windows of the lines of their section; the sequence ratio has no SQL form."""
    windows = A.line_windows(doc_lines(kb)).join(
        kb.raw("documents").select("doc_id", F.col("source").alias("section_id")), "doc_id"
    )
    chunks = kb.raw("benchmark").select(
        F.col("item_id").alias("chunk_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("section_id"),
        F.col("text").alias("excerpt"), F.split("text", "\n")[0].alias("summary"), F.lit("").alias("heading"),
        F.lit("").alias("classification"),
    )
    return A.boundary_review(chunks, windows)


@register("aud_07_line_mapping")
def _(kb: KB) -> DataFrame:
    """Passages as chunks (first sentence = title, the rest = definition, long words = keywords) mapped to the lines of their section's documents."""
    from quillstone.operators.mapping import map_chunks, section_ranges

    text, lines = F.col("text"), doc_lines(kb)
    title = F.split(text, "[.]")[0]
    listed = F.array().cast("array<string>")
    chunks = kb.raw("benchmark").select(
        F.col("item_id").alias("chunk_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("section_id"), title.alias("section_title"),
        F.lit(None).cast("string").alias("chunk_summary"), text.alias("source_excerpt"), F.lit(None).cast("string").alias("kp_title"),
        F.substring(text, F.length(title) + 2, F.length(text)).alias("definition"), listed.alias("aliases"),
        F.regexp_extract_all(text, F.lit("[A-Za-z]{9,}"), F.lit(0)).alias("keywords"), listed.alias("key_points"),
    )
    whole = F.lit(None).cast("string")
    markers = kb.raw("documents").select("doc_id", F.col("source").alias("section_id"), whole.alias("start_marker"), whole.alias("end_marker"))
    found = map_chunks(chunks, lines.select("doc_id", "ordinal", "text"), section_ranges(lines, markers))
    return found.withColumn("candidates", F.to_json("candidates"))


@register(
    "aud_09_card_classes",
    sql(
        """select answer_id, case when q = 1 and question_type = 'why' and toxic = 0 then 'teaching_rewrite_supported'
        when q = 1 then 'needs_question_alias' else 'needs_textbook_anchor' end as result
        from (select c.answer_id, c.question_type, coalesce(l.quality, 0) as q, coalesce(l.toxic, 1) as toxic
              from cards c left join labels l on l.doc_id = c.ordinal)"""
    ),
)
def _(kb: KB) -> DataFrame:
    rows = kb.cards.join(kb.raw("labels"), F.col("ordinal") == F.col("doc_id"), "left")
    hit, fine = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 0, F.lit(False))
    return rows.select(
        "answer_id", A.card_class(hit, fine, F.col("question_type"), F.col("canonical_question")).alias("result")
    )


@register(
    "aud_09_chunk_classes",
    r"""select d.doc_id, case when quality = 1 then 'direct_textbook_evidence' when quality = 0 then 'summary_with_term_support'
       when regexp_matches(text, '（\d+）|\(\d+\)|^\d+\.') then 'cross_paragraph_or_formula_fragment' else 'needs_manual_textbook_anchor' end as result
       from documents d left join labels l using (doc_id)""",
)
def _(kb: KB) -> DataFrame:
    rows = kb.raw("documents").join(kb.raw("labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "exact").otherwise("missing")
    support = F.when(F.col("quality") == 0, 1).otherwise(0)
    return rows.select("doc_id", A.chunk_class(status, support, F.col("text")).alias("result"))


HEADING_KEYS = f"""select answer_id, h, t, lower({gone('h', V.ENRICH_PUNCTUATION)}) as hk, lower({gone('t', V.ENRICH_PUNCTUATION)}) as tk,
    list_distinct(regexp_extract_all(h, '[A-Za-z][A-Za-z0-9_+.#/-]{{1,32}}')) as hw, list_distinct(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9_+.#/-]{{1,32}}')) as tw
    from (select answer_id, canonical_question as h, array_to_string(answer_points, chr(10)) as t from cards)"""
HEADING_PARTS = """select answer_id, hk, tk, hk <> '' and contains(tk, hk) as inside, tk <> '' and contains(hk, tk) and length(tk) >= 4 as around,
    len(list_intersect(hw, tw)) as common, len(hw) as wanted, case when length(hk) < 4 or length(tk) < 4 then 0.0 else
      len(list_intersect(list_distinct([substr(hk, i, 2) for i in range(1, length(hk))]), list_distinct([substr(tk, i, 2) for i in range(1, length(tk))])))
      / len(list_distinct([substr(hk, i, 2) for i in range(1, length(hk))])) end as ratio from hd"""


@register(
    "aud_09_heading_scores",
    sql(
        """select answer_id, score, score >= 0.42 as auto_apply from (select answer_id, round(case when inside then 1.0::double else 0 end
          + case when around then 0.7::double else 0 end + case when ratio >= 0.7 then least(0.6::double, ratio * 0.6) else 0 end
          + case when wanted > 0 then common::double / wanted else 0 end + least(0.25::double, common * 0.04), 4) as score from parts)""",
        hd=HEADING_KEYS,
        parts=HEADING_PARTS,
    ),
)
def _(kb: KB) -> DataFrame:
    """The canonical question as heading against all points of the card."""
    score = A.heading_score(F.col("canonical_question"), F.array_join("answer_points", "\n"))
    return kb.cards.select("answer_id", score.alias("score"), (score >= 0.42).alias("auto_apply"))


@register(
    "aud_11_verification_counts", f"select lang as chapter_id, status, count(*) as n from (select lang, {SUPPORT} as status from ({SUPPORTED_LINES})) group by 1, 2"
)
def _(kb: KB) -> DataFrame:
    """How many lines of a chapter's documents are supported by the rest of their document, and how."""
    return line_support(kb.raw("documents")).groupBy(F.col("lang").alias("chapter_id"), F.col("result").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "joi_22_term_matrix",
    """with t as (select distinct lower(p_name) as term from part union select distinct lower(split_part(p_name, ' ', 2)) from part
                  union select unnest(['the', 'que', 'nicht', 'para'])),
       x as (select 'word' as kind, lower(text) as s from documents union all select 'kb', lower(text) from conversations)
       select term, kind, count(*) as hits from t join x on contains(s, term) group by 1, 2""",
)
def _(kb: KB) -> DataFrame:
    part = kb.raw("part")
    terms = (
        part.select(F.lower("p_name").alias("term"))
        .unionByName(part.select(F.lower(F.coalesce(F.get(F.split("p_name", " "), F.lit(1)), F.lit(""))).alias("term")))
        .unionByName(kb.spark.createDataFrame([("the",), ("que",), ("nicht",), ("para",)], "term string"))
        .distinct()
    )
    texts = (
        kb.raw("documents").select(F.lit("word").alias("kind"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    ).unionByName(
        kb.raw("conversations").select(F.lit("kb").alias("kind"), F.concat_ws("_", "conv_id", "turn", "role").alias("doc_id"), "text")
    )
    return A.term_matrix(terms, texts)


@register(
    "agg_12_frequent_terms",
    f"""with c as (select t as term, count(*) as n from (select unnest(regexp_extract_all(text, '[A-Za-z]{{4,}}')) as t from documents)
          group by 1 order by n desc, term limit 160)
        select term, n from c where n >= 2 and not exists (select 1 from conversations where contains({gone('lower(text)', '')}, lower(term)))
        order by n desc, term limit 40""",
)
def _(kb: KB) -> DataFrame:
    known = kb.raw("conversations").select(F.concat_ws("_", "conv_id", "turn", "role").alias("doc_id"), "text")
    return A.frequent_terms(kb.raw("documents"), known, "[A-Za-z]{4,}")


@register(
    "joi_19_nearest_caption",
    sql(
        """select doc_id, ordinal, text, off as "offset" from (select a.doc_id, a.ordinal, md5(b.text) as text, b.ordinal - a.ordinal as off,
        row_number() over (partition by a.doc_id, a.ordinal order by abs(b.ordinal - a.ordinal), b.ordinal < a.ordinal) as r
        from ls a join ls b on b.doc_id = a.doc_id and abs(b.ordinal - a.ordinal) <= 6
        where length(a.text) % 10 = 0 and length(b.text) < 60) where r = 1""",
        ls=LINES,
    ),
)
def _(kb: KB) -> DataFrame:
    """Lines of a length divisible by ten stand for pictures, short lines for captions."""
    rows = doc_lines(kb)
    pictures, captions = rows.where("length(text) % 10 = 0"), rows.where("length(text) < 60")
    return A.nearest_row(pictures, captions, A.forward_first(6), "text").withColumn("text", F.md5("text"))


@register(
    "joi_20_nearest_context",
    sql(
        """select doc_id, ordinal, text, off as "offset" from (select a.doc_id, a.ordinal, md5(b.text) as text, b.ordinal - a.ordinal as off,
        row_number() over (partition by a.doc_id, a.ordinal order by b.ordinal desc) as r
        from ls a join ls b on b.doc_id = a.doc_id and b.ordinal between a.ordinal - 3 and a.ordinal - 1
        where length(a.text) < 60 and length(b.text) >= 60) where r = 1""",
        ls=LINES,
    ),
)
def _(kb: KB) -> DataFrame:
    """The nearest of three long lines before a short one."""
    rows = doc_lines(kb)
    return A.nearest_row(rows.where("length(text) < 60"), rows.where("length(text) >= 60"), [-1, -2, -3], "text").withColumn(
        "text", F.md5("text")
    )


def marked(pick: str) -> dict[str, str]:
    return {
        "ls": LINES,
        "starts": f"""select doc_id, section_id, {pick}(ordinal) as start from (select ls.doc_id, s.section_id, ls.ordinal from ls
           join (values ('s1', 'the'), ('s2', 'ing')) s(section_id, marker) on contains(lower({gone('ls.text', V.MAPPING_PUNCTUATION)}), marker)) group by 1, 2""",
        "spans": """select *, (select min(start) from starts b where b.doc_id = a.doc_id and b.start > a.start) as stop from starts a""",
    }


SLICES = """select m.doc_id, m.section_id, l.ordinal from spans m join ls l on l.doc_id = m.doc_id
   and l.ordinal >= m.start and (m.stop is null or l.ordinal < m.stop)"""


def sliced(kb: KB, last: bool) -> DataFrame:
    """Two markers in every document."""
    pairs = [F.struct(F.lit(s).alias("section_id"), F.lit(i).alias("order"), F.lit(m).alias("marker")) for i, (s, m) in enumerate((("s1", "the"), ("s2", "ing")))]
    markers = kb.raw("documents").select("doc_id", F.explode(F.array(*pairs)).alias("m")).select("doc_id", "m.*")
    return A.marker_slices(doc_lines(kb), markers, last).select("doc_id", "section_id", "ordinal")


@register("joi_18_marker_slices", sql(SLICES, **marked("min")))
def _(kb: KB) -> DataFrame:
    return sliced(kb, False)


@register("win_07_last_markers", sql(SLICES, **marked("max")))
def _(kb: KB) -> DataFrame:
    return sliced(kb, True)


@register(
    "joi_20_context_after",
    sql(
        """select doc_id, ordinal, text, off as "offset" from (select a.doc_id, a.ordinal, md5(b.text) as text, b.ordinal - a.ordinal as off,
        row_number() over (partition by a.doc_id, a.ordinal order by b.ordinal) as r
        from ls a join ls b on b.doc_id = a.doc_id and b.ordinal between a.ordinal + 1 and a.ordinal + 7
        where length(a.text) < 60 and length(b.text) >= 60) where r = 1""",
        ls=LINES,
    ),
)
def _(kb: KB) -> DataFrame:
    """The nearest of seven long lines after a short one."""
    rows = doc_lines(kb)
    return A.nearest_row(rows.where("length(text) < 60"), rows.where("length(text) >= 60"), list(range(1, 8)), "text").withColumn("text", F.md5("text"))


# --- merging -------------------------------------------------------------

@register(
    "etl_01_first_text",
    sql(
        """select answer_id, md5(coalesce(nullif(trim(must_include[1]), ''), nullif(trim(answer_points[1]), ''), nullif(trim(canonical_question), ''), '')) as result
        from cards"""
    ),
)
def _(kb: KB) -> DataFrame:
    value = M.first_text(F.get("must_include", F.lit(0)), F.get("answer_points", F.lit(0)), F.col("canonical_question"))
    return kb.cards.select("answer_id", F.md5(value).alias("result"))


@register(
    "set_05_fold_tables",
    """select 'customer' as kind, c_custkey as id, c_mktsegment as segment from customer union all select 'supplier', s_suppkey, null from supplier""",
)
def _(kb: KB) -> DataFrame:
    left = kb.raw("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return M.fold_tables([left, kb.raw("supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))])


@register(
    "set_04_ordered_union",
    sql("select answer_id, array_to_string(list_sort(list_distinct(list_concat(related_kps, recommended_resources))), ',') as result from cards"),
)
def _(kb: KB) -> DataFrame:
    both = M.ordered_union(F.col("related_kps"), F.col("recommended_resources"))
    return kb.cards.select("answer_id", F.array_join(F.sort_array(both), ",").alias("result"))


@register(
    "snk_04_upsert",
    """select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity >= 45)
       union all select l_orderkey, 'U', max(l_extendedprice) from lineitem where l_quantity >= 45 group by 1""",
)
def _(kb: KB) -> DataFrame:
    new = kb.raw("lineitem").where("l_quantity >= 45").select(
        F.col("l_orderkey").alias("o_orderkey"), F.lit("U").alias("o_orderstatus"), F.col("l_extendedprice").alias("o_totalprice")
    )
    old = kb.raw("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return M.upsert(old, new, ["o_orderkey"], "o_totalprice")


@register(
    "snk_04_refresh_only",
    """select o_orderkey, o_orderstatus, coalesce(n, o_orderpriority) as o_orderpriority from orders
       left join (select l_orderkey, 'n' || count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey""",
)
def _(kb: KB) -> DataFrame:
    old = kb.raw("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = kb.raw("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.concat(F.lit("n"), F.count(F.lit(1)).cast("string")).alias("o_orderpriority")
    ).withColumn("o_orderstatus", F.lit("?"))
    new = new.join(old.select("o_orderkey"), "o_orderkey", "left_semi")
    return M.refresh(old, new, ["o_orderkey"], ["o_orderpriority"])


@register(
    "etl_09_missing_media",
    """select distinct cast(o_custkey % 2000 as varchar) as segment_id, 'placeholder_to_bind' as status from orders
       where o_custkey % 2000 not in (select c_custkey from customer where c_acctbal > 0)""",
)
def _(kb: KB) -> DataFrame:
    steps = kb.raw("orders").select((F.col("o_custkey") % 2000).cast("string").alias("segment_id"))
    media = kb.raw("customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("segment_id"))
    return M.missing_media(steps, media, "segment_id")


@register(
    "etl_11_insert_absent",
    """select s_suppkey as id, s_name as name from supplier union all select c_custkey, c_name from customer
       where c_custkey not in (select s_suppkey from supplier)""",
)
def _(kb: KB) -> DataFrame:
    old = kb.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return M.insert_absent(old, kb.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), ["id"])


@register(
    "etl_11_merge_patterns",
    sql(
        """select c.answer_id, count(distinct p.pattern) filter (o.owner is null or o.owner = c.answer_id) as patterns
        from cards c left join allp p on p.answer_id = c.answer_id and p.pattern <> '' left join own o on o.pattern = p.pattern group by 1""",
        inc="select target_id as answer_id, trim(alias_or_question) as pattern from synonyms",
        own="""select pattern, 'a' || min(o) as owner from (select unnest(student_question_patterns) as pattern, ordinal as o from cards)
           group by 1 having count(*) > 1""",
        allp="""select answer_id, unnest(student_question_patterns) as pattern, 0 as s from cards
           union all select answer_id, pattern, 1 from inc where answer_id in (select answer_id from cards) and pattern <> ''""",
    ),
)
def _(kb: KB) -> DataFrame:
    """User turns arrive as patterns; a pattern several cards hold belongs to the first of them."""
    incoming = kb.synonyms.select(F.col("target_id").alias("answer_id"), F.col("alias_or_question").alias("pattern"))
    held = kb.cards.select("ordinal", F.explode("student_question_patterns").alias("pattern"))
    owners = held.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.concat(F.lit("a"), F.min("ordinal")).alias("owner"))
    merged = M.merge_patterns(kb.cards, incoming, owners.where("n > 1").select("pattern", "owner"))
    return merged.select("answer_id", F.size("student_question_patterns").cast("long").alias("patterns"))


@register(
    "etl_07_cases_from_cards",
    sql(
        """select 'eval_' || answer_id as test_id, md5(canonical_question) as question, answer_id as expected_answer_card,
        case when len(must_include) > 0 then len(must_include) else len(answer_points) end as points, answer_mode as required_response_mode from cards"""
    ),
)
def _(kb: KB) -> DataFrame:
    return M.cases_from_cards(kb.cards).select(
        "test_id", F.md5("question").alias("question"), "expected_answer_card", F.size("expected_answer_points").alias("points"),
        "required_response_mode",
    )


TEMPLATES = {"interactive_html": ["我想看{title}。", "{title}怎么操作？"], "image": ["我想看{title}。"], "formula": ["{title}是什么？"]}


@register(
    "etl_08_cases_from_resources",
    sql(
        """select 'reval_' || resource_id || '_' || n as test_id, replace(q, '{title}', title) as question, resource_id as expected_resource_id
        from resources join (values ('interactive_html', 1, '我想看{title}。'), ('interactive_html', 2, '{title}怎么操作？'),
          ('image', 1, '我想看{title}。'), ('formula', 1, '{title}是什么？')) t(kind, n, q) on kind = resource_type"""
    ),
)
def _(kb: KB) -> DataFrame:
    return M.cases_from_resources(kb.resources, TEMPLATES).select("test_id", "question", "expected_resource_id")


SCOPED = {
    "ck": f"select *, {gone('lower(canonical_question)', '')} as k from cards",
    "grp": "select k from ck where k <> '' group by k having count(*) > 1",
    "cand": f"""select answer_id, k, pos, c, {gone('lower(c)', '')} as cc from (
       select answer_id, k, min(pos) as pos, c from (
       select answer_id, k, i as pos, left(case when contains(p, '：') then trim(substr(p, strpos(p, '：') + 1))
          when contains(p, ':') then trim(substr(p, strpos(p, ':') + 1)) else trim(p) end, 80) as c from (
          select answer_id, k, unnest(answer_points) as p, generate_subscripts(answer_points, 1) as i from ck where k in (select k from grp)))
       where c <> '' and {gone('lower(c)', '')} <> k group by 1, 2, 4)""",
    "cnt": "select k, cc, count(*) as n from cand group by 1, 2",
    "uniq": "select answer_id, arg_min(c, pos) as u from cand join cnt using (k, cc) where n = 1 group by 1",
    "frst": "select answer_id, arg_min(c, pos) as f from cand group by 1",
}


@register(
    "etl_06_scope_duplicates",
    sql(
        """select answer_id, md5(case when k in (select k from grp) then coalesce(u, f, answer_id) || ':' || canonical_question else canonical_question end) as result
        from ck left join uniq using (answer_id) left join frst using (answer_id)""",
        **SCOPED,
    ),
)
def _(kb: KB) -> DataFrame:
    return M.scope_duplicates(kb.cards).select("answer_id", F.md5("canonical_question").alias("result"))


@register(
    "etl_16_recommended_by_points",
    sql(
        """select answer_id, row_number() over (partition by answer_id order by source, place, resource_id) as rank, resource_id from (
          select answer_id, 0 as source, 0 as place, unnest(recommended_resources) as resource_id from cards
          union all select answer_id, 1, r.ordinal, resource_id from cards c join resources r
            on len(list_intersect(c.related_kps, r.related_kps)) > 0 and resource_type = 'interactive_html' and not list_contains(recommended_resources, resource_id))"""
    ),
)
def _(kb: KB) -> DataFrame:
    return M.recommended_by_points(kb.cards, kb.resources)


BANK = f"""select answer_id, chapter_id, ordinal, trim(replace(trim(canonical_question), '请查看', '')) as question,
   {gone("lower(trim(canonical_question))", V.BANK_PUNCTUATION)} as k from cards"""


@register(
    "etl_17_question_bank",
    sql(
        """select chapter_id, target_id, category, id from (select chapter_id, answer_id as target_id, '核心概念' as category,
        chapter_id || '_qb_' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end as id from (
          select *, row_number() over (partition by chapter_id order by
            """ + natural("question") + """, ordinal) as n
          from (select *, row_number() over (partition by chapter_id, k order by ordinal) as once from bank where question <> '') where once = 1))""",
        bank=BANK,
    ),
)
def _(kb: KB) -> DataFrame:
    candidates = kb.cards.select(
        "chapter_id", F.col("ordinal").alias("priority"), F.col("canonical_question").alias("question"),
        F.lit("answer_card").alias("target_type"), F.col("answer_id").alias("target_id"), F.lit(False).alias("pinned"),
    )
    bank = M.numbered_bank(M.question_bank(candidates), ("核心概念", "设计流程", "系统功能", "易混辨析"))
    return bank.select("chapter_id", "target_id", "category", "id")


@register(
    "win_04_unique_ids",
    """select ordinal, 'o' || (l_orderkey % 1000) || case when r > 1 then '_dup' || case when r < 10 then '0' || r else r::varchar end else '' end as id
       from (select *, l_orderkey * 10 + l_linenumber as ordinal, row_number() over (partition by l_orderkey % 1000 order by l_orderkey * 10 + l_linenumber) as r from lineitem)""",
)
def _(kb: KB) -> DataFrame:
    rows = kb.raw("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.concat(F.lit("o"), F.col("l_orderkey") % 1000).alias("id")
    )
    return M.unique_ids(rows, "id", "row").select("ordinal", "id")


# --- review --------------------------------------------------------------

def review_items(kb: KB) -> DataFrame:
    statuses = F.array(
        *[F.lit(x) for x in ("candidate_anchor_review", "term_supported_summary_review", "boundary_fragment_review", "manual_anchor_required")]
    )
    return kb.raw("customer").select(
        F.col("c_custkey").cast("string").alias("chunk_id"),
        F.when(F.col("c_custkey") % 2 == 0, "ch10").otherwise("ch11").alias("chapter_id"),
        F.element_at(statuses, (F.col("c_custkey") % 4 + 1).cast("int")).alias("review_status"),
        F.when(F.col("c_acctbal") > 3000, "manual_anchor_pending").when(F.col("c_acctbal") > 0, "reject_candidate").otherwise("").alias("decision"),
    )


@register(
    "rev_01_approval_template",
    f"""select chapter_id, chunk_id, case when chapter_id = 'ch10' and review_status = 'candidate_anchor_review' then 'P1_ch10_quick_confirm'
        when chapter_id = 'ch10' and review_status = 'manual_anchor_required' then 'P1_ch10_formula_gap' when chapter_id = 'ch10' then 'P2_ch10_boundary_summary'
        when review_status = 'candidate_anchor_review' then 'P2_ch11_quick_confirm' when review_status = 'manual_anchor_required' then 'P3_ch11_application_scene_manual'
        else 'P4_ch11_boundary_summary' end as priority_group,
        case review_status when 'candidate_anchor_review' then 'confirm_candidate_anchor' when 'term_supported_summary_review' then 'confirm_teaching_summary'
        when 'boundary_fragment_review' then 'confirm_boundary_fragment' else 'manual_anchor_pending' end as suggested_decision from ({ITEMS})""",
)
def _(kb: KB) -> DataFrame:
    return R.approval_template(review_items(kb)).select("chapter_id", "chunk_id", "priority_group", "suggested_decision")


@register(
    "rev_02_risk_counts",
    f"""select review_status, case when c_acctbal > 3000 then 'high' when review_status in ('boundary_fragment_review', 'term_supported_summary_review') then 'medium'
        else 'low' end as risk, count(*) as n from ({ITEMS.replace('from customer', ', c_acctbal from customer')}) group by 1, 2""",
)
def _(kb: KB) -> DataFrame:
    risk = R.risk_level(F.col("decision"), F.col("review_status"))
    return review_items(kb).groupBy("review_status", risk.alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "rev_03_fill_empty",
    """select cast(c_custkey as varchar) as chunk_id, case when c_acctbal > 3000 then 'manual_anchor_pending' when c_acctbal > 0 then 'reject_candidate'
       when exists (select 1 from orders where o_custkey = c_custkey) then 'split_required' else '' end as decision from customer""",
)
def _(kb: KB) -> DataFrame:
    offered = kb.raw("orders").select(F.col("o_custkey").cast("string").alias("chunk_id")).distinct()
    items = review_items(kb)
    proposals = items.join(offered, "chunk_id", "left_semi").select("chapter_id", "chunk_id", F.lit("split_required").alias("decision"))
    return R.fill_empty(items, proposals).select("chunk_id", "decision")


@register(
    "rev_04_context_packet",
    sql(
        """select i.doc_id, l.ordinal, case when l.ordinal between 2 and 3 then 'candidate' else 'context' end as role, md5(l.text) as text
        from documents i join ls l on l.doc_id = i.doc_id and l.ordinal between 0 and 5""",
        ls=LINES,
    ),
)
def _(kb: KB) -> DataFrame:
    items = kb.raw("documents").select(
        F.col("doc_id").alias("item_id"), "doc_id", F.lit(2).alias("line_start"), F.lit(3).alias("line_end")
    )
    return R.context_packet(items, doc_lines(kb).select("doc_id", "ordinal", "text")).select(
        "doc_id", "ordinal", "role", F.md5("text").alias("text")
    )


SCENES = [("s_the", ("the", "that", "ing")), ("s_que", ("que", "les", "une")), ("s_und", ("und", "nicht", "der"))]


@register(
    "rev_05_scene_inference",
    """select doc_id, case when greatest(a, b, c) = 0 then 'other' when a >= b and a >= c then 's_the' when b >= c then 's_que' else 's_und' end as scene
       from (select doc_id, contains(text, 'the')::int + contains(text, 'that')::int + contains(text, 'ing')::int as a,
         contains(text, 'que')::int + contains(text, 'les')::int + contains(text, 'une')::int as b,
         contains(text, 'und')::int + contains(text, 'nicht')::int + contains(text, 'der')::int as c from documents)""",
)
def _(kb: KB) -> DataFrame:
    return kb.raw("documents").select("doc_id", R.infer_scene(F.col("text"), SCENES).alias("scene"))


@register(
    "rev_06_progress",
    f"""with i as (select *, case when c_acctbal > 0 then 1 else 0 end as f from ({ITEMS.replace('from customer', ', c_acctbal from customer')}))
        select view, name, count(*) as total, sum(f) as filled, count(*) - sum(f) as open, round(sum(f) * 100.0 / count(*), 2) as completion_percent from (
        select 'chapter_id' as view, chapter_id as name, f from i union all select 'review_status', review_status, f from i union all select 'total', 'total', f from i)
        group by 1, 2""",
)
def _(kb: KB) -> DataFrame:
    return R.progress(review_items(kb), ["chapter_id", "review_status"])


@register(
    "rev_08_graded_evidence",
    """select d.doc_id as chunk_id, coalesce(case when c_acctbal > 0 then 'confirm' end, case when quality = 1 then 'auto' end,
         case when o_orderkey is not null then o_orderstatus end, 'ungraded') as grade,
       case when c_acctbal > 0 then 'approval' when quality = 1 then 'automatic' when o_orderkey is not null then 'review' else 'none' end as origin
       from documents d left join labels l using (doc_id) left join orders on o_orderkey = d.doc_id * 2 left join customer on c_custkey = d.doc_id""",
)
def _(kb: KB) -> DataFrame:
    chunks = kb.raw("documents").join(kb.raw("labels"), "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 1, "auto").otherwise("").alias("automatic")
    )
    reviews = kb.raw("orders").where("o_orderkey % 2 = 0").select(
        (F.col("o_orderkey") / 2).cast("long").alias("chunk_id"), F.col("o_orderstatus").alias("review_status")
    )
    approvals = kb.raw("customer").select(
        F.col("c_custkey").alias("chunk_id"), F.when(F.col("c_acctbal") > 0, "confirm").otherwise("").alias("decision")
    )
    return R.graded_evidence(chunks, reviews, approvals)
