"""Registered queries: normalisers of drifting packages, formula enrichment, evidence profiles, traces and details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import answers as A
from quillstone.operators import enrich as E
from quillstone.operators import normalize as N
from quillstone.operators import resources as R
from quillstone.operators import review as V
from quillstone.operators.keyword import keyword_scores
from quillstone.plans.answers import DIRECT, ROUTE_CTES, rendered, rendered_sql, routed
from quillstone.plans.functions import FORMULA, formula_text, gone
from quillstone.plans.kb import ASKED, KB, lines, norm, sql
from quillstone.plans.registry import register
from quillstone.plans.resources import REC_CTES, RES_CTES
from quillstone.plans.retrieval import keyword_ctes

# --- ETL: the sample tables under drifting names -------------------------


@register(
    "etl_01_synonyms",
    """select conv_id, turn, case when turn % 4 = 3 then 'own' || conv_id else 'syn_' || t || '_' || substr(sha1(t || '|' || a), 1, 10) end as synonym_id,
        a as alias_or_question, t as target_id, case when turn % 2 = 0 then 'term ' || conv_id else a end as standard_term,
        case when role = 'user' then 'alias' else role end as type, case when turn % 5 = 0 then 0 else turn::int end as priority
      from (select *, trim(text, ' ') as a, case when turn % 3 = 0 then 'a' || conv_id else 'kp' || conv_id end as t from conversations)""",
)
def _(kb: KB) -> DataFrame:
    """Aliases, targets, terms, ids and priorities each under two names or missing."""
    c = kb.raw("conversations")
    odd = F.col("turn") % 2 == 1
    drifted = c.select(
        "conv_id", "turn", F.when(odd, F.col("text")).alias("alias"), F.when(~odd, F.array("text")).alias("question"),
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("a"), "conv_id")).alias("answer_id"), F.concat(F.lit("kp"), "conv_id").alias("kp_id"),
        F.when(~odd, F.concat(F.lit(" term "), "conv_id")).alias("term"), F.when(F.col("turn") % 4 == 3, F.concat(F.lit("own"), "conv_id")).alias("id"),
        F.when(F.col("role") != "user", F.col("role")).alias("type"),
        F.when(F.col("turn") % 5 == 0, F.lit("none")).otherwise(F.concat(F.lit("P "), "turn", F.lit(" of 9"))).alias("priority"),
    )
    # the row's keys ride along in its type
    keyed = N.normalize_synonyms(drifted.withColumn("type", F.concat_ws("|", F.coalesce("type", F.lit("alias")), "conv_id", "turn")))
    parts = F.split("type", r"\|")
    return keyed.select(
        parts[1].cast("bigint").alias("conv_id"), parts[2].cast("bigint").alias("turn"), "synonym_id", "alias_or_question", "target_id", "standard_term",
        parts[0].alias("type"), "priority",
    )


@register(
    "etl_01_relations",
    """select o_orderkey, 'rel_' || substr(sha1('c' || o_custkey || '|' || k || '|' || t), 1, 10) as relation_id, 'c' || o_custkey as source_id, t as target_id,
        k as relation_type, case when o_orderkey % 5 = 0 then 3 else 1 end as weight, o_orderkey % 7 <> 0 as use_in_recommendation, false as use_in_rag
      from (select *, case when o_orderkey % 3 = 0 then 'related' else o_orderstatus end as k, 'o' || o_orderkey as t from orders)""",
)
def _(kb: KB) -> DataFrame:
    """Ends and kinds of relations under two names; the target carries the key."""
    o = kb.raw("orders")
    even = F.col("o_orderkey") % 2 == 0
    customer, order = F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey")
    drifted = o.select(
        F.when(even, customer).otherwise(" ").alias("source_kp"), F.when(~even, customer).alias("source"), F.when(even, order).alias("target_id"),
        F.array(F.when(~even, order)).alias("target"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("relation"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(3)).alias("weight"), F.when(F.col("o_orderkey") % 7 == 0, F.lit(False)).alias("use_in_recommendation"),
    )
    found = N.normalize_relations(drifted)
    return found.select(F.expr("cast(substring(target_id, 2) as bigint)").alias("o_orderkey"), *found.columns)


@register(
    "etl_01_resources",
    sql(
        """select resource_id, case when ordinal % 2 = 0 then chapter_id else 'ch00' end as chapter_id,
        case when resource_type = 'table' then 'image' else resource_type end as resource_type, t as title,
        array_to_string(case when ordinal % 3 = 0 and len(keywords) > 0 then keywords when ordinal % 3 <> 0 and len(ks) > 0 then ks
          else [w for w in regexp_split_to_array(t, '[\\s、，,；;：:（）()与和的]+') if length(w) >= 2] end, '/') as keywords,
        array_to_string([related_kps[i] for i in range(1, len(related_kps) + 1) if list_position(related_kps, related_kps[i]) = i], '/') as related_kps, case when ordinal % 4 = 0 then 'placeholder' else status end as status
        from (select *, [kx[i] for i in range(1, len(kx) + 1) if list_position(kx, kx[i]) = i] as ks from (select *, case when title <> '' then title else resource_id end as t,
          [trim(x) for x in regexp_split_to_array(array_to_string(keywords[1:2], ';'), '[；;\\n|]') if trim(x) <> ''] as kx from resources))"""
    ),
)
def _(kb: KB) -> DataFrame:
    """Titles under another name, keywords as lists or texts, points as texts, states missing."""
    r = kb.resources
    third = F.col("ordinal") % 3 == 0
    known = F.when(F.col("ordinal") % 2 == 0, F.col("chapter_id"))
    kind = F.when(F.col("resource_type") == "table", "figure").otherwise(F.col("resource_type"))
    shared = [
        "resource_id", known.alias("chapter_id"), kind.alias("resource_type"), F.lit("").alias("title"), F.col("title").alias("caption_or_name"),
        F.array_join("related_kps", "; ").alias("related_kps"), F.when(F.col("ordinal") % 4 != 0, F.col("status")).alias("status"),
    ]
    as_list = N.normalize_resources(r.where(third).select(*shared, "keywords"), "ch00")
    as_text = N.normalize_resources(r.where(~third).select(*shared, F.array_join(F.slice("keywords", 1, 2), "; ").alias("keywords")), "ch00")
    both = as_list.unionByName(as_text)
    return both.withColumns({"keywords": F.array_join("keywords", "/"), "related_kps": F.array_join("related_kps", "/")})


@register(
    "etl_02_comparisons",
    """select p_partkey, case when p_partkey % 2 = 0 then 'own' || p_partkey else 'cmp_b_' || lpad(p_partkey::varchar, greatest(3, length(p_partkey::varchar))::int, '0') end as comparison_id,
        case when p_partkey % 5 = 0 then p_name else split_part(p_name, ' ', 1) || '与' || p_brand end as title, split_part(p_name, ' ', 1) as object_a, p_brand as object_b,
        case when p_partkey % 3 = 0 then p_type else p_brand || '/' || p_type end as dimensions, 'checked' as status from part""",
)
def _(kb: KB) -> DataFrame:
    """Concept comparisons under both sets of names, dimensions as one text or as a list in a text."""
    p = kb.raw("part")
    a, b = F.split("p_name", " ")[0], F.col("p_brand")
    old = F.col("p_partkey") % 3 == 0
    drifted = p.select(
        F.col("p_partkey").alias("ordinal"), F.lit("b").alias("chapter_id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("own"), "p_partkey")).alias("comparison_id"),
        F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).alias("title"), F.when(old, a).alias("concept_a"), F.when(old, b).alias("concept_b"),
        F.when(~old, a).alias("object_a"), F.when(~old, b).alias("object_b"), F.when(~old, F.concat_ws("|", b, "p_type", b)).alias("comparison_dimensions"),
        F.when(old, F.array("p_type")).alias("dimension"),
    )
    found = N.normalize_comparisons(drifted.withColumn("status", F.concat(F.lit("checked|"), "ordinal")))
    parts = F.split("status", r"\|")
    return found.select(
        parts[1].cast("bigint").alias("p_partkey"), "comparison_id", "title", "object_a", "object_b", F.array_join("dimensions", "/").alias("dimensions"), parts[0].alias("status")
    )


@register(
    "etl_05_exercises",
    """select c_custkey, 'e' || c_custkey as exercise_id, c_name as question, case when c_custkey % 2 = 0 then c_mktsegment else 'short_answer' end as question_type,
        case when c_custkey % 3 = 0 then c_name else c_mktsegment || '/' || c_name end as standard_answer_points, c_mktsegment as grading_rubric from customer""",
)
def _(kb: KB) -> DataFrame:
    c = kb.raw("customer")
    third = F.col("c_custkey") % 3 == 0
    drifted = c.select(
        F.concat(F.lit("e"), "c_custkey").alias("exercise_id"), F.col("c_name").alias("question"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("exercise_type"),
        F.when(~third, F.concat_ws("；", "c_mktsegment", "c_name", F.lit(" "))).alias("answer_points"), F.when(third, F.array(F.lit(" "), "c_name")).alias("standard_answer_points"),
        F.col("c_mktsegment").alias("scoring_rule"),
    )
    found = N.normalize_exercises(drifted)
    return found.select(
        F.expr("cast(substring(exercise_id, 2) as bigint)").alias("c_custkey"), "exercise_id", "question", "question_type",
        F.array_join("standard_answer_points", "/").alias("standard_answer_points"), "grading_rubric",
    )


# --- ETL-14 / WIN-08: formulas in running text ---------------------------

FORMULA_LINES = """select doc_id, i as ordinal, case i % 4 when 0 then x when 1 then '（' || i || ' - 12）' || left(x, 3) when 2 then '其中' || x
    else 'y = ' || left(x, 20) || '（' || i || ' - 12）' end as text from (select doc_id, unnest(ls) as x, generate_subscripts(ls, 1) as i from doc_lines)"""
LABEL = r"[（(]\s*\d+\s*[-－]\s*\d+\s*[）)]"


def is_formula(x: str, prose: bool) -> str:
    tail = f" and not (contains({x}, '则') or contains({x}, '当') or contains({x}, '其中'))" if prose else ""
    return f"(select {FORMULA}{tail} from (select regexp_replace(replace({x}, ' ', ''), '{LABEL}', '', 'g') as b))"


FORMULA_CTES = {
    "fl": FORMULA_LINES,
    "ff": f"""select *, {is_formula('trim(text)', True)} as expr, {is_formula('trim(text)', False)} as looks,
        [replace(regexp_replace(k, '[（()）\\s]', '', 'g'), '－', '-') for k in regexp_extract_all(text, '{LABEL}')] as keys from fl""",
    "fn": """select a.*, b.n, b.side, trim(c.text) as nt, c.expr as ne, c.looks as nl, c.keys as nk from ff a
        cross join (values (1, -1), (2, -1), (3, -1), (1, 1), (2, 1), (3, 1)) b(n, side) left join ff c on c.doc_id = a.doc_id and c.ordinal = a.ordinal + b.n * b.side
        where len(a.keys) > 0""",
    "fa": f"""select doc_id, ordinal, any_value(keys[1]) as label_key, any_value(regexp_replace(split_part(regexp_replace(text, '{LABEL}', chr(1)), chr(1), 1), '^[ \\t:：，,。]+|[ \\t:：，,。]+$', '', 'g')) as head,
        arg_min(nt, n) filter (side = -1 and nt <> '' and ne and (len(nk) = 0 or list_contains(nk, keys[1]))) as before,
        arg_min(nt, n) filter (side = 1 and nt <> '' and ne and (len(nk) = 0 or list_contains(nk, keys[1]))) as after,
        coalesce(arg_min(nt, n) filter (side = -1 and nt <> '' and not nl), '') as context from fn group by 1, 2""",
    "fo": f"""select doc_id, ordinal, label_key, context, trim(regexp_replace(regexp_replace(coalesce(case when {is_formula('head', True)} and head <> '' then head end,
        case when head <> '' then coalesce(after, before) else coalesce(before, after) end, ''), '{LABEL}', '', 'g'), '\\s+', ' ', 'g')) as expression from fa""",
    "fb": f"""select *, row_number() over (partition by label_key order by {is_formula('expression', True)} desc,
        (contains(expression, '则') or contains(expression, '当') or contains(expression, '其中')), contains(expression, '=') desc, least(length(expression), 220) desc, doc_id, ordinal) as r,
        count(*) over (partition by label_key) as n from fo""",
}


@register(
    "etl_14_formula_enrichment",
    sql(
        """select resource_id, k as label_key, coalesce(expression, '') as expression, coalesce(regexp_replace(context, '\\s+', ' ', 'g'), '') as context_before,
        case when coalesce(expression, '') <> '' then 'extracted' else 'needs_manual_review' end as extraction_status,
        case when coalesce(expression, '') <> '' then 'structured' else status end as status, coalesce(n, 0) as occurrences
        from (select *, (ordinal % 60) || '-12' as k from resources) left join (select * from fb where r = 1) on label_key = k""",
        **FORMULA_CTES,
    ),
)
def _(kb: KB) -> DataFrame:
    """Every resource asks for a number label; the labels stand in the lines of all documents."""
    rows = kb.raw("documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("ordinal", "line")).withColumn("ordinal", F.col("ordinal") + 1)
    texts = rows.select("doc_id", "ordinal", formula_text(F.col("line"), F.col("ordinal")).alias("text"))
    asked = kb.resources.select("resource_id", "title", "status", F.concat(F.col("ordinal") % 60, F.lit("-12")).alias("label_key"))
    return E.enrich_formulas(asked, E.formula_occurrences(texts))


@register(
    "etl_14_table_enrichment",
    sql(
        """select resource_id, key as label_key, case when whole then 'structured' when b.label_key is not null and coalesce(status, '') = '' then 'placeholder' else status end as status,
        coalesce(len(cells), 0) as n_columns, coalesce(n, 0) as n_rows, coalesce(context, '') as context_before, coalesce(array_to_string(vals, '/'), '') as cell_values,
        not coalesce(whole, false) as unresolved
        from (select *, (ordinal % 40) || '-' || (ordinal % 7) as key from resources) r left join b on b.label_key = r.key""",
        tl="""select doc_id, i as ordinal, x as text, replace(x, ',', '|') as p from (select doc_id, unnest(ls) as x, generate_subscripts(ls, 1) as i from doc_lines)""",
        tp="""select *, contains(p, '|') as pipe, contains(p, '|') and coalesce(contains(lag(p) over w, '|'), false) as joined from tl window w as (partition by doc_id order by ordinal)""",
        tw="""select *, case when pipe then max(case when pipe and not joined then ordinal end) over (partition by doc_id order by ordinal) end as island,
            min(case when pipe and not joined then ordinal end) over (partition by doc_id order by ordinal rows between 1 following and unbounded following) as nxt,
            max(case when not pipe then ordinal end) over (partition by doc_id order by ordinal rows between unbounded preceding and 1 preceding) as prev from tp""",
        cap="""select (doc_id % 40) || '-' || (doc_id % 7) as label_key, doc_id, ordinal, p, case when nxt <= ordinal + 12 then nxt end as island, case when prev >= ordinal - 7 then prev end as prev from tw
            where not pipe and p in (select distinct p from tw where not pipe)""",
        best="""select * from (select *, row_number() over (partition by label_key order by doc_id desc, ordinal desc) as r from cap) where r = 1""",
        cut="""select t.label_key, w.ordinal, list_transform(string_split(w.p, '|'), lambda c: trim(c)) as c, w.ordinal = t.island as head
            from best t join tw w on w.doc_id = t.doc_id and w.island = t.island and w.ordinal <= t.ordinal + 12""",
        heads="select label_key, c as cells from cut where head",
        fulls="""select label_key, count(*) as n, list(c[len(cells)] order by cut.ordinal) as vals from cut join heads using (label_key) where not head and len(c) >= len(cells) group by 1""",
        b="""select t.label_key, cells, n, vals, w.p as context, coalesce(len(cells) > 0 and n > 0, false) as whole
            from best t left join heads h on h.label_key = t.label_key left join fulls f on f.label_key = t.label_key
            left join tw w on w.doc_id = t.doc_id and w.ordinal = t.prev""",
    ),
)
def _(kb: KB) -> DataFrame:
    """Every comma of a line is a cell border; every line without one is a caption of its document's table number."""
    from quillstone.operators import tables as B

    rows = kb.raw("documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("i", "line"))
    text = rows.select("doc_id", (F.col("i") + 1).alias("ordinal"), F.translate("line", ",", "|").alias("text"))
    key = lambda c: F.concat((c % 40).cast("string"), F.lit("-"), (c % 7).cast("string"))
    captions = text.where(~F.contains("text", F.lit("|"))).select(key(F.col("doc_id")).alias("label_key"), F.concat(F.lit("表"), key(F.col("doc_id"))).alias("label"), F.col("text").alias("title"))
    tables = B.captioned_tables(text, captions, only=F.col("label_key") == key(F.col("doc_id")), best=True)
    number = F.concat(F.lit("table_"), (F.col("ordinal") % 40).cast("string"), F.lit("_"), (F.col("ordinal") % 7).cast("string"))
    asked = kb.resources.select(
        F.concat(number, F.lit(" "), "resource_id").alias("resource_id"), F.lit("").alias("title"), "status", F.lit("").alias("qa_use"), F.lit("").alias("teaching_use"), "keywords"
    )
    found = B.enrich_tables(asked, tables, kb.cards.select("answer_id", "recommended_resources"))
    last = F.transform("table_detail.rows", lambda r: r[F.element_at("table_detail.columns", -1)])
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return found.select(
        F.element_at(F.split("resource_id", " "), -1).alias("resource_id"), "label_key", "status", count(F.col("table_detail.columns")).alias("n_columns"),
        count(F.col("table_detail.rows")).alias("n_rows"), F.coalesce("table_detail.context_before", F.lit("")).alias("context_before"),
        F.coalesce(F.array_join(last, "/"), F.lit("")).alias("cell_values"), "unresolved",
    )


@register(
    "etl_15_figure_binding",
    sql(
        """select resource_id, k as label_key, fp as file_path, case when fp is not null then 'bound' else status end as status,
        array_to_string(case when fp is not null and k <> reference_aliases[1] then list_concat(reference_aliases, ['图' || k, '图 ' || k, k]) else reference_aliases end, '|') as aliases, distance
        from (select *, (ordinal % 25) || '-' || (ordinal % 9) as k from resources)
        left join (select label_key, arg_min(picture, (doc_id, p)) as fp, arg_min(d, (doc_id, p)) as distance from nearest group by 1) on label_key = k""",
        bl="""select doc_id, i as ordinal, case when i % 6 = 3 then '见图 ' || i || ' - ' || (length(x) % 9) else x end as text, case when i % 6 = 1 then 'p' || doc_id || '_' || i end as picture
            from (select doc_id, unnest(ls) as x, generate_subscripts(ls, 1) as i from doc_lines)""",
        lb="select doc_id, ordinal, regexp_extract(text, '图\\s*(\\d+)\\s*[-－—]\\s*(\\d+)', 1) || '-' || regexp_extract(text, '图\\s*(\\d+)\\s*[-－—]\\s*(\\d+)', 2) as label_key from bl where regexp_matches(text, '图\\s*\\d+\\s*[-－—]\\s*\\d+')",
        nearest="""select doc_id, p, picture, arg_min(label_key, (d, s)) as label_key, min(d) as d from (
            select a.doc_id, a.ordinal as p, a.picture, l.label_key, abs(l.ordinal - a.ordinal) as d, l.ordinal > a.ordinal as s from bl a join lb l on l.doc_id = a.doc_id and abs(l.ordinal - a.ordinal) <= 8
            where a.picture is not null) group by 1, 2, 3""",
    ),
)
def _(kb: KB) -> DataFrame:
    """Every sixth line stands for a picture, every sixth for a figure label."""
    rows = kb.raw("documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("i", "line")).withColumn("ordinal", F.col("i") + 1)
    named = F.concat(F.lit("见图 "), "ordinal", F.lit(" - "), F.length("line") % 9)
    blocks = rows.select(
        "doc_id", "ordinal", F.when(F.col("ordinal") % 6 == 3, named).otherwise(F.col("line")).alias("text"),
        F.when(F.col("ordinal") % 6 == 1, F.concat(F.lit("p"), "doc_id", F.lit("_"), "ordinal")).alias("picture"),
    )
    asked = kb.resources.select("resource_id", F.concat_ws("-", F.col("ordinal") % 25, F.col("ordinal") % 9).alias("label_key"), "status", "reference_aliases")
    found = E.bind_figures(blocks, asked)
    return found.select("resource_id", "label_key", "file_path", "status", F.array_join("reference_aliases", "|").alias("aliases"), "distance")


# --- evidence ------------------------------------------------------------


@register(
    "aud_01_source_quality",
    """select chunk_id, chapter_id, confidence, word_status, alignment_status, review_status, needs as needs_textbook_anchor_review from (
      select doc_id as chunk_id, lang as chapter_id, coalesce(pc, case when not graded then 'ungraded' else case coalesce(nullif(al, ''), raw)
          when 'exact' then 'high' when 'auto_direct_text_supported' then 'high' when 'partial' then 'medium' when 'concept_supported' then 'medium'
          when 'missing' then 'low' when 'auto_anchor_missing_or_weak' then 'low' else 'ungraded' end end) as confidence, raw as word_status,
        coalesce(nullif(al, ''), 'missing') as alignment_status, case when prof then 'graded' else 'open' end as review_status,
        (prof and doc_id % 9 = 0) or (al = 'missing' and (not prof or raw in ('missing', 'auto_anchor_missing_or_weak'))) as needs
      from (select *, coalesce(case when prof then 'auto_direct_text_supported' end, case when doc_id % 4 = 1 then 'auto_anchor_missing_or_weak' end, nullif(al, ''),
          case when lang in ('en', 'de') then 'missing' else 'ungraded' end) as raw, case when prof and doc_id % 2 = 0 then 'high' end as pc,
          prof or wa or wc or doc_id % 4 = 1 as graded
        from (select *, coalesce(case when wa then ['exact', 'partial', 'missing'][(n_chars % 3 + 1)::int] end, case when wc then 'concept_supported' end, '') as al
          from (select *, doc_id % 3 = 0 as prof, n_chars % 2 = 0 as wa, doc_id % 5 = 0 as wc from documents))))""",
)
def _(kb: KB) -> DataFrame:
    """Profiles, alignments and correspondences of whole documents, each missing for many of them."""
    d = kb.raw("documents")
    key, size = F.col("doc_id"), F.col("n_chars")
    states = F.array(F.lit("exact"), F.lit("partial"), F.lit("missing"))
    profile = F.struct(
        F.lit("auto_direct_text_supported").alias("word_verification"), F.when(key % 2 == 0, "high").otherwise("").alias("evidence_confidence"),
        F.lit("graded").alias("review_status"), (key % 9 == 0).alias("needs_textbook_anchor_review"),
    )
    rows = d.select(
        key.alias("chunk_id"), F.col("lang").alias("chapter_id"), F.when(key % 4 == 1, "auto_anchor_missing_or_weak").alias("word_verification"),
        F.lit("open").alias("review_status"), F.when(key % 3 == 0, profile).alias("profile"),
        F.when(size % 2 == 0, F.struct(F.element_at(states, (size % 3 + 1).cast("int")).alias("status"))).alias("word_alignment"),
        F.when(key % 5 == 0, F.struct(F.lit("concept_supported").alias("status"))).alias("word_correspondence"),
    )
    return E.source_quality(rows, ["en", "de"])


PAIRS = """select item_id, a, b, unnest([a || '与' || b, a, b, a, a, b, b]) as t from (
    select item_id, split_part(text, ' ', 1) as a, split_part(text, ' ', 2) as b from benchmark)"""


@register(
    "aud_10_support",
    sql(
        f"""select answer_id, case when direct then 'direct_word_question_hit' when task or kp then 'teaching_rewrite_supported_by_task_or_kp'
          when cmp then 'teaching_rewrite_supported_by_concept_comparison' else 'word_direct_question_missing' end as support_type, p as profile from (
          select answer_id, ordinal % 11 = 0 as direct, ordinal % 13 = 0 as task, ordinal % 7 = 0 as kp, answer_id in (select answer_id from cmp) as cmp,
            case answer_mode when 'bullet' then 'direct_text_evidence/high' when 'table' then 'partial_text_evidence/medium' when 'step' then 'concept_or_operation_anchor/medium'
              else case when ordinal % 2 = 0 then 'operation_summary_with_term_support/medium' else 'operation_summary_not_verbatim/low' end end as p from cards)""",
        hay=f"select answer_id, {gone('lower(canonical_question)', '')} || '区别 ' || {gone('lower(array_to_string(answer_points, chr(32)))', '')} as h from cards where ordinal % 2 = 0",
        terms=f"select item_id, {gone('lower(t)', '')} as t from ({PAIRS})",
        cmp="""select distinct answer_id from (select answer_id, item_id from hay join terms on length(t) >= 3 and contains(h, t) group by 1, 2 having count(*) >= 2)""",
    ),
)
def _(kb: KB) -> DataFrame:
    """Comparing questions against the first two words of every benchmark passage as the sides of a comparison."""
    even = F.col("ordinal") % 2 == 0
    cards = kb.cards.withColumn("canonical_question", F.concat("canonical_question", F.when(even, "区别").otherwise("")))
    sides = F.split("text", " ")
    pairs = kb.raw("benchmark").select(
        F.col("item_id").alias("comparison_id"), F.concat(sides[0], F.lit("与"), F.coalesce(F.get(sides, F.lit(1)), F.lit(""))).alias("title"), sides[0].alias("object_a"),
        F.coalesce(F.get(sides, F.lit(1)), F.lit("")).alias("object_b"),
    )
    helped = E.supported_by_comparison(cards, pairs).withColumn("_cmp", F.lit(True))
    rows = cards.join(helped, "answer_id", "left")
    key = F.col("ordinal")
    state = F.when(F.col("answer_mode") == "bullet", "exact").when(F.col("answer_mode") == "table", "partial").when(F.col("answer_mode") == "step", "concept_supported").otherwise("missing")
    profile = E.evidence_profile(state, even)
    support = E.answer_support(key % 11 == 0, key % 13 == 0, key % 7 == 0, F.coalesce("_cmp", F.lit(False)))
    return rows.select("answer_id", support.alias("support_type"), F.concat_ws("/", profile["classification"], profile["evidence_confidence"]).alias("profile"))


# --- traces, details, routing --------------------------------------------


@register(
    "ren_04_trace_samples",
    sql(
        f"""select q.question_id, h.hits, f.answer_id, c.answer_mode, md5(case when c.answer_id is null then '教材知识库未找到直接答案。' else {rendered_sql(True)} end) as rendered_answer,
        r.resources from questions q
        left join (select question_id, string_agg(answer_id || ':' || round(score, 3)::varchar || ':' || case when score >= 110 then 'high' when score >= 70 then 'medium' else 'low' end, '|' order by rank) as hits
          from kfive group by 1) h on h.question_id = q.question_id
        left join kfirst f on f.question_id = q.question_id left join cards c on c.answer_id = f.answer_id
        left join (select answer_id, string_agg(x.resource_id || ':' || s.status, '|' order by x.rank) as resources from rectop x join resources s on s.resource_id = x.resource_id where rank <= 3 group by 1) r
          on r.answer_id = f.answer_id""",
        **{**keyword_ctes("questions"), "kfive": DIRECT["kfive"], "kfirst": DIRECT["kfirst"], **REC_CTES},
    ),
)
def _(kb: KB) -> DataFrame:
    """Hits with confidence, the rendered best answer and its resources for every question."""
    cards = kb.cards
    hits = keyword_scores(kb.questions, cards, kb.synonyms, kb.rag, 5)
    top = hits.where("rank = 1").select("question_id", "answer_id").join(cards, "answer_id")
    recommended = R.recommend_resources(top.dropDuplicates(["answer_id"]).select(cards.columns), kb.resources, 3)
    return A.trace_samples(kb.questions, hits, top.withColumn("rendered", rendered(cards)), recommended, kb.resources)


@register(
    "ret_18_task_details",
    sql(
        """select task_id, task_name, coalesce(s.steps, '') as steps, coalesce(e.errors, '') as errors, coalesce(c.answers, '') as answers from tasks
        left join (select task_id, string_agg(step_id || ':' || step_title, '|' order by step_no, step_id) as steps from steps group by 1) s using (task_id)
        left join (select task_id, string_agg(error_id, '|' order by error_id) as errors from (select distinct t.task_id, e.error_id from tasks t join errors e on e.task_id = t.task_id
           union select s.task_id, e.error_id from errors e join steps s on s.step_id = e.related_step) group by 1) e using (task_id)
        left join (select related_task as task_id, string_agg(answer_id, '|' order by answer_id) as answers from cards group by 1) c using (task_id)"""
    ),
)
def _(kb: KB) -> DataFrame:
    from quillstone.operators import operations as O

    return O.task_details(kb.tasks, kb.steps, kb.errors, kb.cards)


@register(
    "joi_21_scene_metadata",
    """select c_custkey, chapter_id, scene_id, scene_title, decision, decision = '' as is_open from (
       select c_custkey, case when c_custkey % 2 = 0 then 'ch10' else 'ch11' end as chapter_id, case when c_acctbal > 3000 then 'approve' else '' end as decision, c_nationkey from customer) c
       left join (select n_nationkey, case when n_nationkey % 2 = 0 then 'ch10' else 'ch11' end as ch, 's' || n_regionkey as scene_id, n_name as scene_title from nation) n
       on n.n_nationkey = c.c_nationkey and n.ch = c.chapter_id""",
)
def _(kb: KB) -> DataFrame:
    parity = lambda c: F.when(F.col(c) % 2 == 0, "ch10").otherwise("ch11")
    items = kb.raw("customer").select("c_custkey", parity("c_custkey").alias("chapter_id"), F.col("c_nationkey").alias("chunk_id"), F.when(F.col("c_acctbal") > 3000, " approve ").alias("decision"))
    scenes = kb.raw("nation").select(parity("n_nationkey").alias("chapter_id"), F.col("n_nationkey").alias("chunk_id"), F.concat(F.lit("s"), "n_regionkey").alias("scene_id"), F.col("n_name").alias("scene_title"))
    return V.with_scenes(items, scenes).select("c_custkey", "chapter_id", "scene_id", "scene_title", "decision", "is_open")


@register(
    "aud_13_routing_validation",
    sql(
        f"""select q.question_id, q.preferred, o.owner as expected, coalesce(d.resolved, case when sw then bc else q.preferred end) as resolved,
        coalesce(d.resolved, case when sw then bc else q.preferred end) = o.owner as passed
        from (select r.*, b.bc, b.bs, coalesce(c.score, 0) as ps,
                coalesce(bc <> preferred and (bs >= 110 and bs - coalesce(c.score, 0) >= 35 or bs >= 70 and bs - coalesce(c.score, 0) >= 45), false) as sw
              from rreq r left join bs b using (question_id) left join cs c on c.question_id = r.question_id and c.chapter_id = r.preferred) q
        join own o on o.question_id = q.question_id left join dr d on d.question_id = q.question_id and d.preferred = q.preferred""",
        **{
            **keyword_ctes("questions"), **RES_CTES, **ROUTE_CTES, "questions": ASKED,
            "own": f"""select question_id, any_value(chapter_id) as owner from questions join cards on {norm('question')} = {norm('canonical_question')} and {norm('question')} <> ''
                group by 1 having count(*) = 1""",
        },
    ),
)
def _(kb: KB) -> DataFrame:
    """Questions that one card alone asks must lead to that card's chapter from wherever they are asked."""
    return A.validate_routing(routed(kb, kb.asked), kb.asked, kb.cards)


@register(
    "joi_16_media_intake",
    sql(
        """select s.step_id, coalesce(nullif(t.section_id, ''), v.chapter_id, '') as section_id, coalesce(nullif(t.software, ''), v.resource_type, '') as software,
        s.task_id, coalesce(t.task_name, '') as task_name, coalesce(v.video_id, 'ch06_vid_unassigned') as video_id, coalesce(trim(v.title), '') as video_title, s.seg as segment_id,
        coalesce(nullif(g.title, ''), trim(s.step_title)) as segment_title, s.shot as screenshot_id, coalesce(nullif(trim(h.title), ''), trim(s.step_title)) as screenshot_title,
        coalesce(h.file_path, 'chapter_06/screenshots/' || s.shot || '.png') as screenshot_path
        from (select *, 'seg' || substr(task_id, 2) as seg, 'shot' || (step_no * 7 + substr(task_id, 2)::int) as shot from steps) s
        left join (select task_id, trim(task_name) as task_name, case when ordinal % 2 = 0 then 'sec' || ordinal else '' end as section_id, case when ordinal % 3 = 0 then 'tool' else '' end as software
          from tasks where ordinal % 5 <> 0) t on t.task_id = s.task_id
        left join (select 'seg' || ordinal as segment_id, 'v' || (ordinal % 50) as video_id, case when ordinal % 4 = 0 then '' else 'part ' || ordinal end as title from tasks where ordinal % 2 = 0) g on g.segment_id = s.seg
        left join (select *, 'v' || ordinal as video_id from resources where ordinal % 7 <> 0) v on v.video_id = g.video_id
        left join (select *, 'shot' || ordinal as shot from resources where ordinal % 3 <> 0) h on h.shot = s.shot"""
    ),
)
def _(kb: KB) -> DataFrame:
    """Steps of conversations with tasks, segments, videos and screenshots of which some are missing."""
    from quillstone.operators import operations as O

    n, p = F.col("ordinal"), kb.resources
    conversation = F.expr("substring(task_id, 2)")
    steps = kb.steps.withColumns({"video_segment_id": F.concat(F.lit("seg"), conversation), "screenshot_id": F.concat(F.lit("shot"), F.col("step_no") * 7 + conversation.cast("int"))})
    tasks = kb.tasks.where(n % 5 != 0).select(
        "ordinal", "task_id", "task_name", F.when(n % 2 == 0, F.concat(F.lit("sec"), n)).otherwise("").alias("section_id"), F.when(n % 3 == 0, "tool").otherwise("").alias("software")
    )
    segments = kb.tasks.where(n % 2 == 0).select(
        "ordinal", F.concat(F.lit("seg"), n).alias("segment_id"), F.concat(F.lit("v"), n % 50).alias("video_id"),
        F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("part "), n)).alias("segment_title"),
    )
    videos = p.where(n % 7 != 0).select("ordinal", F.concat(F.lit("v"), n).alias("video_id"), "title", F.col("chapter_id").alias("section_id"), F.col("resource_type").alias("software"))
    shots = p.where(n % 3 != 0).select("ordinal", F.concat(F.lit("shot"), n).alias("screenshot_id"), "title", "file_path")
    return O.media_intake(steps, tasks, segments, videos, shots, "ch06")
