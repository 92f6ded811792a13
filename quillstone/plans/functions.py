"""Registered queries: text, number, list and predicate functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import similarity, support, text as T
from quillstone.functions import values as V
from quillstone.operators import relations as R
from quillstone.operators.align import dealt
from quillstone.plans.kb import KB, compact, lines, norm, sql, toks
from quillstone.plans.registry import register

SP = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{3000}"


def over(name: str, build, sql_value: str, table: str = "documents", key: str = "doc_id", column: str = "text") -> None:
    """Register one function of one text column."""

    @register(name, f"select {key}, {sql_value.replace("{x}", column)} as result from {table}")
    def _(kb: KB) -> DataFrame:
        return kb.raw(table).select(key, build(F.col(column)).alias("result"))


def digest(build):
    return lambda c: F.md5(build(c))


def joined(build):
    return lambda c: F.array_join(build(c), "␟")


def cls(characters: str) -> str:
    return "".join("\\" + c if c in r"[]\^-" else "''" if c == "'" else c for c in characters)


def gone(x: str, characters: str) -> str:
    return f"regexp_replace({x}, '[{SP}{cls(characters)}]+', '', 'g')"


#: Frequent words of the sample texts and the phrase that stands for each, so that rules for such phrases meet whole texts.
HAN = (
    (" the ", "的"), (" of ", "流程"), (" und ", "示意"), (" de ", "图"), (" and ", "请简要说明"), (" la ", "是什么"), (" der ", "有哪些要点"),
    (" is ", "包括哪些"), (" que ", "。。。"), (" in ", "，，"), (" es ", "；；"), (" on ", "．．"), (" die ", "缓和曲线"),
)


def han(text):
    """A text in which frequent words stand as phrases."""
    for word, phrase in HAN:
        text = F.replace(text, F.lit(word), F.lit(phrase))
    return text


def without(x: str, *phrases: str, by: str = "") -> str:
    """SQL: ``x`` with every phrase replaced, one after the other."""
    for phrase in phrases:
        x = f"replace({x}, '{phrase}', '{by}')"
    return x


def han_sql(x: str) -> str:
    for word, phrase in HAN:
        x = without(x, word, by=phrase)
    return x


over("txt_01_normalize", digest(T.normalize), f"md5({norm('{x}')})")
over("txt_02_compact", digest(T.compact_text), f"md5({compact('{x}')})")
over("txt_03a_compact_spaces", digest(T.compact_spaces), f"md5(lower({gone('{x}', '')}))")
over("txt_03b_compact_enrich", digest(T.compact_enrich), f"md5(lower({gone('{x}', V.ENRICH_PUNCTUATION)}))")
over("txt_03c_compact_mapping", digest(T.compact_mapping), f"md5(lower({gone('{x}', V.MAPPING_PUNCTUATION)}))")
over("txt_03d_compact_verify", digest(T.compact_verify), f"md5({gone('{x}', V.VERIFY_PUNCTUATION)})")
over("txt_03e_question_key", digest(T.bank_key), f"md5({gone('lower({x})', V.BANK_PUNCTUATION)})")
over(
    "txt_04_semantic_compact", lambda c: F.md5(T.semantic_compact(han(c))),
    f"md5({without(f'lower({gone(han_sql("{x}"), V.ENRICH_PUNCTUATION)})', *V.SEMANTIC_NOISE)})",
)
over(
    "txt_05_tokens",
    lambda c: F.md5(F.array_join(F.array_sort(T.tokens(han(c))), " ")),
    f"""(select md5(array_to_string(list_sort(list_distinct(list_concat({toks('h')}, flatten([case when length(r) = 1 then [r] else list_concat(
        [substr(r, i, 2) for i in range(1, length(r))], [substr(r, i, 3) for i in range(1, length(r) - 1)], [substr(r, i, 4) for i in range(1, length(r) - 2)],
        case when length(r) <= 10 then [r] else [] end) end for r in regexp_extract_all(h, '[\\x{{{{4e00}}}}-\\x{{{{9fff}}}}]+')])))), ' ')) from (select {han_sql('{x}')} as h))""".replace("{{", "{").replace("}}", "}"),
)
@register(
    "txt_06_ngrams",
    f"""select conv_id, turn, case when length(n) = 0 then 0 when length(n) <= 3 then 1
        else len(list_distinct([n[i:i+2] for i in range(1, length(n) - 1)])) end as result
        from (select conv_id, turn, {norm('text')} as n from conversations)""",
)
def _(kb: KB) -> DataFrame:
    return kb.raw("conversations").select("conv_id", "turn", F.size(T.ngrams(T.normalize("text"), 3)).alias("result"))


@register(
    "txt_07_list_text",
    sql(
        "select answer_id, md5(array_to_string(answer_points, ' ') || ' ' || array_to_string(must_include, ' ')) as result from cards"
    ),
)
def _(kb: KB) -> DataFrame:
    points, must = T.list_text(F.col("answer_points")), T.list_text(F.col("must_include"))
    return kb.cards.select("answer_id", F.md5(F.concat(points, F.lit(" "), must)).alias("result"))


over(
    "txt_08_numeric_value", lambda c: T.numeric_value(c, 1.0),
    r"coalesce(try_cast(nullif(regexp_extract({x}, '-?\d+(?:\.\d+)?'), '') as double), 1.0)",
)
over(
    "txt_09_priority_value", lambda c: T.priority_value(c),
    "case when contains(lower({x}), 'highest') or contains(lower({x}), 'p1') or contains(lower({x}), 'high') "
    "or starts_with(lower({x}), '1_') then 100 when contains(lower({x}), 'medium') or contains(lower({x}), 'p2') then 70 "
    "when contains(lower({x}), 'low') or contains(lower({x}), 'p3') then 40 else 50 end",
    "orders", "o_orderkey", "o_orderpriority",
)
over("txt_10_intent_core", lambda c: F.md5(T.intent_core(T.normalize(han(c)))), f"md5({without(norm(han_sql('{x}')), *V.FILLER_PHRASES)})")

PHRASE = r"""(select case when qc = '' or pc = '' then false else
  (strpos(qc, pc) > 0 and not (regexp_matches(pc, '\p{N}$') and regexp_matches(substr(qc, strpos(qc, pc) + length(pc), 1), '^\p{N}$')))
  or (strpos(pc, qc) > 0 and not (regexp_matches(qc, '\p{N}$') and regexp_matches(substr(pc, strpos(pc, qc) + length(qc), 1), '^\p{N}$'))) end)"""


@register(
    "txt_11_compact_contains",
    f"""select doc_id, strpos(h, n) > 0 and not (regexp_matches(n, '\\d$')
          and regexp_matches(substr(h, strpos(h, n) + length(n), 1), '^\\d$')) as result
        from (select doc_id, {compact('text')} as h, {compact("split_part(text, ' ', 3)")} as n from documents)""",
)
def _(kb: KB) -> DataFrame:
    word = F.coalesce(F.get(F.split("text", " "), F.lit(2)), F.lit(""))
    return kb.raw("documents").select(
        "doc_id", T.compact_contains(T.compact_text("text"), T.compact_text(word)).alias("result")
    )


@register(
    "txt_12_phrase_matches",
    sql(
        f"""select answer_id, place, {PHRASE} as result from (select answer_id, place, {compact('canonical_question')} as qc, {compact('p')} as pc
        from (select answer_id, canonical_question, unnest(answer_points) as p, generate_subscripts(answer_points, 1) as place from cards))"""
    ),
)
def _(kb: KB) -> DataFrame:
    """The question of a card against each of its points."""
    rows = kb.cards.select("answer_id", "canonical_question", F.posexplode("answer_points").alias("place", "p"))
    return rows.select("answer_id", (F.col("place") + 1).alias("place"), T.phrase_matches(F.col("canonical_question"), F.col("p")).alias("result"))


@register(
    "txt_13_label_references",
    """select page_id, case when page_id % 3 = 2 then null else (page_id % 7 + 1) || '-' || (length(html) % 30) end as result from pages""",
)
def _(kb: KB) -> DataFrame:
    """Figure numbers of ids in both spellings, and none in an id of another kind."""
    from quillstone.operators.resources import label_numbers

    key, size = F.col("page_id"), F.length("html")
    first, second = (key % 7 + 1).cast("string"), (size % 30).cast("string")
    named = (
        F.when(key % 3 == 0, F.concat(F.lit("ch05_fig_"), first, F.lit("_"), second))
        .when(key % 3 == 1, F.concat(F.lit("fig-"), first, F.lit("-"), second))
        .otherwise(F.concat(F.lit("ch05_table_"), first, F.lit("_"), second))
    )
    return kb.raw("pages").select("page_id", label_numbers(named, "fig").alias("result"))


COVERAGE = f"""case when len(pts) = 0 then 1.0 else len([p for p in pts if p <> '' and (contains(ans, p) or
   case when length(p) <= 4 then contains(ans, p) else len({toks('p')}) > 0 and
     len(list_intersect({toks('p')}, {toks('ans')})) / greatest(len({toks('p')}), 1) >= 0.65 end)]) / len(pts) end"""


@register(
    "txt_14_coverage",
    sql(
        f"""select answer_id, round({COVERAGE}, 6) as result from (select answer_id,
        {norm("canonical_question || array_to_string([answer_points[i] for i in range(1, len(answer_points) + 1) if i % 2 = 1], ' ')")} as ans,
        [{norm('p')} for p in answer_points] as pts from cards)"""
    ),
)
def _(kb: KB) -> DataFrame:
    """Coverage of all points by an answer made of the question and every other point (TXT-15 inside)."""
    return kb.cards.select("answer_id", F.round(T.coverage(F.col("answer_points"), half_answer()), 6).alias("result"))


def half_answer():
    return F.concat("canonical_question", T.list_text(F.filter("answer_points", lambda p, i: i % 2 == 0)))


@register(
    "txt_16_missing_points",
    sql(
        """select answer_id, md5(array_to_string([p for p in list_concat(answer_points, must_include) if p <> ''
        and not contains(canonical_question || array_to_string([answer_points[i] for i in range(1, len(answer_points) + 1) if i % 2 = 1], ' '), p)], '|')) as result from cards"""
    ),
)
def _(kb: KB) -> DataFrame:
    points = F.concat("answer_points", "must_include")
    return kb.cards.select("answer_id", F.md5(F.array_join(T.missing_points(points, half_answer()), "|")).alias("result"))


@register("txt_17_text_similarity")
def _(kb: KB) -> DataFrame:
    """The question against every pattern and point of its card; the sequence ratio has no SQL form."""
    others = F.concat("student_question_patterns", "answer_points")
    cards = kb.cards.select("answer_id", T.compact_boundary(F.col("canonical_question")).alias("_left"), others.alias("_others"))
    rows = dealt(cards.select("answer_id", "_left", F.posexplode("_others").alias("place", "other")), "answer_id", "_left")
    texts = rows.select("answer_id", "place", "_left", T.compact_boundary(F.col("other")).alias("_right"))
    return texts.select("answer_id", "place", F.round(similarity.text_similarity(F.col("_left"), F.col("_right")), 6).alias("result"))


GRAM2 = "list_distinct([{0}[i:i+1] for i in range(1, length({0}))])"


@register(
    "txt_18_bigram_ratio",
    sql(
        f"""select answer_id, case when length(a) < 4 or length(b) < 4 then 0.0 else
        round(len(list_intersect({GRAM2.format('a')}, {GRAM2.format('b')})) / len({GRAM2.format('a')}), 6) end as result
        from (select answer_id, lower({gone('canonical_question', V.ENRICH_PUNCTUATION)}) as a,
              lower({gone("array_to_string(answer_points, ' ')", V.ENRICH_PUNCTUATION)}) as b from cards)"""
    ),
)
def _(kb: KB) -> DataFrame:
    ratio = T.bigram_ratio(T.compact_enrich("canonical_question"), T.compact_enrich(T.list_text(F.col("answer_points"))))
    return kb.cards.select("answer_id", F.round(ratio, 6).alias("result"))


TERMS_SQL = f"""select conv_id, turn, coalesce(string_agg(t, ' ' order by i) filter (r <= 20), '') as result from (
  select conv_id, turn, t, i, row_number() over (partition by conv_id, turn order by i) as r from (
    select conv_id, turn, k, arg_min(t, i) as t, min(i) as i from (
      select conv_id, turn, t, i, lower({gone('t', V.BOUNDARY_PUNCTUATION)}) as k from (
        select conv_id, turn, unnest(ts) as t, generate_subscripts(ts, 1) as i from (
          select conv_id, turn, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_+.#/-]{{1,32}}') as ts from conversations)))
    where length(k) >= 2 group by 1, 2, 3)) group by 1, 2
  union all select conv_id, turn, '' from conversations where len([w for w in regexp_extract_all(text,
    '[A-Za-z][A-Za-z0-9_+.#/-]{{1,32}}') if length({gone('w', V.BOUNDARY_PUNCTUATION)}) >= 2]) = 0"""


@register(
    "txt_19_excerpt_window",
    f"""select item_id, doc_id from (select item_id, {gone('lower(text)', '')} as s from benchmark) b
        join (select doc_id, {gone('lower(text)', '')} as d from documents) on length(s) >= 20
        and (contains(d, left(s, 40)) or contains(d, right(s, 40)))""",
)
def _(kb: KB) -> DataFrame:
    """Which documents hold the head or the tail of a passage, as two anchored substring joins."""
    from quillstone.operators.align import excerpt_hits

    return excerpt_hits(
        kb.raw("benchmark").select("item_id", T.compact_spaces("text").alias("sample")),
        kb.raw("documents").select("doc_id", T.compact_spaces("text").alias("document")),
    )


#: SQL: all lines of a text but one.
OTHER_LINES = "array_to_string([x[1] for x in list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1)) if x[2] <> {0}], '')"


SUPPORT = f"""case when e = '' then 'empty' when contains(w, e) then 'exact'
        when length(e) >= 16 and contains(w, left(e, 40)) then 'partial'
        when length(e) >= 20 and len([k for k in range(0, length(e) - 19, 10) if contains(w, substr(e, k + 1, 20))]) > 0 then 'partial'
        when length(e) >= 8 and len([k for k in range(0, length(e) - 7, 8) if contains(w, substr(e, k + 1, 8))]) >= 2
        then 'concept_supported' else 'unverified' end"""
#: SQL: every line of every document (e) with all its other lines (w).
SUPPORTED_LINES = f"""select doc_id, lang, i, {gone("string_split(text, chr(10))[i]", V.VERIFY_PUNCTUATION)} as e, {gone(OTHER_LINES.format("i"), V.VERIFY_PUNCTUATION)} as w
        from (select *, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)"""


@register("txt_20_verification_status", f"select doc_id, i as line, {SUPPORT} as result from ({SUPPORTED_LINES})")
def _(kb: KB) -> DataFrame:
    """Is a line of a document supported by all its other lines?  Every line of every document."""
    return line_support(kb.raw("documents")).select("doc_id", "line", "result")


def line_support(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, line, result) of every line, from 1."""
    parts = F.transform(F.split("text", "\n"), T.compact_verify)  # compacting drops characters, so a text's lines compact are the compact text
    rows = docs.repartition("doc_id").select("doc_id", "lang", support.lines_status(parts).alias("_results"))
    return rows.select("doc_id", "lang", F.posexplode("_results").alias("_place", "result")).select("doc_id", "lang", (F.col("_place") + 1).cast("long").alias("line"), "result")


@register("txt_21_terms", TERMS_SQL)
def _(kb: KB) -> DataFrame:
    """First twenty distinct terms of every user turn and reply."""
    return kb.raw("conversations").select(
        "conv_id", "turn", F.array_join(T.terms(F.array("text"), 20), " ").alias("result")
    )


over(
    "txt_22_heading_variants",
    lambda c: F.md5(F.array_join(F.flatten(F.transform(F.split(c, "\n"), T.heading_variants)), "|")),
    r"(select md5(string_agg(case when b <> '' and b <> t then t || '|' || b else t end, '|' order by i)) from (select t, i, regexp_replace(t, '^\s*\d+[、.．]\s*', '') as b "
    r"from (select unnest(string_split({x}, chr(10))) as t, unnest(range(1, len(string_split({x}, chr(10))) + 1)) as i)))",
)
over(
    "txt_23_strip_markup", lambda c: F.md5(T.strip_markup(c, "-")),
    f"md5(coalesce(nullif(trim(regexp_replace(regexp_replace({{x}}, '<[^>]*>', ' ', 'g'), '[{SP}]+', ' ', 'g')), ''), '-'))",
    "pages", "page_id", "html",
)
over(
    "txt_24_collapse_punctuation", lambda c: F.md5(T.collapse_punctuation(han(c))),
    "md5(" + "regexp_replace(" * 3 + without(han_sql("{x}"), "．．", by="。") + "".join(f", '{m}{{2,}}', '{m}', 'g')" for m in "。，；") + ")",
)
FORMULA = r"""length(b) > 0 and length(b) <= 220 and (len(regexp_extract_all(b, '[=+\-*/×÷√∑ΣπΠ≤≥<>]')) >= 1 or
    len(regexp_extract_all(b, '[A-Za-zα-ωΑ-Ω0-9]')) >= 4)"""


def formula_text(line, place):
    """A line as it stands, as a bare label with its first letters, inside prose, or as a labelled equation."""
    label = F.concat(F.lit("（"), place, F.lit(" - 12）"))
    return (
        F.when(place % 4 == 0, line).when(place % 4 == 1, F.concat(label, F.left(line, F.lit(3))))
        .when(place % 4 == 2, F.concat(F.lit("其中"), line)).otherwise(F.concat(F.lit("y = "), F.left(line, F.lit(20)), label))
    )


@register(
    "txt_25_formula_test",
    sql(
        f"""select doc_id, i as ordinal, formula, formula and not (contains(t, '则') or contains(t, '其中')) as expression from (select doc_id, i, t, {FORMULA} as formula
        from (select *, regexp_replace(replace(t, ' ', ''), '[（(]\\s*\\d+\\s*[-－]\\s*\\d+\\s*[）)]', '', 'g') as b from (
          select doc_id, i, case i % 4 when 0 then x when 1 then '（' || i || ' - 12）' || left(x, 3) when 2 then '其中' || x
            else 'y = ' || left(x, 20) || '（' || i || ' - 12）' end as t
          from (select doc_id, unnest(ls) as x, generate_subscripts(ls, 1) as i from doc_lines))))"""
    ),
)
def _(kb: KB) -> DataFrame:
    rows = kb.raw("documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("ordinal", "line")).withColumn("ordinal", F.col("ordinal") + 1)
    text = formula_text(F.col("line"), F.col("ordinal"))
    return rows.select("doc_id", "ordinal", T.looks_like_formula(text).alias("formula"), T.formula_expression(text).alias("expression"))


def natural(x: str) -> str:
    """SQL of the natural key."""
    bare = "case when ltrim(p, '0') = '' then '0' else ltrim(p, '0') end"
    return (
        rf"array_to_string([case when regexp_matches(p, '^\d') then lpad(length({bare})::varchar, 10, '0') || {bare} else p end "
        rf"for p in regexp_extract_all({x}, '\d+|\D+')], '')"
    )


over("txt_26_natural_key", T.natural_key, natural("{x}"), "pages", "page_id", "url")
ANSWER_LINE = "教材依据：", "Source_Chunks作为依据"


@register(
    "ren_05_student_text",
    sql(
        """select answer_id, md5(regexp_replace(array_to_string([x for x in xs if not starts_with(trim(x), '教材依据：') and not contains(x, 'Source_Chunks作为依据')], chr(10)),
          '^\\s+|\\s+$', '', 'g')) as result
        from (select answer_id, list_concat([canonical_question, ' 教材依据：' || section_id], answer_points, ['以Source_Chunks作为依据。', '']) as xs from cards)"""
    ),
)
def _(kb: KB) -> DataFrame:
    evidence = F.concat(F.lit(" " + ANSWER_LINE[0]), "section_id")
    parts = F.concat(F.array("canonical_question", evidence), "answer_points", F.array(F.lit(f"以{ANSWER_LINE[1]}。"), F.lit("")))
    return kb.cards.select("answer_id", F.md5(R.student_visible(F.array_join(parts, "\n"))).alias("result"))


WRAPPED = "case item_id % 5 when 0 then '什么是' || {x} when 1 then {x} || '是什么' when 2 then '如何理解' || {x} || '什么意思？' when 3 then '何为？' else {x} end"


@register(
    "txt_27_routing_key",
    f"""select item_id, case when k = '' then n else k end as result from (select item_id, n, regexp_replace(regexp_replace(n, '^(?:什么是|何为|如何理解)', ''), '(?:是什么|什么意思)$', '') as k
        from (select item_id, {norm(WRAPPED.replace('{x}', 'text'))} as n from benchmark))""",
)
def _(kb: KB) -> DataFrame:
    kind, text = F.col("item_id") % 5, F.col("text")
    asked = (
        F.when(kind == 0, F.concat(F.lit("什么是"), text)).when(kind == 1, F.concat(text, F.lit("是什么")))
        .when(kind == 2, F.concat(F.lit("如何理解"), text, F.lit("什么意思？"))).when(kind == 3, F.lit("何为？")).otherwise(text)
    )
    return kb.raw("benchmark").select("item_id", T.routing_key(asked).alias("result"))


over(
    "txt_27_clean_question", lambda c: T.clean_question(F.concat(F.lit(" 请简要说明： "), c, F.lit("请查看"))), "trim({x})", "benchmark", "item_id",
)
over(
    "txt_28_hashes", lambda c: F.concat(T.surrogate_id("id_", c), F.lit(":"), F.sha2(c, 256)),
    "'id_' || substr(sha1({x}), 1, 10) || ':' || sha256({x})",
)
over("txt_29_sql_literal", digest(T.sql_literal), "md5('''' || replace({x}, '''', '''''') || '''')")


@register(
    "txt_30_format_check",
    sql(
        """select answer_id, case answer_mode when 'table' then contains(source_excerpt, '|') and contains(source_excerpt, '---')
        when 'step' then contains(source_excerpt, '1.') or contains(source_excerpt, '步骤')
        when 'bullet' then contains(source_excerpt, '1.') else trim(source_excerpt) <> '' end as result from cards"""
    ),
)
def _(kb: KB) -> DataFrame:
    return kb.cards.select("answer_id", T.format_ok(F.col("answer_mode"), F.col("source_excerpt")).alias("result"))


for letter, pattern, build in (
    ("a", "[;；]", lambda c: F.size(T.split_a(c))),
    ("b", "[；;\n|]", lambda c: F.size(T.split_b(c))),
    ("c", "[;；,，\n]", lambda c: F.size(T.split_c(c))),
    ("d", "[;；|,，\n]", lambda c: F.size(T.split_d(c))),
):
    parts = f"[trim(p) for p in regexp_split_to_array({{x}}, '{pattern}') if trim(p) <> '']"
    over(f"list_split_{letter}", build, f"len(list_distinct({parts}))" if letter == "b" else f"len({parts})")


@register(
    "ret_03_confidence",
    "select o_orderkey, case when o_totalprice / 1000 >= 110 then 'high' when o_totalprice / 1000 >= 70 then 'medium' else 'low' end as result from orders",
)
def _(kb: KB) -> DataFrame:
    return kb.raw("orders").select("o_orderkey", T.confidence(F.col("o_totalprice") / 1000).alias("result"))


over(
    "flt_08_placeholder_status", T.placeholder_status,
    "trim(lower({x})) = '' or starts_with(trim(lower({x})), 'needs_') or contains(lower({x}), 'placeholder') or contains({x}, '待')",
    "events", "event_id", "event_type",
)


@register(
    "flt_10_boolean_coercion",
    "select doc_id, cast(quality as varchar) in ('1','true','yes','on') as result from labels",
)
def _(kb: KB) -> DataFrame:
    return kb.raw("labels").select("doc_id", T.truthy("quality").alias("result"))
