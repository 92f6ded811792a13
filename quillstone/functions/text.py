"""Text functions as Spark column expressions (TXT-01 .. TXT-30).

Everything stays inside the JVM.  ``(?U)`` makes Java regex classes Unicode
aware, so that for example the ideographic space counts as whitespace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import sqltext as S
from quillstone.functions import values as V

def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _drop(text: Column, characters: str) -> Column:
    """Delete whitespace and ``characters``; a character map is several times faster than a regex."""
    return F.translate(text, S.SPACES + characters, "")


def text_or_empty(value: Column | str) -> Column:
    return F.coalesce(as_col(value).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


# --- normalisation -------------------------------------------------------

def normalize(text: Column | str) -> Column:
    """TXT-01: lower case, no whitespace, no punctuation."""
    if isinstance(text, str):
        return F.expr(S.normalize(text))
    return _drop(F.lower(text_or_empty(text)), V.QUESTION_PUNCTUATION)


def compact_text(text: Column | str) -> Column:
    """TXT-02: lower case letters and digits of any script."""
    return F.regexp_replace(F.lower(text_or_empty(text)), r"(?U)[\W_]+", "")


def compact_spaces(text: Column | str) -> Column:
    """TXT-03a: lower case without whitespace."""
    return F.lower(_drop(text_or_empty(text), ""))


def compact_enrich(text: Column | str) -> Column:
    """TXT-03b: lower case without whitespace and the enrichment punctuation."""
    return F.lower(_drop(text_or_empty(text), V.ENRICH_PUNCTUATION))


def compact_boundary(text: Column | str) -> Column:
    return F.lower(_drop(text_or_empty(text), V.BOUNDARY_PUNCTUATION))


def compact_mapping(text: Column | str) -> Column:
    """TXT-03c."""
    return F.lower(_drop(text_or_empty(text), V.MAPPING_PUNCTUATION))


def compact_verify(text: Column | str) -> Column:
    """TXT-03d: case is kept."""
    return _drop(text_or_empty(text), V.VERIFY_PUNCTUATION)


def semantic_compact(text: Column | str) -> Column:
    """TXT-04: TXT-03b without noise words."""
    return _strip_all(compact_enrich(text), V.SEMANTIC_NOISE)


def _strip_all(text: Column, phrases: Iterable[str]) -> Column:
    for phrase in phrases:
        text = F.replace(text, F.lit(phrase), F.lit(""))
    return text


def intent_core(normalized: Column) -> Column:
    """TXT-10: a normalised question without its filler phrases."""
    return _strip_all(normalized, V.FILLER_PHRASES)


def collapse_spaces(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(text), r"(?U)[\s\x{1c}-\x{1f}]+", " "))


# --- tokens and grams ----------------------------------------------------

BLOCK = S.BLOCK


def _cuts(text: Column, size: int | Column, step: int) -> Column:
    """Substrings of ``size`` characters at every ``step``.

    A substring of a UTF-8 text is found by walking from its start, so a long
    text is first cut into overlapping blocks; the work stays linear.
    """
    size = F.lit(size) if isinstance(size, int) else size
    stride = BLOCK - BLOCK % step

    def pieces(block: Column) -> Column:
        last = F.least(F.length(block) - size, F.lit(stride - 1))
        return F.when(
            last >= 0,
            F.transform(
                F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)),
                lambda start: F.substring(block, start + 1, size),
            ),
        ).otherwise(F.array().cast("array<string>"))

    def blocks(whole: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(whole) - 1, F.lit(0)), F.lit(stride))
        return F.when(F.length(whole) <= BLOCK, pieces(whole)).otherwise(
            F.flatten(F.transform(F.transform(starts, lambda s: F.substring(whole, s + 1, size + (stride - 1))), pieces))
        )

    return F.when(F.length(text) < size, F.array().cast("array<string>")).otherwise(let(text, blocks))


def grams(text: Column | str, size: int) -> Column:
    """Every substring of ``size`` characters; none when the text is shorter."""
    if isinstance(text, str):
        return F.expr(S.cuts(text, size))
    return _cuts(text, size, 1)


def ngrams(text: Column, size: int) -> Column:
    """TXT-06: set of k-grams; the whole text when it is not longer than k."""
    return (
        F.when(F.length(text) == 0, F.array().cast("array<string>"))
        .when(F.length(text) <= size, F.array(text))
        .otherwise(F.array_distinct(grams(text, size)))
    )


def tokens(text: Column | str) -> Column:
    """TXT-05: Latin words of two or more characters and CJK grams of 2..4."""
    if isinstance(text, str):
        return F.expr(S.tokens(text))
    text = text_or_empty(text)
    words = F.filter(
        F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9+#_.-]+"), F.lit(0)),
        lambda w: F.length(w) >= 2,
    )
    runs = F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}]+"), F.lit(0))
    pieces = F.flatten(
        F.transform(
            runs,
            lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(
                F.concat(
                    grams(run, 2),
                    grams(run, 3),
                    grams(run, 4),
                    F.when(F.length(run) <= 10, F.array(run)).otherwise(F.array().cast("array<string>")),
                )
            ),
        )
    )
    return F.array_distinct(F.concat(words, pieces))


def terms(
    values: Column, limit: int | None, letters: str = "A-Za-z0-9_+.#/-", key: Callable = compact_boundary, stop: tuple[str, ...] = V.GENERIC_TERMS,
    longest: int | None = 32,
) -> Column:
    """TXT-21: the first ``limit`` (all if None) distinct Latin words or CJK runs of an array of texts."""
    found = F.flatten(
        F.transform(
            values,
            lambda v: F.regexp_extract_all(
                F.coalesce(v, F.lit("")),
                F.lit(f"[A-Za-z][{letters}]{{1,{longest or ''}}}" + r"|[\x{4e00}-\x{9fff}]{2,12}"),
                F.lit(0),
            ),
        )
    )
    kept = F.filter(found, lambda t: (F.length(key(t)) >= 2) & ~t.isin(*stop))
    # the first spelling of every key: sort by key and place, keep where the key changes, sort by place again
    keyed = F.array_sort(F.transform(kept, lambda t, i: F.struct(key(t).alias("k"), i.alias("i"), t.alias("t"))))
    firsts = F.transform(
        F.array(keyed), lambda s: F.filter(s, lambda x, i: (i == 0) | (x["k"] != F.get(s, F.greatest(i - 1, F.lit(0)))["k"]))
    )[0]
    ordered = F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"))))
    found = F.transform(ordered, lambda x: x["t"])
    return found if limit is None else F.slice(found, 1, limit)


def mapping_terms(values: Column) -> Column:
    """TXT-21, the variant of the line mapping: 18 terms, its own letters, spelling key and stop list."""
    return terms(values, 18, "A-Za-z0-9+*.-", compact_mapping, V.MAPPING_STOP_TERMS, None)


def heading_terms(text: Column) -> Column:
    """The words of a heading or its target as written, without the headings' own stop words."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9_+.#/-]{1,32}|[\x{4e00}-\x{9fff}]{2,12}"), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in V.HEADING_STOP_TERMS]))


def list_text(values: Column) -> Column:
    """TXT-07 for an array of strings."""
    return F.array_join(F.coalesce(values, F.array().cast("array<string>")), " ")


# --- numbers and small parsers -------------------------------------------

def numeric_value(value: Column | str, default: float = 0.0) -> Column:
    """TXT-08: the first signed number of a text."""
    found = F.regexp_extract(text_or_empty(value), r"-?\d+(?:\.\d+)?", 0)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(default))


def priority_value(value: Column | str) -> Column:
    """TXT-09."""
    text = F.lower(text_or_empty(value))
    return (
        F.when(any_word(text, ("highest", "p1", "high")) | text.startswith("1_"), 100)
        .when(any_word(text, ("medium", "p2")), 70)
        .when(any_word(text, ("low", "p3")), 40)
        .otherwise(50)
    )


def compact_contains(haystack: Column, needle: Column) -> Column:
    """TXT-11: the first occurrence must not cut a number in two."""
    at = F.position(needle, haystack)
    following = F.substring(haystack, at + F.length(needle), F.lit(1))
    cut = needle.rlike(r"(?U)\d$") & following.rlike(r"(?U)^\d$")
    return (at > 0) & ~cut


def phrase_matches(question: Column, phrase: Column) -> Column:
    """TXT-12: one compact text lies in the other."""
    q, p = compact_text(question), compact_text(phrase)
    return (F.length(q) > 0) & (F.length(p) > 0) & (compact_contains(q, p) | compact_contains(p, q))


# --- point coverage ------------------------------------------------------

def soft_contains(point: Column, answer: Column) -> Column:
    """TXT-15 on normalised texts."""
    def shared(wanted: Column) -> Column:
        found = F.size(F.array_intersect(wanted, tokens(answer)))
        return (F.size(wanted) > 0) & (found / F.greatest(F.size(wanted), F.lit(1)) >= 0.65)

    return F.when(F.length(point) <= 4, F.contains(answer, point)).otherwise(let(tokens(point), shared))


def coverage(points: Column, answer: Column) -> Column:
    """TXT-14: share of expected points found in the answer; 1.0 when none is expected."""
    points = F.transform(F.coalesce(points, F.array().cast("array<string>")), lambda p: normalize(p))

    def share(given: Column) -> Column:
        hit = F.filter(points, lambda p: (F.length(p) > 0) & (F.contains(given, p) | soft_contains(p, given)))
        return F.size(hit) / F.size(points)

    return F.when(F.size(points) == 0, F.lit(1.0)).otherwise(let(normalize(answer), share))


def missing_points(points: Column, answer: Column) -> Column:
    """TXT-16: expected points whose raw text is not in the answer."""
    return F.filter(points, lambda p: (p != "") & ~F.contains(answer, p))


def format_ok(mode: Column, answer: Column) -> Column:
    """TXT-30."""
    return (
        F.when(mode == "table", F.contains(answer, F.lit("|")) & F.contains(answer, F.lit("---")))
        .when(mode == "step", F.contains(answer, F.lit("步骤")) | F.contains(answer, F.lit("1.")))
        .when(mode == "bullet", F.contains(answer, F.lit("1.")))
        .otherwise(F.length(_drop(answer, "")) > 0)
    )


# --- evidence tests ------------------------------------------------------

def excerpt_window_hit(sample: Column, document: Column) -> Column:
    """TXT-19: the first or last 40 characters of a sample lie in the document."""
    return (F.length(sample) >= 20) & (
        F.contains(document, F.left(sample, F.lit(40))) | F.contains(document, F.right(sample, F.lit(40)))
    )


def verification_status(excerpt: Column, document: Column) -> Column:
    """TXT-20 on compact texts (``compact_verify``)."""
    size = F.length(excerpt)
    # texts shorter than a window have a single window: the text itself
    wide_hit = F.exists(_cuts(excerpt, 20, 10), lambda w: F.contains(document, w))
    narrow_hits = F.size(F.filter(_cuts(excerpt, 8, 8), lambda w: F.contains(document, w)))
    return (
        F.when(size == 0, "empty")
        .when(F.contains(document, excerpt), "exact")
        .when((size >= 16) & F.contains(document, F.left(excerpt, F.lit(40))), "partial")
        .when((size >= 20) & wide_hit, "partial")
        .when((size >= 8) & (narrow_hits >= 2), "concept_supported")
        .otherwise("unverified")
    )


def bigram_ratio(left: Column, right: Column) -> Column:
    """TXT-18: share of the left bigrams found on the right; 0 for short texts."""
    a = F.array_distinct(grams(left, 2))
    b = F.array_distinct(grams(right, 2))
    return F.when((F.length(left) < 4) | (F.length(right) < 4), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(a)
    )


# --- headings, formulas, cleaning ----------------------------------------

def heading_variants(text: Column | str) -> Column:
    """TXT-22: the heading and the heading without its numbering."""
    text = text_or_empty(text)
    bare = text
    for pattern in (
        r"^\s*第[一二三四五六七八九十百千0-9]+[章节]\s*",
        r"^\s*[一二三四五六七八九十]+[、.．]\s*",
        r"^\s*[（(][一二三四五六七八九十0-9]+[）)]\s*",
        r"^\s*\d+[、.．]\s*",
    ):
        bare = F.regexp_replace(bare, "(?U)" + pattern, "")
    return F.when((bare != "") & (bare != text), F.array(text, bare)).otherwise(F.array(text))


def strip_markup(text: Column | str, placeholder: str) -> Column:
    """TXT-23: tags removed, whitespace collapsed, a placeholder when nothing is left."""
    bare = collapse_spaces(F.regexp_replace(text_or_empty(text), r"<[^>]*>", " "))
    return F.when(bare == "", F.lit(placeholder)).otherwise(bare)


def collapse_punctuation(text: Column | str) -> Column:
    """TXT-24: doubled full-width marks become one."""
    text = F.replace(text_or_empty(text), F.lit("．．"), F.lit("。"))
    for mark in ("。", "，", "；"):
        text = F.regexp_replace(text, mark + "{2,}", mark)
    return text


def looks_like_formula(text: Column | str) -> Column:
    """TXT-25: an operator, or four Latin letters and digits, in a short text without its number label."""
    bare = F.regexp_replace(F.replace(text_or_empty(text), F.lit(" "), F.lit("")), "(?U)" + V.FORMULA_LABEL, "")
    operators = F.regexp_count(bare, F.lit(V.FORMULA_OPERATORS))
    symbols = F.regexp_count(bare, F.lit("[A-Za-zα-ωΑ-Ω0-9]"))
    return (F.length(bare) > 0) & (F.length(bare) <= 220) & ((operators >= 1) | (symbols >= 4))


def formula_expression(text: Column | str) -> Column:
    """TXT-25: looks like a formula and holds no word of running prose."""
    return looks_like_formula(text) & ~any_word(text_or_empty(text), V.PROSE_FORMULA_MARKERS)


def natural_key(text: Column | str) -> Column:
    """TXT-26: text order of the keys is number order of the digit runs, however long they are.

    A run loses its leading zeros and gets its length, in as many digits as any length needs, in front.
    """
    parts = F.regexp_extract_all(text_or_empty(text), F.lit(r"\d+|\D+"), F.lit(0))
    bare = lambda p: F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0"))
    ranked = lambda p: F.concat(F.format_string("%010d", F.length(bare(p))), bare(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), ranked(p)).otherwise(p)), "")


def clean_question(text: Column | str) -> Column:
    """TXT-27: a question without the polite request."""
    bare = F.regexp_replace(F.trim(text_or_empty(text)), "(?U)" + V.POLITE_PREFIX, "")
    return F.trim(F.replace(bare, F.lit("请查看"), F.lit("")))


def bank_key(text: Column | str) -> Column:
    """TXT-03e: duplicate key of the question bank."""
    return _drop(F.lower(clean_question(text)), V.BANK_PUNCTUATION)


def routing_key(text: Column | str) -> Column:
    """TXT-27: a normalised question without its question words."""
    whole = normalize(text)
    key = F.regexp_replace(whole, "^(?:" + "|".join(V.QUESTION_PREFIXES) + ")", "")
    key = F.regexp_replace(key, "(?:" + "|".join(V.QUESTION_SUFFIXES) + ")$", "")
    return F.when(key == "", whole).otherwise(key)


def surrogate_id(prefix: str, *parts: Column) -> Column:
    """TXT-28: prefix and the first ten digits of a SHA-1."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 10))


def sql_literal(value: Column) -> Column:
    """TXT-29: a quoted SQL text literal, NULL for missing."""
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(quoted, F.lit("NULL"))


# --- list splitters ------------------------------------------------------

def _split(text: Column, pattern: str) -> Column:
    parts = F.transform(F.split(text_or_empty(text), pattern), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def split_a(text: Column) -> Column:
    """Splitter A: semicolons."""
    return _split(text, "[;；]")


def split_b(text: Column) -> Column:
    """Splitter B: semicolons of both widths, line breaks and pipes; duplicates dropped."""
    return F.array_distinct(_split(text, "[；;\n|]"))


def split_c(text: Column) -> Column:
    """Splitter C: semicolons, commas and line breaks."""
    return _split(text, "[;；,，\n]")


def split_d(text: Column) -> Column:
    """Splitter D: as C, and pipes."""
    return _split(text, "[;；|,，\n]")


# --- predicates ----------------------------------------------------------

def any_word(text: Column, words: Iterable[str]) -> Column:
    """True when one of the words occurs in the text."""
    result = F.lit(False)
    for word in words:
        result = result | F.contains(text, F.lit(word))
    return result


def count_words(text: Column, words: Iterable[str]) -> Column:
    """How many of the words occur (overlapping words count separately)."""
    total = F.lit(0)
    for word in words:
        total = total + F.contains(text, F.lit(word)).cast("int")
    return total


def placeholder_status(status: Column | str) -> Column:
    """FLT-08: a status that stands for missing media."""
    text = F.lower(F.trim(text_or_empty(status)))
    return (text == "") | text.startswith("needs_") | F.contains(text, F.lit("placeholder")) | F.contains(text, F.lit("待"))


def truthy(value: Column | str) -> Column:
    """FLT-10."""
    return F.lower(text_or_empty(value)).isin(*V.TRUE_WORDS)


def auto_chapter(value: Column | str) -> Column:
    return F.lower(F.trim(text_or_empty(value))).isin(*V.AUTO_WORDS)


def confidence(score: Column) -> Column:
    """RET-03."""
    return F.when(score >= V.HIGH_SCORE, "high").when(score >= V.MEDIUM_SCORE, "medium").otherwise("low")
