"""Keyword retrieval: many questions against many answer cards in one job (RET-01/02/03, JOI-07).

The score of a card is a sum of terms.  Equal questions are one question.

* Shared tokens, phrase rules and configuration are ranked block of cards against
  block of questions (``blocks``): no row is made for a shared token or a pair,
  only the best ``k`` per question, scope and block leave a task.
* Equality, containment and core equality with the canonical question, the
  patterns and the must-include items, and equal synonyms, make evidence rows.
  Their pairs are scored whole; evidence only adds points, so the best of both
  lists are the best of all.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import sqltext as S
from quillstone.functions import text as T
from quillstone.functions import values as V
from quillstone.operators.blocks import Tokens, best_pairs
from quillstone.operators.matching import (
    BROADCAST_BYTES,
    BROADCAST_POSTINGS,
    ANCHOR_LENGTHS,
    anchor_length,
    anchor_sql,
    posting_join,
)
from quillstone.operators.topk import last_wins, top_k

PHRASES = (
    *V.INTENT_PHRASES,
    *V.SCOPE_TERMS,
    V.FUNCTION_TERM,
    V.CONTENT_TERM,
    V.PRINCIPLE_TERM,
)
#: About what a posting (key, question id, hash table) takes up in a broadcast.
POSTING_BYTES = 100
EMPTY = "array<string>"


def _empty() -> Column:
    return F.array().cast(EMPTY)


def phrase_mask(normalized: str) -> Column:
    """Bit i is set when rule phrase i occurs in the text (given as SQL)."""
    bits = " | ".join(f"if(contains(t, {S.literal(p)}), {1 << i}, 0)" for i, p in enumerate(PHRASES))
    return F.expr(S.let("t", normalized, bits))


def has(mask: str, phrase: str) -> str:
    return f"({mask} & {1 << PHRASES.index(phrase)}) != 0"


def _rules() -> list[tuple[str, str, str, str, str, float, str]]:
    """Rules of RET-02: phrases (asked, not asked, in focus, not in focus, in the body; empty: any), points, reason; in the order reasons are listed."""
    rules = [(p, "", p, "", "", V.INTENT_POINTS, f"intent_focus:{p}") for p in V.INTENT_PHRASES]
    named = [(t, V.SCOPE_FOCUS_POINTS, V.SCOPE_BODY_POINTS, "scope") for t in V.SCOPE_TERMS]
    named.append((V.FUNCTION_TERM, V.FUNCTION_FOCUS_POINTS, V.FUNCTION_BODY_POINTS, "intent"))
    for term, focus, aside, kind in named:
        rules.append((term, "", term, "", "", focus, f"{kind}_focus:{term}"))
        rules.append((term, "", "", term, term, aside, f"{kind}_body_only:{term}"))
    content, principle = V.CONTENT_TERM, V.PRINCIPLE_TERM
    for asked, other, points in (
        (content, principle, V.CONTENT_AGAINST_PRINCIPLE),
        (principle, content, V.PRINCIPLE_AGAINST_CONTENT),
    ):
        rules.append((asked, other, other, "", "", points, f"intent_mismatch:{asked}_vs_{other}"))
    return rules


def intent_rules(q: str, focused: str, body: str) -> list[tuple[str, float, str]]:
    """(condition, points, reason) of RET-02 in the order reasons are listed."""
    result = []
    for asked, unasked, focus, unfocused, aside, points, reason in _rules():
        held = [(q, asked), (focused, focus), (body, aside)]
        lacking = [(q, unasked), (focused, unfocused)]
        conditions = [has(m, p) for m, p in held if p] + [f"not ({has(m, p)})" for m, p in lacking if p]
        result.append((" and ".join(conditions), points, reason))
    return result


def intent_points(q: np.ndarray, focused: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Sum of the rules' points for masks of questions (columns) and cards (rows), added in the order of the rules."""
    q, focused, body = q[None, :], focused[:, None], body[:, None]
    total = np.zeros((focused.shape[0], q.shape[1]))
    for asked, unasked, focus, unfocused, aside, points, _ in _rules():
        hit = np.ones(total.shape, bool)
        for mask, phrase, wanted in ((q, asked, True), (focused, focus, True), (body, aside, True), (q, unasked, False), (focused, unfocused, False)):
            if phrase:
                hit = hit & (((mask >> PHRASES.index(phrase)) & 1 == 1) == wanted)
        total += np.where(hit, float(points), 0.0)
    return total


def resolve_synonyms(synonyms: DataFrame, cards: DataFrame) -> DataFrame:
    """JOI-07: target by card id, else by standard id, else by a unique canonical question."""
    ids = cards.select(F.col("answer_id").alias("_id")).distinct()
    canonical = (
        cards.select(T.normalize("canonical_question").alias("_canonical"), "answer_id", "canonical_question")
        .where(F.coalesce(F.col("canonical_question"), F.lit("")) != "")
        .groupBy("_canonical")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("answer_id").alias("_by_question"))
        .where("_n = 1")
        .drop("_n")
    )
    by_target = ids.withColumnRenamed("_id", "_by_target")
    by_standard = ids.withColumnRenamed("_id", "_by_standard")
    rows = synonyms.withColumn("_canonical", T.normalize("target_id"))
    rows = (
        rows.join(by_target, F.col("target_id") == F.col("_by_target"), "left")
        .join(by_standard, F.col("standard_id") == F.col("_by_standard"), "left")
        .join(canonical, "_canonical", "left")
    )
    return rows.withColumn(
        "target_id", F.coalesce("_by_target", "_by_standard", "_by_question", "target_id")
    ).drop("_by_target", "_by_standard", "_by_question", "_canonical")


def prepare_cards(cards: DataFrame, synonyms: DataFrame, rag: DataFrame, q: DataFrame, small: bool) -> DataFrame:
    """Cards with config points, focused and body tokens and phrase masks.

    ``synonyms`` must be resolved.  A card may have any number of synonyms:
    they contribute here a bit mask and the tokens that some question asks for,
    each once, combined before the shuffle.
    """
    config = last_wins(
        rag.select("object_id", "retrieval_priority", "index_text", "primary_output", "ordinal"), ["object_id"]
    ).select(
        F.col("object_id").alias("answer_id"),
        F.col("index_text"),
        (
            F.least(F.lit(20.0), T.numeric_value("retrieval_priority") / 10)
            + F.when(F.col("primary_output"), 5.0).otherwise(0.0)
        ).alias("config_points"),
    )
    alias_masks = synonyms.groupBy(F.col("target_id").alias("answer_id")).agg(
        F.bit_or(phrase_mask(S.normalize("alias_or_question"))).alias("_alias_mask")
    )
    words = q.select(F.explode("q_tokens").alias("_token")).distinct()
    alias_tokens = (
        synonyms.select(F.col("target_id").alias("answer_id"), F.explode(T.tokens("alias_or_question")).alias("_token"))
        .join(F.broadcast(words) if small else words, "_token", "left_semi")
        .groupBy("answer_id")
        .agg(F.collect_set("_token").alias("_alias_tokens"))
    )
    rows = cards.select(
        "answer_id", "ordinal", "canonical_question", "student_question_patterns", "answer_points", "must_include",
        "scope",
    ).repartition("answer_id")
    rows = rows.join(config, "answer_id", "left").join(alias_masks, "answer_id", "left").join(alias_tokens, "answer_id", "left")
    focused = (
        "concat_ws(' ', coalesce(canonical_question, ''), "
        "array_join(coalesce(student_question_patterns, array()), ' '))"
    )
    body = (
        "concat_ws(' ', array_join(coalesce(answer_points, array()), ' '), "
        "array_join(coalesce(must_include, array()), ' '), coalesce(index_text, ''))"
    )
    must = f"transform(coalesce(must_include, {S.NO_TEXTS}), m -> {S.normalize('m')})"
    return rows.select(
        "answer_id",
        "scope",
        F.col("ordinal").cast("long").alias("ordinal"),
        F.coalesce("config_points", F.lit(0.0)).alias("config_points"),
        F.expr(f"cast({S.normalize('canonical_question')} = '' as int)").alias("blank_canonical"),
        F.expr(
            S.let("items", must, "cast(array_join(items, '') <> '' and exists(items, m -> m = '') as int)")
        ).alias("blank_must"),
        phrase_mask(S.normalize(focused)).bitwiseOR(F.coalesce("_alias_mask", F.lit(0))).cast("long").alias("focused_mask"),
        phrase_mask(S.normalize(body)).cast("long").alias("body_mask"),
        F.array_union(F.expr(S.tokens(focused)), F.coalesce("_alias_tokens", _empty())).alias("focused_tokens"),
        F.expr(S.tokens(body)).alias("body_tokens"),
    )


def keyword_scores(
    questions: DataFrame,
    cards: DataFrame,
    synonyms: DataFrame,
    rag: DataFrame,
    top: int = 5,
    limit: int = BROADCAST_POSTINGS,
    scope: str | None = None,
) -> DataFrame:
    """RET-01: (question_id, rank, answer_id, ordinal, score, reasons) for the best ``top`` cards.

    With ``scope`` (a card column such as the chapter) the best ``top`` cards
    of every scope are kept, in one pass over all scopes.

    questions(question_id, question); cards(ordinal, answer_id,
    canonical_question, student_question_patterns, answer_points,
    must_include); synonyms(ordinal, target_id, standard_id,
    alias_or_question, priority); rag(ordinal, object_id, retrieval_priority,
    index_text, primary_output).
    """
    cards = cards.withColumn("scope", (F.lit("") if scope is None else F.col(scope)).cast("string"))
    synonyms = resolve_synonyms(synonyms, cards)
    # equal questions are ranked once
    named = questions.select("question_id", F.coalesce("question", F.lit("")).alias("question"), F.md5(F.coalesce("question", F.lit(""))).alias("pin"))
    q = named.select("pin", "question").dropDuplicates(["pin"]).select(
        "pin",
        T.normalize("question").alias("q_norm"),
        T.tokens("question").alias("q_tokens"),
        phrase_mask(S.normalize("question")).alias("q_mask"),
    )
    size = _question_size(q)
    small = size["postings"] <= limit and size["bytes"] <= BROADCAST_BYTES
    index = prepare_cards(cards, synonyms, rag, q, small)
    asked = q.select("pin", _asked_mask().cast("long").alias("q_mask"), "q_tokens")
    found = (
        _text_evidence(q, cards, size, small)
        .unionByName(_synonym_evidence(q, synonyms, small), allowMissingColumns=True)
        .groupBy("answer_id", "pin")
        .agg(*[F.max(c).alias(c) for c in EVIDENCE])
        .join(index, "answer_id")
        .join(F.broadcast(asked) if small else asked, "pin")
        .withColumn("focused", F.size(F.array_intersect("q_tokens", "focused_tokens")).cast("long"))
        .withColumn("body", F.size(F.array_intersect("q_tokens", "body_tokens")).cast("long"))
        .drop("q_tokens", "focused_tokens", "body_tokens")
    )
    kept = top + _lowered_pairs(q, synonyms, small)
    pairs = _token_ranking(q, index, kept, size["questions"]).unionByName(found, allowMissingColumns=True)
    pairs = pairs.groupBy("answer_id", "pin").agg(
        *[F.max(c).alias(c) for c in (*CARD_FACTS[1:], "q_mask", "focused", "body", "synonym_priority")],
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in EVIDENCE[:3]],
    )
    scored = _score(pairs).where("score > 0")
    best = top_k(scored, ["pin", "scope"], [F.desc("score"), F.col("ordinal")], top)
    kept = best.select("pin", "scope", "rank", "answer_id", "ordinal", "score", _reasons().alias("reasons"))
    return named.select("question_id", "pin").join(kept, "pin").select(
        "question_id", *([] if scope is None else ["scope"]), "rank", "answer_id", "ordinal", "score", "reasons"
    )


SYNONYM_POINTS = 70
EVIDENCE = ["canonical_level", "pattern_level", "must_level", "synonym_priority"]


def _asked_mask() -> Column:
    """Phrase mask of a question; -1 when nothing is left after normalising."""
    return F.when(F.col("q_norm") != "", F.col("q_mask")).otherwise(F.lit(-1))


def _question_size(q: DataFrame) -> dict:
    """Upper bound of the postings and about their bytes in a broadcast, range of text lengths and anchor lengths in use; one small job."""
    asked = F.when(F.col("q_norm") != "", F.col("q_norm"))
    row = q.agg(
        F.coalesce(F.sum(F.size("q_tokens") + len(PHRASES) + 5 * F.length("q_norm") + 3), F.lit(0)).alias("postings"),
        F.coalesce(F.sum(POSTING_BYTES * (F.size("q_tokens") + len(PHRASES) + 5 * F.length("q_norm") + 3)), F.lit(0)).alias("bytes"),
        F.coalesce(F.min(F.length(asked)), F.lit(1)).alias("shortest"),
        F.coalesce(F.max(F.length(asked)), F.lit(0)).alias("longest"),
        F.sort_array(F.collect_set(anchor_length(asked))).alias("anchors"),
        F.count(F.lit(1)).alias("questions"),
    ).first()
    return row.asDict()


#: Points of a focused token and their cap, of a body token and their cap.
TOKEN_POINTS = (6.0, 72.0, 1.5, 18.0)
#: Cards of a block at most, and questions that meet it at a time.
BLOCK_CARDS = 20_000
BLOCK_QUESTIONS = 20_000
PAIR = (
    "answer_id string, pin string, scope string, ordinal bigint, config_points double, focused_mask bigint, body_mask bigint, "
    "blank_canonical int, blank_must int, q_mask bigint, focused bigint, body bigint"
)


def _best_by_tokens(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Best ``k`` cards of a block per question and scope, by everything but text evidence."""

    def best(asked: pa.Table, cards: pa.Table) -> pa.Table:
        schema = pa.schema(
            [(n, cards.schema.field(n).type) for n in CARD_FACTS]
            + [("pin", pa.string()), ("q_mask", pa.int64()), ("focused", pa.int64()), ("body", pa.int64())]
        )
        order = ["answer_id", "pin", "scope", "ordinal", "config_points", "focused_mask", "body_mask", "blank_canonical", "blank_must", "q_mask", "focused", "body"]
        if not asked.num_rows or not cards.num_rows:
            return schema.empty_table().select(order)
        cards = cards.take(pc.sort_indices(cards["ordinal"]))
        vocabulary = pc.unique(asked["q_tokens"].combine_chunks().flatten())
        words = max(1, len(vocabulary))
        q_tokens, focused, body = (Tokens(t, vocabulary) for t in (asked["q_tokens"], cards["focused_tokens"], cards["body_tokens"]))
        mask, q_mask = asked["q_mask"].to_numpy(), np.maximum(asked["q_mask"].to_numpy(), 0)
        masks = [cards[n].to_numpy() for n in ("focused_mask", "body_mask")]
        config, blank_canonical, blank_must = (cards[n].to_numpy() for n in ("config_points", "blank_canonical", "blank_must"))
        kinds, kind = np.unique(np.stack(masks), axis=1, return_inverse=True)
        asks, ask = np.unique(q_mask, return_inverse=True)
        intent = intent_points(asks, kinds[0], kinds[1])
        kind, ask = kind.reshape(-1), ask.reshape(-1)

        def parts(c: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            held = mask[q][None, :] >= 0
            before = np.where((blank_canonical[c] == 1)[:, None] & held, 85.0, 0.0)
            must = np.where((blank_must[c] == 1)[:, None] & held, 20.0, 0.0)
            return before, intent[np.ix_(kind[c], ask[q])] + must, np.broadcast_to(config[c][:, None], (len(c), len(q)))

        most = 85.0 * (blank_canonical == 1) + 20.0 * (blank_must == 1) + intent.max(axis=1)[kind] + config
        groups: dict = {}
        for i, value in enumerate(cards["scope"].to_pylist()):
            groups.setdefault(value, []).append(i)
        found = [best_pairs(focused, body, q_tokens, words, np.asarray(g), parts, most, TOKEN_POINTS, k) for g in groups.values()]
        c, q, in_focus, in_body = (np.concatenate(x) for x in zip(*found))
        rows = cards.select(CARD_FACTS).take(pa.array(c))
        more = {"pin": asked["pin"].take(pa.array(q)), "q_mask": pa.array(mask[q]), "focused": pa.array(in_focus), "body": pa.array(in_body)}
        for name, values in more.items():
            rows = rows.append_column(name, values)
        return rows.select(order)

    return best


CARD_FACTS = ["answer_id", "scope", "ordinal", "config_points", "focused_mask", "body_mask", "blank_canonical", "blank_must"]


def _token_ranking(q: DataFrame, index: DataFrame, top: int, asked: int) -> DataFrame:
    """Pairs that can be among the best ``top`` without text evidence, with their numbers of shared tokens.

    Evidence only adds points, so a card without any that is among the best is also among the best by tokens alone
    (``top`` is raised by the number of pairs that lose points).
    """
    spread = 3 * index.sparkSession.sparkContext.defaultParallelism
    count = index.count()
    blocks = max(1, min(spread, count // 200), math.ceil(count / BLOCK_CARDS))
    groups = max(1, math.ceil(asked / BLOCK_QUESTIONS))

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))

    cards = index.select(*CARD_FACTS, "focused_tokens", "body_tokens", F.pmod(F.xxhash64("answer_id"), F.lit(blocks)).alias("_block"))
    cards = cards.withColumn("_group", all_of(groups))
    questions = q.select("pin", "q_tokens", _asked_mask().cast("long").alias("q_mask"), F.pmod(F.xxhash64("pin"), F.lit(groups)).alias("_group"))
    questions = questions.withColumn("_block", all_of(blocks))
    keyed = [["_block", "_group"]] * 2
    return questions.groupBy(*keyed[0]).cogroup(cards.groupBy(*keyed[1])).applyInArrow(_best_by_tokens(top), PAIR)


def _text_evidence(q: DataFrame, cards: DataFrame, size: dict, small: bool) -> DataFrame:
    """Equality (3), containment (2) and core equality (1) with the card's own texts."""
    q = q.where("q_norm <> ''").select("pin", "q_norm", F.expr(S.core("q_norm")).alias("q_core"))

    def entries(values: str, kind: str) -> str:
        kept = f"filter(transform(coalesce({values}, {S.NO_TEXTS}), v -> {S.normalize('v')}), v -> v <> '')"
        return f"transform(array_distinct({kept}), v -> struct('{kind}' as kind, v as t))"

    texts = (
        cards.select("answer_id", "canonical_question", "student_question_patterns", "must_include")
        .repartition("answer_id")
        .select(
            "answer_id",
            F.expr(
                f"posexplode(concat(array(struct('c' as kind, {S.normalize('canonical_question')} as t)), "
                f"{entries('student_question_patterns', 'p')}, {entries('must_include', 'm')}))"
            ).alias("n", "_x"),
        )
        .select("answer_id", "n", F.col("_x.kind").alias("kind"), F.col("_x.t").alias("t"))
    )

    def tag(prefix: str, keys: str) -> str:
        return f"transform({keys}, k -> concat('{prefix}', k))"

    # a text can lie in a question only if it is no longer than the longest one,
    # and a question can start in a text only where the shortest one still fits
    room = f"substring(t, 1, length(t) - {size['shortest']} + {max(size['anchors'], default=1)})"
    found = ", ".join([S.NO_TEXTS, *[S.cuts(room, n) for n in size["anchors"]]])
    row_keys = F.expr(
        f"concat(if(length(t) between 1 and {size['longest']}, array(concat('n:', {anchor_sql('t')})), {S.NO_TEXTS}), "
        f"if(kind <> 'm' and length(t) >= {size['shortest']}, {tag('h:', f'concat({found})')}, {S.NO_TEXTS}), "
        f"if(kind <> 'm', array(concat('k:', {S.core('t')})), {S.NO_TEXTS}))"
    )
    inner = ", ".join(S.cuts("q_norm", n) for n in ANCHOR_LENGTHS)
    q_keys = F.expr(
        f"concat({tag('n:', f'array_distinct(concat({inner}))')}, "
        f"array(concat('h:', {anchor_sql('q_norm')}), concat('k:', q_core)))"
    )
    # only the keys are exploded: a long text or question is never copied once per key
    rows = texts.select("answer_id", "n", F.explode(row_keys).alias("key"))
    postings = q.select("pin", F.explode(q_keys).alias("key"))
    asked = q.select("pin", "q_norm")
    joined = (
        posting_join(rows, postings, "key", "answer_id", small)
        .groupBy("answer_id", "n", "pin")
        .agg(F.max(F.startswith("key", F.lit("k:"))).alias("same_core"))
        .join(F.broadcast(asked) if small else asked, "pin")
        .join(texts, ["answer_id", "n"])
    )
    inside = F.contains("q_norm", F.col("t")) | ((F.col("kind") != "m") & F.contains("t", F.col("q_norm")))
    joined = joined.where(F.col("same_core") | inside)
    level = F.when(F.col("t") == F.col("q_norm"), 3).when(inside, 2).otherwise(1)
    return joined.groupBy("answer_id", "pin").agg(
        F.max(F.when(F.col("kind") == "c", level)).alias("canonical_level"),
        F.max(F.when(F.col("kind") == "p", level)).alias("pattern_level"),
        F.max(F.when(F.col("kind") == "m", 1)).alias("must_level"),
    )


def _synonym_evidence(q: DataFrame, synonyms: DataFrame, small: bool) -> DataFrame:
    """Equal aliases, reduced per (card, question) before the shuffle: a card that owns a third of all synonyms sends a bounded number of rows."""
    aliases = synonyms.select(F.col("target_id").alias("answer_id"), "ordinal", "priority", T.normalize("alias_or_question").alias("key"))
    asked = q.where("q_norm <> ''").select("pin", F.col("q_norm").alias("key"))
    return posting_join(aliases, asked, "key", "ordinal", small).groupBy("answer_id", "pin").agg(
        F.min_by(T.numeric_value("priority", 1.0), F.col("ordinal")).alias("synonym_priority")
    )


def _lowered_pairs(q: DataFrame, synonyms: DataFrame, small: bool) -> int:
    """Most cards that a question's synonyms take points from, as a priority below -14 does; usually none, which the priorities alone tell."""
    points = SYNONYM_POINTS + 5 * T.numeric_value("priority", 1.0)
    if (synonyms.agg(F.min(points)).first()[0] or 0) >= 0:
        return 0
    lowered = _synonym_evidence(q, synonyms, small).where(SYNONYM_POINTS + 5 * F.col("synonym_priority") < 0)
    return lowered.groupBy("pin").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def _score(pairs: DataFrame) -> DataFrame:
    asked = F.col("q_mask") >= 0
    q_mask = F.greatest(F.col("q_mask"), F.lit(0))
    canonical_level = F.when(
        (F.col("blank_canonical") == 1) & asked, F.lit(2)
    ).otherwise(F.col("canonical_level"))
    canonical = (
        F.when(canonical_level == 3, 120.0).when(canonical_level == 2, 85.0).when(canonical_level == 1, 110.0).otherwise(0.0)
    )
    pattern = (
        F.when(F.col("pattern_level") == 3, 180.0)
        .when(F.col("pattern_level") == 2, 75.0)
        .when(F.col("pattern_level") == 1, 140.0)
        .otherwise(0.0)
    )
    must = ((F.col("blank_must") == 1) & asked) | (F.col("must_level") == 1)
    rules = intent_rules("greatest(q_mask, 0)", "focused_mask", "body_mask")
    intent = F.expr(" + ".join(f"if({condition}, {points}D, 0D)" for condition, points, _ in rules))
    score = (
        canonical
        + pattern
        + F.coalesce(SYNONYM_POINTS + 5 * F.col("synonym_priority"), F.lit(0.0))
        + F.least(F.lit(72.0), 6.0 * F.col("focused"))
        + F.least(F.lit(18.0), 1.5 * F.col("body"))
        + intent
        + F.when(must, 20.0).otherwise(0.0)
        + F.col("config_points")
    )
    return pairs.select(
        "*",
        score.alias("score"),
        canonical_level.alias("_canonical"),
        must.alias("_must"),
        q_mask.alias("_q"),
    )


def _reasons() -> Column:
    names = {3: "exact", 2: "partial", 1: "intent_core"}

    def named(level: Column, kind: str) -> Column:
        result = F.lit(None).cast("string")
        for value, name in names.items():
            result = F.when(level == value, F.lit(f"{name}_{kind}")).otherwise(result)
        return result

    intents = [
        F.expr(f"if({condition}, '{reason}', null)")
        for condition, _, reason in intent_rules("_q", "focused_mask", "body_mask")
    ]
    return F.array_compact(
        F.array(
            named(F.col("_canonical"), "canonical"),
            named(F.col("pattern_level"), "pattern"),
            F.when(F.col("synonym_priority").isNotNull(), F.lit("synonym")),
            F.when(F.col("focused") > 0, F.concat(F.lit("focused_token_overlap:"), F.col("focused"))),
            F.when(F.col("body") > 0, F.concat(F.lit("body_token_overlap:"), F.col("body"))),
            *intents,
            F.when(F.col("_must"), F.lit("must_include_match")),
        )
    )
