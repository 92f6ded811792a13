import random

import models
import pytest
from pyspark.sql import functions as F

from quillstone.operators import hybrid, matching, resources
from quillstone.operators.keyword import keyword_scores
from quillstone.operators.vector import cosine, vector_top_k
from quillstone.operators.trigram import similar_pairs

CARD = "ordinal long, answer_id string, chapter_id string, canonical_question string, student_question_patterns array<string>, answer_points array<string>, must_include array<string>"
SYN = "ordinal long, target_id string, standard_id string, alias_or_question string, priority string"
RAG = "ordinal long, object_id string, retrieval_priority int, index_text string, primary_output boolean"


def fixture(n_cards=60, n_questions=25, seed=5):
    rnd = random.Random(seed)
    words = ["平面设计", "原则", "内容", "流程", "区别", "功能", "数字孪生", "BIM", "gis", "的", "是什么", "包括哪些", "纵断面", "？", " ", "请简要说明", "交叉口", "作用"]
    text = lambda k: "".join(rnd.choices(words, k=k))
    cards = [
        (i, f"a{i}", f"ch{i % 3}", text(rnd.randint(0, 4)), [text(rnd.randint(0, 4)) for _ in range(rnd.randint(0, 3))],
         [text(5) for _ in range(rnd.randint(0, 3))], [text(rnd.randint(0, 2)) for _ in range(rnd.randint(0, 2))])
        for i in range(n_cards)
    ]
    questions = [(f"q{i}", rnd.choice([text(rnd.randint(1, 5)), rnd.choice(cards)[3], "？", "zzz"])) for i in range(n_questions)]
    # one card owns a third of all synonyms
    synonyms = [
        (i, f"a{0 if i % 3 == 0 else rnd.randrange(n_cards)}", "", rnd.choice([text(3), rnd.choice(questions)[1]]), rnd.choice([None, "2", "P3"]))
        for i in range(60)
    ]
    rag = [(i, f"a{i}", rnd.randint(0, 300), text(2), rnd.random() < 0.5) for i in range(0, n_cards, 2)]
    return cards, questions, synonyms, rag


def expected_hits(cards, questions, synonyms, rag, top, scoped=False):
    names = ["ordinal", "answer_id", "chapter_id", "canonical_question", "student_question_patterns", "answer_points", "must_include"]
    config = {r[1]: {"retrieval_priority": r[2], "index_text": r[3], "primary_output": r[4]} for r in rag}
    result = {}
    for qid, question in questions:
        rows = []
        for values in cards:
            card = dict(zip(names, values))
            own = [
                {"alias_or_question": s[3], "priority": None if s[4] is None else float(s[4].lstrip("P"))}
                for s in synonyms if s[1] == card["answer_id"]
            ]
            score = models.keyword_score(question, card, own, config.get(card["answer_id"]))
            if score > 0:
                rows.append((card["chapter_id"] if scoped else "", -score, card["ordinal"], card["answer_id"]))
        for scope in {r[0] for r in rows}:
            ranked = sorted(r[1:] for r in rows if r[0] == scope)[:top]
            result[qid, scope] = [(r[2], round(-r[0], 6)) for r in ranked]
    return result


@pytest.mark.parametrize("limit,scope", [(matching.BROADCAST_POSTINGS, None), (0, None), (matching.BROADCAST_POSTINGS, "chapter_id")])
def test_keyword_scores_match_the_model(spark, limit, scope):
    """Broadcast, salted and per-chapter forms give the whole, exact ranking."""
    cards, questions, synonyms, rag = fixture()
    hits = keyword_scores(
        spark.createDataFrame(questions, "question_id string, question string"), spark.createDataFrame(cards, CARD),
        spark.createDataFrame(synonyms, SYN), spark.createDataFrame(rag, RAG), 5, limit=limit, scope=scope,
    ).collect()
    got = {}
    for row in sorted(hits, key=lambda r: r["rank"]):
        got.setdefault((row.question_id, row.scope if scope else ""), []).append((row.answer_id, round(row.score, 6)))
    assert got == expected_hits(cards, questions, synonyms, rag, 5, scope is not None)


def test_keyword_reasons(spark):
    cards = [(0, "a0", "c", "数字孪生是什么", ["什么叫数字孪生"], ["虚实闭环"], ["孪生"])]
    row = keyword_scores(
        spark.createDataFrame([("q", "数字孪生是什么？")], "question_id string, question string"), spark.createDataFrame(cards, CARD),
        spark.createDataFrame([(0, "数字孪生是什么", "", "数字孪生是什么", "2")], SYN), spark.createDataFrame([], RAG), 1,
    ).first()
    assert row.reasons[:2] == ["exact_canonical", "synonym"] and row.reasons[-1] == "must_include_match"
    assert row.score == models.keyword_score(
        "数字孪生是什么？",
        dict(zip(["canonical_question", "student_question_patterns", "answer_points", "must_include"], cards[0][3:])),
        [{"alias_or_question": "数字孪生是什么", "priority": 2}], None,
    )


def test_contains_pairs_equals_brute_force(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("ab", k=rnd.choice([3, 40, 700]))) for _ in range(40)]
    needles = [("".join(rnd.choices("ab", k=rnd.randint(1, 20)))) for _ in range(40)]
    hay = spark.createDataFrame(list(enumerate(texts)), "h int, t string")
    pins = spark.createDataFrame(list(enumerate(needles)), "n int, s string")
    want = {(i, j) for i, t in enumerate(texts) for j, s in enumerate(needles) if s in t}
    for limit in (10_000, 0):
        rows = matching.contains_pairs(hay, "h", "t", pins, "n", "s", limit, 0 if limit else 1 << 20).distinct().collect()
        assert {(r.h, r.n) for r in rows} == want


def test_contains_pairs_around_the_gram_lengths(spark):
    """Needle lengths around 2n - 1, at every offset, with an id that has several texts."""
    rnd = random.Random(3)
    text = "".join(rnd.choices("abcdefgh", k=900))
    texts = [text[i:] for i in (0, 5, 11, 300)] + ["".join(rnd.choices("abcdefgh", k=400)), "ab", "a", ""]
    needles = [text[s : s + n] for n in (1, 2, 3, 4, 6, 7, 8, 14, 15, 16, 17, 30, 31, 32, 33, 63, 64) for s in range(280, 300)] + ["zz", "abz"]
    hay = spark.createDataFrame(list(enumerate(texts)), "h int, t string")
    pins = spark.createDataFrame([(j // 2, s) for j, s in enumerate(needles)], "n int, s string")
    want = {(i, j // 2) for i, t in enumerate(texts) for j, s in enumerate(needles) if s in t}
    for limit in (1_000_000, 0):
        rows = matching.contains_pairs(hay, "h", "t", pins, "n", "s", limit).distinct().collect()
        assert {(r.h, r.n) for r in rows} == want


def test_overlap_with_a_hot_item(spark):
    """One item in every row: salted and broadcast counts agree with brute force."""
    corpus = [(i, ["hot", f"x{i % 7}", f"y{i % 5}"]) for i in range(300)]
    asked = [(j, ["hot", f"x{j}", "y1"]) for j in range(7)]
    c, q = spark.createDataFrame(corpus, "c int, items array<string>"), spark.createDataFrame(asked, "q int, items2 array<string>")
    want = {(i, j): len(set(a) & set(b)) for i, a in corpus for j, b in asked}
    for limit in (1000, 0):
        rows = matching.overlap_counts(c, "c", F.col("items"), q, "q", F.col("items2"), limit).collect()
        assert {(r.c, r.q): r.shared for r in rows} == want


def test_vectors_edges_and_block_form(spark):
    corpus = [(0, "a", [1.0, 0.0]), (1, "b", [0.0, 2.0]), (2, "z", [0.0, 0.0]), (3, "d", [1.0, 0.0, 0.0]), (4, "n", None), (5, "c", [1.0, 1.0])]
    c = spark.createDataFrame(corpus, "ordinal long, source_id string, embedding array<double>")
    q = spark.createDataFrame([("q1", [2.0, 0.0]), ("q2", [0.0, 0.0])], "question_id string, embedding array<double>")
    first = sorted((r.question_id, r["rank"], r.source_id, round(r.similarity, 6)) for r in vector_top_k(q, c, 5).collect())
    assert [x[2:] for x in first if x[0] == "q1"] == [("a", 1.0), ("c", 0.707107), ("b", 0.0), ("z", -1.0), ("d", -1.0)]
    assert all(x[3] == -1.0 for x in first if x[0] == "q2")
    blocks = sorted((r.question_id, r["rank"], r.source_id, round(r.similarity, 6)) for r in vector_top_k(q, c, 5, limit=1).collect())
    assert blocks == first
    values = [r[0] for r in c.select(cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0)))).collect()]
    assert values[:4] == [1.0, 0.0, -1.0, -1.0]


def test_trigram_threshold_equals_brute_force(spark):
    rnd = random.Random(2)
    words = "road rode rods plan plane model modal".split()
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    q = df.select(F.col("text_id").alias("question_id"), F.col("text").alias("question"))

    def tri(t):
        return {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}

    want = {}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            s = len(tri(a) & tri(b)) / len(tri(a) | tri(b))
            if s >= 0.3:
                want[i, j] = round(s, 6)
    for limit in (10_000, 0):
        assert {(r.text_id, r.question_id): round(r.sim, 6) for r in similar_pairs(df, q, limit=limit).collect()} == want


def test_resource_labels_types_and_suppression(spark):
    schema = (
        "ordinal long, resource_id string, resource_type string, title string, description string, keywords array<string>, "
        "reference_aliases array<string>, trigger_questions array<string>, related_kps array<string>, status string, suppress_recommendation boolean"
    )
    rows = [
        (0, "ch01_fig_1_1", "image", "演进图", "", [], [], [], [], "bound", False),
        (1, "ch01_fig_1_11", "image", "另一图", "", [], [], [], [], "bound", False),
        (2, "ch05_formula_5_2", "formula", "坡度公式", "", ["坡度"], [], [], [], "bound", False),
        (3, "s1", "interactive_html", "孪生脚本", "", [], ["虚实闭环"], ["我想看孪生脚本"], [], "bound", True),
    ]
    res = spark.createDataFrame(rows, schema)
    q = spark.createDataFrame(
        [("f", "看看图1-1"), ("g", "公式5-2怎么算"), ("t", "我想看孪生脚本"), ("n", "孪生的互动")], "question_id string, question string"
    )
    hits = {}
    for r in sorted(resources.search_resources(q, res).collect(), key=lambda r: r["rank"]):
        hits.setdefault(r.question_id, []).append(r)
    assert hits["f"][0].resource_id == "ch01_fig_1_1" and "figure_reference" in hits["f"][0].reasons
    assert all("figure_reference" not in r.reasons for r in hits["f"] if r.resource_id == "ch01_fig_1_11")
    assert hits["g"][0].resource_id == "ch05_formula_5_2" and "formula_reference" in hits["g"][0].reasons
    assert hits["t"][0].resource_id == "s1" and {"exact_trigger", "script_intent"} <= set(hits["t"][0].reasons)
    assert "s1" not in {r.resource_id for r in hits["n"]}  # suppressed without a strong reason


def test_direct_override(spark):
    cards = spark.createDataFrame([(0, "a0", "c", "甲", ["乙"], [], []), (1, "a1", "c", "乙", [], [], [])], CARD)
    q = spark.createDataFrame([("q", "乙？")], "question_id string, question string")
    hits = spark.createDataFrame([("q", "a1", 1, 200.0, ["x"])], "question_id string, answer_id string, rank int, score double, reasons array<string>")
    rows = sorted(hybrid.direct_override(q, hits, hybrid.direct_matches(cards)).collect(), key=lambda r: r["rank"])
    assert [(r.answer_id, r.score) for r in rows] == [("a0", 400.0), ("a1", 200.0)]
    assert rows[0].reasons == ["direct_question_override", "student_question_pattern"]
