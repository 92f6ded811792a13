import random

import models
from pyspark.sql import functions as F

from quillstone.functions import similarity, text as T
from quillstone.operators import align


ALPHABET = "道路设计流程数字孪生BIMcad 12+._-，。？（）　 \n|的图a"


def samples(n=200):
    rnd = random.Random(7)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.choice([0, 1, 2, 5, 12, 40, 300]))) for _ in range(n)]


def test_normalize_and_tokens_match_the_model(spark):
    texts = samples()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(
        "i", T.normalize("t").alias("n"), T.normalize(F.col("t")).alias("n2"), T.tokens("t").alias("k"), T.tokens(F.col("t")).alias("k2")
    ).collect()
    for row in rows:
        assert row.n == row.n2 == models.normalize(texts[row.i])
        assert set(row.k) == set(row.k2) == models.tokens(texts[row.i])
        assert len(row.k) == len(set(row.k))


def test_long_texts_give_every_gram(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(3000))
    row = spark.createDataFrame([(text,)], "t string").select(
        T.grams("t", 16).alias("g"), T.grams(F.col("t"), 5).alias("h"), F.size(T._cuts(F.col("t"), 20, 10)).alias("w")
    ).first()
    assert row.g == [text[i : i + 16] for i in range(2985)]
    assert row.h == [text[i : i + 5] for i in range(2996)]
    assert row.w == len(range(0, 2981, 10))


def test_splitters_and_small_rules(spark):
    row = spark.createDataFrame([("a；b;a\nc|d,e，f",)], "t string").select(
        T.split_a(F.col("t")).alias("a"), T.split_b(F.col("t")).alias("b"), T.split_c(F.col("t")).alias("c"), T.split_d(F.col("t")).alias("d"),
        T.collapse_punctuation(F.lit("x。．．。y，，z；；")).alias("p"), T.priority_value(F.lit("P1_x")).alias("q"),
        T.routing_key(F.lit("什么是数字孪生？")).alias("r"), T.clean_question(F.lit("请按条目回答：内容")).alias("s"),
        T.compact_contains(F.lit("图112"), F.lit("图11")).alias("t1"), T.compact_contains(F.lit("图11页"), F.lit("图11")).alias("t2"),
        T.heading_variants(F.lit("第1章 概述")).alias("h"), T.numeric_value(F.lit("P-2.5x")).alias("n"),
        T.verification_status(F.lit("abcdefgh" * 3), F.lit("zzabcdefghzzabcdefghyy")).alias("v"),
    ).first()
    assert row.a == ["a", "b", "a\nc|d,e，f"]
    assert row.b == ["a", "b", "c", "d,e，f"]
    assert row.c == ["a", "b", "a", "c|d", "e", "f"]
    assert row.d == ["a", "b", "a", "c", "d", "e", "f"]
    assert (row.p, row.q, row.r, row.s) == ("x。y，z；", 100, "数字孪生", "内容")
    assert (row.t1, row.t2) == (False, True)
    assert row.h == ["第1章 概述", "概述"] and row.n == -2.5 and row.v == "concept_supported"


def test_similarity_and_boundary_review_match_brute_force(spark):
    rnd = random.Random(3)
    words = "alpha beta gamma delta road plan model 道路 设计 数据 data twin bridge".split()
    lines = [(d, i, " ".join(rnd.choices(words, k=rnd.randint(3, 9)))) for d in range(3) for i in range(6)]
    chunks = [(c, "s", " ".join(rnd.choices(words, k=6)), " ".join(rnd.choices(words, k=3)), "a > beta plan", "") for c in range(5)]
    df = spark.createDataFrame(lines, "doc_id int, ordinal int, text string")
    windows = align.line_windows(df).withColumn("section_id", F.lit("s"))
    got = {
        r.chunk_id: r
        for r in align.boundary_review(
            spark.createDataFrame(chunks, "chunk_id int, section_id string, excerpt string, summary string, heading string, classification string"), windows
        ).collect()
    }
    spans = []
    for d in range(3):
        own = [t for doc, _, t in lines if doc == d]
        spans += [(d, i, i + n - 1, " ".join(own[i : i + n])) for i in range(6) for n in (1, 2, 3) if i + n <= 6]
    term_rows = spark.createDataFrame([(c[0], [c[2], c[3], c[4]]) for c in chunks], "id int, v array<string>").select("id", T.terms(F.col("v"), 20).alias("t"))
    terms = {r.id: [models.boundary(t) for t in r.t] for r in term_rows.collect()}
    for c, _, excerpt, summary, heading, _ in chunks:
        scores = []
        for d, i, j, text in spans:
            t = models.boundary(text)
            e, s, h = (models.similarity(models.boundary(x), t) for x in (excerpt, summary, heading.split(">")[-1]))
            hit = sum(x in t for x in terms[c])
            value = 0.48 * e + 0.24 * s + 0.1 * h + 0.18 * hit / len(terms[c])
            value += 0.1 if e >= 0.65 else 0.06 if s >= 0.65 else 0
            value += 0.04 if hit >= 3 else 0
            scores.append((-round(min(1.0, value), 6), d, i, j))
        scores.sort()
        best, second = scores[0], scores[1]
        assert (got[c].doc_id, got[c].line_start, got[c].line_end) == best[1:]
        assert abs(got[c].best_score + best[0]) < 1e-6
        assert abs(got[c].score_margin - (second[0] - best[0])) < 2e-6


def test_sequence_ratio_is_null_where_not_needed(spark):
    df = spark.createDataFrame([("ab", "ab"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(similarity.sequence_ratio("a", "b")).collect()] == [1.0, None]
