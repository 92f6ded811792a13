"""Operators on small fixtures that the sample tables do not reach: hot keys, long numbers, emptied versions."""

import random

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import enrich, matching, normalize, quality, review
from quillstone.operators import merge as M
from quillstone.operators import relations as R
from quillstone.operators import trigram
from quillstone.operators.topk import numbered
from quillstone.operators.trigram import evidence_lookup, similar_pairs
from quillstone.sources import packages, sinks


def test_a_thousand_equal_ids(spark, monkeypatch):
    monkeypatch.setattr(M, "STRETCH", 70)
    rows = [(i, "same" if i % 2 else ("" if i % 10 == 0 else f"x{i}")) for i in range(2000)]
    got = {r["ordinal"]: r["id"] for r in M.unique_ids(spark.createDataFrame(rows, "ordinal bigint, id string"), "id", "row").collect()}
    assert len(set(got.values())) == 2000
    seen = 0
    for i, key in rows:
        if key == "same":
            seen += 1
            assert got[i] == ("same" if seen == 1 else f"same_dup{seen:02d}")
        else:
            assert got[i] == (key or f"row_{i:04d}")


def test_numbers_of_a_hot_key(spark):
    r = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", r.randrange(5000)) for i in range(3000)]
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k string, v int, i int")
    got = {x["i"]: x["n"] for x in numbered(df, ["k"], [F.floor(F.col("v") / 100)], [F.col("v"), F.col("i")], "n").collect()}
    order: dict[str, int] = {}
    for k, v, i in sorted((k, v, i) for i, (k, v) in enumerate(rows)):
        order[k] = order.get(k, 0) + 1
        assert got[i] == order[k]


def test_recommended_resources(spark):
    cards = [("a", ["k1", "k2"], ["r9", "r1"]), ("b", ["k3"], []), ("c", [], ["r1"]), *[(f"h{i}", ["hot"], []) for i in range(40)]]
    resources = [(i, f"r{i}", kind, kps) for i, (kind, kps) in enumerate([("interactive_html", ["k1"]), ("interactive_html", ["k2", "k1"]), ("image", ["k1"]), ("interactive_html", ["k2"]), ("interactive_html", ["hot", "k2"])])]
    got: dict[str, list] = {}
    found = M.recommended_by_points(
        spark.createDataFrame(cards, "answer_id string, related_kps array<string>, recommended_resources array<string>"),
        spark.createDataFrame(resources, "ordinal int, resource_id string, resource_type string, related_kps array<string>"),
    )
    for r in found.orderBy("answer_id", "rank").collect():
        got.setdefault(r["answer_id"], []).append(r["resource_id"])
    assert got == {"a": ["r9", "r1", "r0", "r3", "r4"], "c": ["r1"], **{f"h{i}": ["r4"] for i in range(40)}}


def test_natural_order_of_long_numbers(spark):
    texts = ["a" + "1" * 25, "a" + "1" * 24 + "0", "a9", "a10", "a0009b", "a9a", "a", "a" + "9" * 30, "7", "07x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["t"] for r in df.orderBy(T.natural_key("t"), "t").collect()]
    assert got == ["7", "07x", "a", "a9", "a9a", "a0009b", "a10", "a" + "1" * 24 + "0", "a" + "1" * 25, "a" + "9" * 30]


def test_formulas(spark):
    texts = ["见式（10-12）", "y = ax + b（5-1）", "由式(5-1)得 y=1", "（3 － 4）ab1", "", "abcd", "a" * 221]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.looks_like_formula("t").alias("a"), T.formula_expression("t").alias("b"))
    assert [(r["a"], r["b"]) for r in df.collect()] == [(False, False), (True, True), (True, False), (False, False), (False, False), (True, True), (False, False)]


def test_student_text(spark):
    text = " 第一行\r\n  教材依据：第二章\n见 Source_Chunks作为依据\n\n最后 Answer_Cards \n"
    assert spark.createDataFrame([(text,)], "t string").select(R.student_visible(F.col("t"))).first()[0] == "第一行\n\n最后 Answer_Cards"


def test_first_spelling_of_every_term(spark):
    r = random.Random(2)
    words = [r.choice(["Alpha", "alpha", "ALPHA", "beta", "Be-ta", "gamma9", "道路", "缓和曲线"]) for _ in range(60)]
    got = spark.createDataFrame([([" ".join(words)],)], "t array<string>").select(T.terms(F.col("t"), None)).first()[0]
    assert len(got) == len({w.lower().replace("-", "") for w in got})
    first = {}
    for w in words:
        first.setdefault(w.lower().replace("-", ""), w)
    assert got == [w for w in dict.fromkeys(words) if w in got] and all(first[w.lower().replace("-", "")] == w for w in got)


def test_an_emptied_version(spark, tmp_path):
    rows = spark.createDataFrame([("v1", 1), ("v2", 2), ("v 3/x", 3)], "version_id string, n int")
    sinks.replace_version(rows, str(tmp_path / "t"))
    sinks.replace_version(rows.where("n = 2").withColumn("n", F.lit(5)), str(tmp_path / "t"), "v2", "v 3/x")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("version_id", "n").collect()) == [("v1", 1), ("v2", 5)]


def test_report_says_what_it_leaves_out(spark):
    text = sinks.markdown_table(spark.range(7), 5)
    assert text.count("\n") == 8 and text.endswith("2 further rows are not shown.")
    assert "further" not in sinks.markdown_table(spark.range(5), 5)


def test_a_key_of_a_third_of_all_rows(spark):
    left = [("hot" if i % 3 == 0 else f"k{i % 11}", i) for i in range(600)]
    right = [("hot", 1), ("hot", 2), ("k3", 3), ("k99", 4)]
    rows, others = spark.createDataFrame(left, "k string, i int"), spark.createDataFrame(right, "k string, j int")
    got = sorted((r["i"], r["j"]) for r in matching.salted_join(rows, others, ["k"], "i").collect())
    assert got == sorted((i, j) for k, i in left for m, j in right if k == m)


def test_findings_of_an_id_that_repeats_often(spark, monkeypatch):
    monkeypatch.setattr(quality, "STRETCH", 7)
    ids = [None] * 30 + ["a"] * 8 + ["b"] * 9 + ["c", "d", "d"]
    got = [r["object_id"] for r in quality.duplicate_ids(spark.createDataFrame([(x,) for x in ids], "id string"), "id", "twice").collect()]
    assert sorted(got) == [""] * 29 + ["a"] * 7 + ["b"] * 8 + ["d"]


def test_similar_pairs_of_all_sizes(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcde") for _ in range(r.randrange(1, 6))) for _ in range(25)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 40))) for _ in range(120)]

    def grams(text):
        return {f"  {w} "[i : i + 3] for w in text.split() for i in range(len(w) + 1)}

    rows = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    asked = spark.createDataFrame(list(enumerate(texts[::2])), "question_id int, question string")
    want = {}
    for i, t in enumerate(texts):
        for j, q in enumerate(texts[::2]):
            a, b = grams(t), grams(q)
            if a and b and len(a & b) / len(a | b) >= 0.3:
                want[i, j] = len(a & b) / len(a | b)
    for limit in (1_000_000, 0):
        got = {(x["text_id"], x["question_id"]): x["sim"] for x in similar_pairs(rows, asked, 0.3, limit).collect()}
        assert got == want


def test_evidence_lookup_of_all_sizes(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcde") for _ in range(r.randrange(1, 6))) for _ in range(30)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    chunks = [(i, f"s{i % 3 if i % 7 else 0}", say(r.choice([0, 1, 2, 5, 9, 20, 60])), "direct" if i % 11 == 5 else "no_direct_output") for i in range(160)]
    asked = [(j, f"s{j % 4}", say(r.choice([0, 1, 3, 8, 30]))) for j in range(40)]

    def grams(text):
        return {f"  {w} "[i : i + 3] for w in text.split() for i in range(len(w) + 1)}

    want = set()
    for j, section, q in asked:
        b, scores = grams(q), []
        for i, own, t, usable in chunks:
            if own == section and usable == "no_direct_output":
                a = grams(t)
                scores.append((-(len(a & b) / len(a | b) if a | b else 0.0), i))
        want |= {(j, rank, i, round(-s, 9)) for rank, (s, i) in enumerate(sorted(scores)[:4], 1)}
    rows = spark.createDataFrame(chunks, "chunk_id int, section_id string, source_excerpt string, usable_for_answer string")
    found = evidence_lookup(rows, spark.createDataFrame(asked, "question_id int, section_id string, question string"), 4)
    assert {(x.question_id, x["rank"], x.chunk_id, round(x.score, 9)) for x in found.collect()} == want


def test_evidence_profile_and_support(spark):
    rows = spark.createDataFrame([("exact", False), (" partial", True), ("missing", True), (None, None)], "s string, t boolean")
    got = [tuple(r[0])[:2] + (tuple(r[0])[-1],) for r in rows.select(enrich.evidence_profile(F.col("s"), F.col("t"))).collect()]
    assert got == [
        ("direct_text_evidence", "high", False), ("partial_text_evidence", "medium", False),
        ("operation_summary_with_term_support", "medium", False), ("operation_summary_not_verbatim", "low", True),
    ]


def test_formula_occurrences(spark):
    lines = ["前文说明", "V = 3.6 L（5-1）以上", "（5-2）", "S = V t", "当 x = 1 时见式（5-3）", "其中 k 为系数", "a = b", "式中（5－3）ab = cd（5-4）"]
    frame = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, ordinal int, text string")
    got = {(r["ordinal"], r["label_key"]): r["expression"] for r in enrich.formula_occurrences(frame).collect()}
    assert got == {(1, "5-1"): "V = 3.6 L", (2, "5-2"): "S = V t", (4, "5-3"): "a = b", (7, "5-3"): "a = b", (7, "5-4"): "a = b"}
    best = {r["label_key"]: (r["ordinal"], r["occurrences"]) for r in enrich.best_occurrences(enrich.formula_occurrences(frame)).collect()}
    assert best["5-3"] == (4, 2)


def test_drifting_fields(spark):
    rows = spark.createDataFrame([(" ", ["x ", " "], None, "a；b;a"), ("own", None, "z", None)], "alias string, question array<string>, text string, tags string")
    got = rows.select(normalize.first_text_of(rows, "alias", "absent", "question", "text").alias("a"), normalize.list_of(rows, "none", "tags", "question").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [("x", ["a", "b"]), ("own", [])]


def test_promotion_of_a_draft(spark):
    items = spark.createDataFrame([("ch10", "c1", "manual_anchor_required")], "chapter_id string, chunk_id string, review_status string")
    columns = "chapter_id string, chunk_id string, decision string, approved_paragraph_start string, approved_paragraph_end string, reviewer_notes string"
    draft = spark.createDataFrame([("ch10", "c1", "", "1", "2", "n")], columns)
    wrong = spark.createDataFrame([("ch10", "c1", "no such decision", "1", "2", "n")], columns)
    assert review.promotion_blockers(draft, items, False, True, False, False) == ["dry_run"]
    assert review.promotion_blockers(wrong, items, True, False, True, False) == ["not_confirmed", "draft_invalid", "formal_exists"]
    assert review.promotion_blockers(draft, items, True, True, True, True) == []


def test_file_listing(spark, tmp_path):
    for name, text in (("a/x.html", "same"), ("a/b/y.html", "same"), ("z.txt", "other")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = packages.list_files(spark, str(tmp_path), "*.html")
    assert sorted((r["stem"], r["length"]) for r in files.collect()) == [("x", 4), ("y", 4)]
    assert [r["files"] for r in packages.duplicate_files(files).collect()] == [2]


def test_relations_stand_in(spark):
    some, none = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([], "x int")
    other = spark.createDataFrame([(2,)], "x int")
    assert [r["x"] for r in M.relations_if_empty(some, other).collect()] == [1]
    assert [r["x"] for r in M.relations_if_empty(none, other).collect()] == [2]


def test_recommendations_of_equal_cards_form_no_pairs(spark, monkeypatch):
    r, ranked, plain = random.Random(4), [], trigram.top_k
    monkeypatch.setattr(trigram, "top_k", lambda df, *rest: ranked.append(df.count()) or plain(df, *rest))
    points = [["x"], ["x", "x"], ["x", "y"], ["z", "x", "y"], [], None, ["n"]]
    cards = [(f"a{i}", r.choice(points), [f"r{r.randrange(350)}" for _ in range(r.randrange(3))]) for i in range(300)]
    resources = [(f"r{i}", r.choice(points)) for i in range(300)]
    got = trigram.recommend_by_knowledge_points(
        spark.createDataFrame(cards, "answer_id string, related_kps array<string>, recommended_resources array<string>"),
        spark.createDataFrame(resources, "resource_id string, related_kps array<string>"), 3,
    ).select("answer_id", "rank", "resource_id", "score").collect()
    want = []
    for answer_id, wanted, named in cards:
        scores = [(100 * (x in named) + 25 * sum(p in (held or ()) for p in wanted or ()), x) for x, held in resources]
        best = sorted(((s, x) for s, x in scores if s > 0), key=lambda p: (-p[0], p[1]))[:3]
        want += [(answer_id, i + 1, x, s) for i, (s, x) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert max(ranked) < 3_000  # of 90,000 pairs
