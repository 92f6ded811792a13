"""Rankings must not make a row for every pair of rows that share a key."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstone.operators import align, blocks, hybrid, keyword, matching, merge, operations, resources, trigram
from plan_rows import rows_out


def test_equal_questions_do_not_meet_equal_cards_in_pairs(spark):
    nothing = F.array().cast("array<string>")
    cards = spark.range(200).select(
        F.col("id").alias("ordinal"), F.concat(F.lit("a"), "id").alias("answer_id"), F.lit("c").alias("chapter_id"),
        F.lit("What is it?").alias("canonical_question"), nothing.alias("student_question_patterns"),
    )
    asked = spark.range(300).select(F.concat(F.lit("q"), "id").alias("question_id"), F.lit("what is it").alias("question"))
    none = spark.createDataFrame([], "question_id string, answer_id string, rank int, score double, reasons array<string>")
    rows, most = rows_out(hybrid.direct_override(asked, none, hybrid.direct_matches(cards)), ["Join"])
    assert len(rows) == 300 and {(r.answer_id, r.score) for r in rows} == {("a0", 340.0)}
    assert most <= 300


def test_shared_tokens_make_no_row_per_pair(spark):
    """300 cards and 50 questions of the same 20 words, whose pairs lie beyond a block's best; a priority that takes points away included."""
    words, turned = (" ".join(f"w{i}x" for i in order) for order in (range(20), range(19, -1, -1)))
    cards = spark.range(300).select(
        F.col("id").alias("ordinal"), F.concat(F.lit("a"), "id").alias("answer_id"), F.concat(F.lit(f"{words} c"), "id").alias("canonical_question"),
        F.array(F.lit(f"{words} p")).alias("student_question_patterns"), F.array(F.lit(words)).alias("answer_points"),
        F.array().cast("array<string>").alias("must_include"),
    )
    rag = spark.createDataFrame([(0, "a7", 100, "", True)], "ordinal long, object_id string, retrieval_priority long, index_text string, primary_output boolean")
    asked = spark.range(50).select(F.concat(F.lit("q"), "id").alias("question_id"), F.concat(F.lit("n"), "id", F.lit(f" z {turned}")).alias("question"))
    synonyms = spark.createDataFrame([(0, "a0", "", f"n3 z {turned}", "-60")], "ordinal long, target_id string, standard_id string, alias_or_question string, priority string")
    rows, most = rows_out(keyword.keyword_scores(asked, cards, synonyms, rag, 2).select("question_id", "rank", "answer_id", "score"), ["Join"])
    best = {}
    for r in rows:
        best.setdefault(r.question_id, {})[r["rank"]] = (r.answer_id, r.score)
    assert best.pop("q3") == {1: ("a7", 105.0), 2: ("a1", 90.0)}
    assert len(best) == 49 and all(x == {1: ("a7", 105.0), 2: ("a0", 90.0)} for x in best.values())
    assert most < 300 * 50


def test_block_counts_and_ranking_equal_brute_force():
    rnd = random.Random(5)
    texts = [[f"t{int(rnd.paretovariate(0.6))}" for _ in range(rnd.randint(0, 30))] for _ in range(700)]
    texts = [sorted(set(t)) for t in texts]
    cards, asked = texts[:600], texts[600:]
    vocabulary = pa.array(sorted({w for t in asked for w in t}))
    c, q = (blocks.Tokens(pa.chunked_array([pa.array(x, pa.list_(pa.string()))]), vocabulary) for x in (cards, asked))
    want = np.array([[len(set(a) & set(b)) for b in asked] for a in cards])
    ids = np.arange(600), np.arange(100)
    assert (blocks.shared_counts(c.of(ids[0]), 600, q.of(ids[1]), 100, len(vocabulary)) == want).all()
    config = np.array([rnd.choice([0.0, 0.3, 5.0]) for _ in cards])
    parts = lambda x, y: (np.zeros((len(x), len(y))), np.zeros((len(x), len(y))), np.broadcast_to(config[x][:, None], (len(x), len(y))))
    got = blocks.best_pairs(c, c, q, len(vocabulary), ids[0], parts, config, (6.0, 24.0, 1.5, 6.0), 4)
    score = np.minimum(24, 6.0 * want) + np.minimum(6, 1.5 * want) + config[:, None]
    found = {}
    for card, question, focused, body in zip(*got):
        assert focused == body == want[card, question]
        found.setdefault(question, set()).add(card)
    for j in range(100):
        best = [i for i in sorted(range(600), key=lambda i: (-score[i, j], i)) if score[i, j] > 0][:4]
        assert found.get(j, set()) == set(best)


def test_recommendations_make_no_row_per_pair(spark):
    """Against brute force: named and suppressed resources, cards that share no point, and ranks that ties leave to the order."""
    rnd = random.Random(9)
    word = lambda n: " ".join(f"w{rnd.randint(1, 40)}" for _ in range(n))
    point = lambda: [f"k{rnd.randint(1, 6)}" for _ in range(rnd.randint(0, 2))]
    cards = [(f"a{i}", word(rnd.randint(0, 25)), [word(3)], [], point(), [f"r{i}"] if i % 3 else []) for i in range(120)]
    rows = [(f"r{j}", j, word(rnd.randint(1, 20)), "", [word(2)], point(), rnd.choice(["bound", "x"]), j % 4 == 0) for j in range(150)]
    c = spark.createDataFrame(
        cards, "answer_id string, canonical_question string, answer_points array<string>, must_include array<string>, related_kps array<string>, recommended_resources array<string>"
    )
    r = spark.createDataFrame(
        rows, "resource_id string, ordinal long, title string, description string, keywords array<string>, related_kps array<string>, status string, suppress_recommendation boolean"
    )
    found, most = rows_out(resources.recommend_resources(c, r, 3), ["Join"])
    want = set()
    for a, question, listed, _, kps, named in cards:
        scored = []
        for rid, ordinal, title, _, keywords, points, status, hidden in rows:
            shared = len(set(f"{question} {listed[0]}".split()) & set(f"{title} {keywords[0]}".split()))
            score = 100 * (rid in named) + 25 * len(set(kps) & set(points)) + min(30, 3 * shared) + 5 * (status == "bound")
            if score > 0 and (not hidden or rid in named):
                scored.append((-score, ordinal, rid))
        want |= {(a, n, rid, float(-score)) for n, (score, _, rid) in enumerate(sorted(scored)[:3], 1)}
    assert {tuple(x) for x in found} == want
    assert most <= 120


def test_recommended_by_points_only_gives_pairs_out(spark):
    """Cards and resources of one knowledge point: the result has all pairs, but none is shuffled; own resources move the ranks."""
    cards = spark.range(60).select(
        F.concat(F.lit("a"), "id").alias("answer_id"), F.array(F.lit("k"), F.when(F.col("id") % 2 == 0, F.lit("z"))).alias("related_kps"),
        F.when(F.col("id") < 50, F.array(F.concat(F.lit("r"), F.col("id") % 40), F.lit("x"))).alias("recommended_resources"),
    )
    offered = spark.range(80).select(
        (F.col("id") * 1000 % 77).alias("ordinal"), F.concat(F.lit("r"), "id").alias("resource_id"), F.lit("interactive_html").alias("resource_type"),
        F.array(F.when(F.col("id") % 8 == 0, F.lit("z")).otherwise(F.lit("k")), F.lit("k")).alias("related_kps"),
    )
    found = merge.recommended_by_points(cards, offered, at_once=7)
    rows, most = rows_out(found, ["Exchange"])
    got, want = {}, {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.answer_id, []).append((r["rank"], r.resource_id))
    order = [f"r{i}" for i in sorted(range(80), key=lambda i: (i * 1000 % 77, f"r{i}"))]
    for i in range(60):
        own = [f"r{i % 40}", "x"] if i < 50 else []
        want[f"a{i}"] = list(enumerate(own + [r for r in order if r not in own], 1))
    assert got == want
    assert most < 60 * 80 / 2


def test_needles_of_a_group_are_found_without_a_row_per_pair(spark):
    """Against brute force: needles of every length class, blocks of both sides, and one needle that all texts hold."""
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abé") for _ in range(n))
    texts = [(i, rnd.choice(["x", "y", "z", None]), word(rnd.randint(0, 90)) + "qq" + word(20)) for i in range(400)]
    pins = [("x", "qq"), ("y", "qq"), (None, "a"), ("w", "a"), ("x", "")]
    for _ in range(400):
        text = rnd.choice(texts)[2]
        size, at = rnd.choice([1, 2, 3, 4, 5, 8, 9, 14, 15, 30, 31, 60]), rnd.randrange(len(text))
        pins.append((rnd.choice("xyz"), text[at : at + size] if rnd.random() < 0.7 else word(size)))
    hay = spark.createDataFrame(texts, "id long, g string, t string")
    needles = spark.createDataFrame(pins, "g string, n string")
    want = {(g, n) for g, n in pins if g and n and any(g == h and n in t for _, h, t in texts)}
    for sizes in ((matching.HAYSTACK_BYTES, matching.NEEDLE_BYTES), ((1, 4000), 900)):
        rows, most = rows_out(matching.held_in_group(hay, "id", "t", needles, "n", "g", None, *sizes), ["Join", "ArrowPython", "InArrow", "CoGroup"])
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    chunks = spark.createDataFrame([(1, "c", "qq")], "chunk_id long, chapter_id string, excerpt string")
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("c").alias("chapter_id"), F.concat(F.lit("QQ s "), "id").alias("text"))
    rows, most = rows_out(align.alignment_status(chunks, docs, F.array(F.lit("s"), F.lit("q s"))), ["Join"])
    assert [tuple(r) for r in rows] == [(1, "exact")]
    asked = spark.createDataFrame([("k", "i", "c", ["no such", "q s"])], "kind string, item_id string, chapter_id string, terms array<string>")
    rows, few = rows_out(align.term_hits(asked, docs), ["Generate", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin"])
    assert [tuple(r) for r in rows] == [("k", "i", True, "q s")]
    assert few <= 500  # a row per document, none per gram of its text


def test_texts_that_share_trigrams_make_no_row_per_pair(spark):
    """Texts and questions of common words: a row for a similar pair only, and a request's best ``k`` of a task."""
    rnd = random.Random(4)
    words = [f"w{i}x" for i in range(60)]
    say = lambda n: " ".join(rnd.sample(words, n))
    texts = [(i, say(rnd.randint(1, 40)) if i % 9 else "") for i in range(300)]
    asked = [(i, say(rnd.randint(1, 12))) for i in range(59)] + [(59, "")]
    grams = lambda text: {f"  {w} "[i : i + 3] for w in text.split() for i in range(len(w) + 1)}
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    scores = {(i, j): share(grams(t), grams(q)) for i, t in texts for j, q in asked}
    t, q = spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(asked, "question_id long, question string")
    want = {pair: s for pair, s in scores.items() if s >= 0.3}
    for limit in (1_000_000, 400):
        rows, most = rows_out(trigram.similar_pairs(t, q, 0.3, limit), ["Join", "CoGroup"])
        assert {(r.text_id, r.question_id): r.sim for r in rows} == want
        assert most < len(texts) * 10
    chunks = t.select(F.col("text_id").alias("chunk_id"), F.lit("s").alias("section_id"), F.col("text").alias("source_excerpt"), F.lit("no_direct_output").alias("usable_for_answer"))
    rows, most = rows_out(trigram.evidence_lookup(chunks, q.withColumn("section_id", F.lit("s")), 3), ["Join", "CoGroup"])
    best = {(j, n, i) for j, _ in asked for n, (_, i) in enumerate(sorted((-scores[i, j], i) for i, _ in texts)[:3], 1)}
    assert {(r.question_id, r["rank"], r.chunk_id) for r in rows} == best
    assert most < len(texts) * 10


def test_tasks_that_only_share_tokens_make_no_row(spark):
    """Against brute force; equal questions and equal names are searched once, and shared tokens alone (75 points) make no pair."""
    rnd = random.Random(7)
    say = lambda n: " ".join(rnd.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(n))
    asked = [(f"q{i}", rnd.choice(["step ", "fix ", ""]) + say(rnd.randint(1, 6))) for i in range(150)] + [("q150", "step aa-bb"), ("q151", "step aa bb")]
    tasks = [(f"t{i}", 1000 - i, rnd.choice(["", "?", say(1), say(3), "step " + say(7)]), rnd.choice(["", "!", "zz", say(2)])) for i in range(200)]
    words = operations.OperationWords(("fix",), ("check",), ("step",))
    q, t = spark.createDataFrame(asked, "question_id string, question string"), spark.createDataFrame(tasks, "task_id string, ordinal long, task_name string, task_goal string")
    rows, most = rows_out(operations.match_tasks(q, t, words), ["Join"])
    plain = lambda text: "".join(c for c in text if c.isalnum() or c == "-")
    want = set()
    for i, text in asked:
        scored = []
        for task, ordinal, name, goal in tasks:
            points = 140 if plain(name) and plain(name) in plain(text) else 100 if name and plain(text) in plain(name) else 0
            scored.append((-points - 15 * (plain(goal) != "" and bool(set(goal.split()) & set(text.split()))), ordinal, task))
        score, _, task = min(scored)
        if text.split()[0] in ("step", "fix") and -score >= 80:
            want.add((i, task, float(-score)))
    assert {(r.question_id, r.task_id, r.score) for r in rows} == want
    many = spark.range(300)
    q = many.select(F.concat(F.lit("q"), "id").alias("question_id"), F.concat(F.lit("step aa bb c"), "id").alias("question"))
    t = many.select(F.concat(F.lit("t"), "id").alias("task_id"), F.col("id").alias("ordinal"), F.concat(F.lit("bb aa d"), "id").alias("task_name"), F.lit("aa cc").alias("task_goal"))
    rows, most = rows_out(operations.match_tasks(q, t, words), ["Join"])
    assert rows == [] and most < 300 * 300 / 4


def test_texts_that_hold_a_term_are_counted_without_a_row_each(spark):
    texts = spark.range(600).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), F.col("id").cast("string").alias("doc_id"), F.concat(F.lit("The One "), "id").alias("text"))
    terms = spark.createDataFrame([("the",), ("The",), ("one 59",), ("none",)], "term string")
    rows, most = rows_out(align.term_matrix(terms, texts), ["Join", "Generate"])
    want = {("one 59", k): sum(str(i).startswith("59") and (i % 3 == 0) == (k == "a") for i in range(600)) for k in "ab"}
    assert {(r.term, r.kind): r.hits for r in rows} == {**{(x, k): n for x in ("the", "The") for k, n in (("a", 200), ("b", 400))}, **want}
    assert most <= 600
    known = texts.select("doc_id", "text")
    rows, most = rows_out(align.frequent_terms(known.union(known.limit(5).select("doc_id", F.lit("rare rare"))), known, "[A-Za-z]{3,}"), ["CoGroup", "SortMergeJoin", "ShuffledHashJoin"])
    assert [tuple(r) for r in rows] == [("rare", 10)]
    assert most <= 600
