"""Normalisers of drifting packages against a model in plain Python."""

import json
import random
import re

from quillstone.operators import drift as D


def dedupe(items):
    return list(dict.fromkeys(x for x in (str(i).strip() for i in items) if x))


def split(value):
    if value is None:
        return []
    if isinstance(value, list):
        return dedupe(p for item in value for p in split(item))
    if isinstance(value, dict):
        return [json.dumps(value, ensure_ascii=False, separators=(",", ":"))]
    return dedupe(p for p in re.split(r"[；;\n|]", str(value)))


def points(row):
    checks = split(row.get("must_check")) or split(row.get("must_include"))
    steps = split(row.get("operation_steps"))
    own = steps if row.get("question_type") == "operation_steps" and steps else split(row.get("answer_points")) or steps
    return dedupe([*own, *checks])


def card(row, task):
    p, must = points(row), split(row.get("must_check"))
    parts = [f"{k}：{task.get(n)}" for k, n in (("操作目标", "task_goal"), ("前置条件", "prerequisite"), ("预期结果", "output_result"))] if task else []
    parts += ["操作要点：" + "；".join(p)] if p else []
    parts += ["结果检查：" + "；".join(must)] if must else []
    concise = f"{task.get('task_name')}的目标是：{task.get('task_goal')}" if task else "；".join(p[:3])
    return {
        "answer_id": row["answer_id"], "answer_mode": "step" if row.get("answer_mode") == "steps" else row.get("answer_mode") or "",
        "related_kps": split(row.get("related_kps")) or split(task.get("related_kps") if task else None), "answer_points": p,
        "must_include": split(row.get("must_check")) or split(row.get("must_include")), "evidence_chunks": split(row.get("evidence_chunks")),
        "concise_answer": row.get("concise_answer", concise), "expanded_answer": row.get("expanded_answer", "\n".join(parts)),
    }


def test_cards_and_cases_of_all_types(spark):
    r = random.Random(2)
    shapes = [None, "", "a；b;c\nd|a", "one", ["x", "y;z", " x "], [], {"k": 1, "t": "é"}, [["p;q", "r"], {"n": None}], 7, ["é", 3, None], "  "]
    fields = ("operation_steps", "answer_points", "must_check", "must_include", "related_kps", "evidence_chunks", "student_question_patterns")
    packages = {}
    for chapter in ("ch1", "ch2"):
        tasks = [{"task_id": f"t{i}", "task_name": f"n{i}", "task_goal": "g", "prerequisite": "p", "output_result": "o", "related_kps": r.choice(shapes)} for i in (0, 1, 1)] + ["no object"]
        cards = []
        for i in range(60):
            row = {"answer_id": f"a{i}", "question_type": r.choice(["operation_steps", "why"]), "answer_mode": r.choice(["steps", "bullet"]), "related_task": r.choice([None, "t0", "t1", "t9"])}
            row |= {f: r.choice(shapes) for f in fields if r.random() < 0.8}
            if i % 10 == 3:
                row |= {"concise_answer": "own", "expanded_answer": "own too"}
            cards.append(row)
        cases = [{"eval_id": "e1", "must_hit": "a5", "must_not_include": "u|v"}, {"test_id": "e2", "expected_answer_card": "a6", "must_include": ["m"], "pass_rule": "r"}, {"test_id": "e3"}]
        packages[chapter] = {"Operation_Tasks": tasks, "Answer_Cards": cards, "QA_Evaluation_Testset": cases, "Odd": {"not": "a list"}}
    df = spark.createDataFrame([(c, json.dumps(p, ensure_ascii=False)) for c, p in packages.items()] + [("bad", "{oops"), ("none", "{}")], "chapter_id string, json string")
    assert D.variant_table(df, "Odd").count() == 0 == D.variant_table(df, "Nothing").count()
    cards = D.normalize_cards(D.variant_table(df, "Answer_Cards"), D.variant_table(df, "Operation_Tasks"))
    got = {(x["chapter_id"], x["answer_id"]): x for x in cards.collect()}
    assert len(got) == 120
    want = {}
    for chapter, package in packages.items():
        tasks = {t["task_id"]: t for t in package["Operation_Tasks"] if isinstance(t, dict)}
        for row in package["Answer_Cards"]:
            want[chapter, row["answer_id"]] = card(row, tasks.get(row["related_task"] or ""))
    for key, expected in want.items():
        assert {k: got[key][k] for k in expected} == expected, key
        assert got[key]["recommended_resources"] == []
    tests = {(x["chapter_id"], x["test_id"]): x for x in D.normalize_cases(D.variant_table(df, "QA_Evaluation_Testset"), cards).collect()}
    for chapter in packages:
        one, two, three = (tests[chapter, f"e{i}"] for i in (1, 2, 3))
        assert one["expected_kps"] == want[chapter, "a5"]["related_kps"] and one["should_not_include"] == ["u", "v"]
        assert one["expected_answer_points"] == want[chapter, "a5"]["must_include"] and two["expected_answer_points"] == ["m"]
        assert (two["required_response_mode"], two["pass_rule"]) == (want[chapter, "a6"]["answer_mode"], "r")
        assert (three["expected_answer_card"], three["required_response_mode"], three["pass_rule"]) == ("", "bullet", "top1_answer_and_point_coverage")


def test_other_tables(spark):
    package = {
        "Source_Chunks": [
            {"chunk_id": "c1", "source_excerpt": "<w:p>left  <w:t/>right</w:p>", "summary": "s", "keywords": "a;b"}, {"chunk_id": "c2", "source_excerpt": "</w:", "chunk_summary": "<w:"},
            {"chunk_id": "c3", "source_excerpt": "plain <b>", "status": "draft", "keywords": ["k"]},
        ],
        "Knowledge_Points": [{"kp_id": "k1", "definition": "d", "engineering_meaning": "m", "evidence_chunks": ["c1", "c2"], "student_question_patterns": list("abcdef")}, {"kp_id": 2, "key_points": "x;y", "source_hint": "h"}],
        "RAG_Config": [{"object_id": "a", "object_type": "answer_card", "retrieval_priority": "High", "embedding_text": "t"}, {"object_id": "b", "retrieval_priority": 30}, {"object_id": "c", "index_text": "i"}],
        "Embedding_Corpus": [{"embedding_id": "e", "object_type": "k", "object_id": "o", "text_for_embedding": "t"}, {"embedding_id": "f", "source_type": "s", "source_id": 5, "embedding_text": "u"}],
    }
    df = spark.createDataFrame([("ch1", json.dumps(package))], "chapter_id string, json string")
    chunks = {x["chunk_id"]: x for x in D.normalize_chunks(D.variant_table(df, "Source_Chunks")).collect()}
    assert (chunks["c1"]["source_excerpt"], chunks["c1"]["summary"], chunks["c1"]["keywords"], chunks["c1"]["repaired"]) == ("left right", "s", ["a", "b"], True)
    assert chunks["c2"]["source_excerpt"] == chunks["c2"]["summary"] == D.NEEDS_REVIEW
    assert (chunks["c3"]["source_excerpt"], chunks["c3"]["review_status"], chunks["c3"]["repaired"]) == ("plain <b>", "draft", False)
    kps = {x["kp_id"]: x for x in D.normalize_points(D.variant_table(df, "Knowledge_Points")).collect()}
    assert (kps["k1"]["key_points"], kps["k1"]["aliases"], kps["k1"]["source_hint"]) == (["d", "m"], list("abcd"), "c1;c2")
    assert (kps["2"]["key_points"], kps["2"]["source_hint"]) == (["x", "y"], "h")
    rag = {x["object_id"]: tuple(x)[2:] for x in D.normalize_rag(D.variant_table(df, "RAG_Config")).collect()}
    assert rag == {"a": ("answer_card", 100, "t", True), "b": ("", 30, "", False), "c": ("", 50, "i", False)}
    emb = {tuple(x)[1:] for x in D.normalize_embeddings(D.variant_table(df, "Embedding_Corpus")).collect()}
    assert emb == {("e", "k", "o", "t"), ("f", "s", "5", "u")}
