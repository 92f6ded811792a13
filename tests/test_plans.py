import pytest
from pyspark.sql import functions as F

import test_retrieval
from quillstone.operators.keyword import keyword_scores
from quillstone.plans.registry import load
from quillstone.streaming.questions import answer_stream

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["ret_01_keyword_search", "sql_01_card_first_search", "sql_03_resource_recommendation", "ret_07_resource_search"])
def test_no_nested_loops(spark, name):
    plan = load()[0][name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "WindowGroupLimit" in plan


def test_every_query_has_a_stable_name_and_sql():
    queries, oracle = load()
    assert set(oracle) <= set(queries)
    assert len(set(queries) - set(oracle)) <= 6


def test_question_stream_equals_the_batch(spark, tmp_path):
    cards, questions, synonyms, rag = test_retrieval.fixture(20, 6)
    c, s = spark.createDataFrame(cards, test_retrieval.CARD), spark.createDataFrame(synonyms, test_retrieval.SYN)
    r = spark.createDataFrame(rag, test_retrieval.RAG)
    q = spark.createDataFrame(questions, "question_id string, question string")
    q.coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("question_id string, question string").json(f"{tmp_path}/in")
    answer_stream(stream, c, s, r, f"{tmp_path}/out", f"{tmp_path}/ck", 3).awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").select("question_id", "answer_id", "score").collect()
    want = keyword_scores(q, c, s, r, 3).select("question_id", "answer_id", F.col("score")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
