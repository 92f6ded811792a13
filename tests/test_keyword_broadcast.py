"""What keyword retrieval sends to the driver and to every task."""

from pyspark.sql import functions as F

from quillstone.operators import keyword


def test_questions_are_not_broadcast_once_per_key(spark, monkeypatch):
    seen = []
    original = keyword.posting_join

    def watched(rows, postings, *others):
        seen.append((set(postings.columns), others[-1]))
        return original(rows, postings, *others)

    monkeypatch.setattr(keyword, "posting_join", watched)
    listed = F.array(F.lit("alpha beta"))
    cards = spark.range(3).select(
        F.col("id").alias("ordinal"), F.concat(F.lit("a"), "id").alias("answer_id"), F.lit("alpha beta gamma").alias("canonical_question"),
        listed.alias("student_question_patterns"), listed.alias("answer_points"), listed.alias("must_include"),
    )
    synonyms = spark.createDataFrame([], "ordinal long, target_id string, standard_id string, alias_or_question string, priority string")
    rag = spark.createDataFrame([], "ordinal long, object_id string, retrieval_priority long, index_text string, primary_output boolean")
    questions = spark.createDataFrame([("q", "alpha beta gamma"), ("p", "beta")], "question_id string, question string")

    def best():
        return keyword.keyword_scores(questions, cards, synonyms, rag, 2).orderBy("question_id", "rank").collect()

    few = best()
    assert len(few) == 4 and all("q_norm" not in columns and small for columns, small in seen)
    monkeypatch.setattr(keyword, "BROADCAST_BYTES", 100)
    seen.clear()
    assert best() == few and not any(small for _, small in seen)
