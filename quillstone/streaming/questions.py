"""A stream of questions answered micro-batch by micro-batch with the batch plan (extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.operators.keyword import keyword_scores


def answer_stream(
    questions: DataFrame, cards: DataFrame, synonyms: DataFrame, rag: DataFrame, output: str, checkpoint: str, top: int = 5
) -> StreamingQuery:
    """Ranked hits of every micro-batch as Parquet, one folder per batch.

    A repeated batch overwrites its own folder, so a restart does not duplicate answers.
    """

    def answer(batch: DataFrame, number: int) -> None:
        hits = keyword_scores(batch, cards, synonyms, rag, top)
        hits.withColumn("answered_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return (
        questions.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
