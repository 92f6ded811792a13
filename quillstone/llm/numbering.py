"""Exact places of rows within their groups, however large a group is: one range shuffle of narrow rows, no window over a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm.common import stored

#: A row per sorted part and group that it holds (about 60 bytes); up to this many travel to every task, more meet the rows by a shuffle.
SMALL_PARTS = 100_000


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` (computed once, then stored) and ``number``: the row's place from 0 within its ``group``, in ``order``.

    Rows are range partitioned by group and order and sorted within each part, so every part but the first of a group
    only needs to know how many of the group's rows the parts before it hold.  Rows that are equal in ``order`` are
    told apart by an arbitrary id, so not even a third of all rows that are equal lands in one part.  ``group`` holds no nulls.
    """
    placed = stored(rows.withColumn("place_", F.monotonically_increasing_id()), "placed")
    keys = [F.col(group).asc(), *order, F.col("place_").asc()]
    # the id's upper bits are the part (parts follow one another in key order), its lower bits the place in it
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("place_")
    ordered = stored(ordered.withColumn("at_", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("part_", F.shiftright("at_", 33))
    parts = ordered.groupBy("part_", F.col(group).alias("group_")).agg(F.min("at_").alias("from_"), F.count(F.lit(1)).alias("n_"))
    before = W.partitionBy("group_").orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    parts = stored(parts.select(F.col("part_").alias("p_"), "group_", (F.coalesce(F.sum("n_").over(before), F.lit(0)) - F.col("from_")).alias("shift_")), "parts")
    if parts.limit(SMALL_PARTS + 1).count() <= SMALL_PARTS:
        parts = F.broadcast(parts)
    joined = ordered.join(parts, (F.col("part_") == F.col("p_")) & (F.col(group) == F.col("group_")))
    return joined.select(*[c for c in rows.columns], (F.col("at_") + F.col("shift_")).alias("number"))
