"""Ranking helpers (WIN-01, WIN-02, WIN-04, WIN-06, SRT-xx)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.

    Spark prunes to ``k`` rows per key on both sides of the shuffle, so a key
    that holds a third of all rows costs one sort per task and ``k`` rows each.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def numbered(df: DataFrame, keys: list[str], bucket: list[Column], order: list[Column], name: str) -> DataFrame:
    """Row number per key in the order ``bucket``, then ``order``, without sorting a whole key in one task.

    ``bucket`` must be coarser than the order it opens: rows are numbered inside (key, bucket) and shifted by the rows of
    the key's earlier buckets, which are counted first.
    """
    parts = {f"_b{i}": c for i, c in enumerate(bucket)}
    rows = df.withColumns(parts)
    counts = rows.groupBy(*keys, *parts).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    other = shifts.select(*[F.col(c).alias(f"_o_{c}") for c in shifts.columns])
    same = F.lit(True)
    for c in (*keys, *parts):
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    local = F.row_number().over(Window.partitionBy(*keys, *parts).orderBy(*order))
    joined = rows.withColumn("_local", local).join(other, same)
    return joined.withColumn(name, F.col("_local") + F.col("_o__shift")).select(*df.columns, name)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """WIN-06: the first row of every key."""
    return top_k(df, keys, order, 1, "_first").drop("_first")


def last_wins(df: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """JOI-06 build side: the last row of every key; combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), F.col(ordinal)).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in others])
    )


def margin(df: DataFrame, key: str, score: str, order: list[Column]) -> DataFrame:
    """WIN-02: best score and its distance to the second best (0 when alone)."""
    best = top_k(df, [key], order, 2, "_rank")
    return best.groupBy(key).agg(
        F.max(F.when(F.col("_rank") == 1, F.col(score))).alias("best_score"),
        (
            F.max(F.when(F.col("_rank") == 1, F.col(score)))
            - F.coalesce(F.max(F.when(F.col("_rank") == 2, F.col(score))), F.lit(0.0))
        ).alias("score_margin"),
    )
