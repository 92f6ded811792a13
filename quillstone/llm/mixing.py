"""Mixing sources to target weights by capped water-filling.

A source may not be repeated more than ``max_epochs`` times; what a capped source cannot take is shared out again in
proportion to the weights, until no source is above its cap.  The fixed point has a closed form: with the sources
ordered by cap / weight, the first *k* are capped and the rest share what is left, so one ordered pass over the
sources (not the documents) finds it.

Sampling: a document gets ``floor(target / source_size)`` whole copies, and one more if its seeded hash lies below its
source's threshold.  The threshold is read from a histogram of words over ``BINS`` hash ranges, so the words taken come
near the target without sorting documents; a source's error is at most about one bin or one document.  The hash is
a function of seed and document id: reruns agree, on any partitioning.

Defined results: null and empty texts have size 0 and take 0 words; a null source is a source of its own, ordered last;
null ids hash like an empty id; repeated ids are sampled alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm.common import seeded, stored

BINS = 1024
HASHES = 1 << 48
#: A source's name and four numbers; below this many sources the table is small enough to travel to every task.
SMALL_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space, without building them."""
    trimmed = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.coalesce(F.length(F.regexp_replace(trimmed, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source (``source``, ``source_size``).

    ``weights`` repeat over the sources in code-point order, null last.  Only sources with words take part.
    """
    everything = W.partitionBy()
    ordered = sizes.withColumn("n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    ordered = ordered.withColumn("weight", F.when(F.col("source_size") > 0, weight).otherwise(0.0))
    ordered = ordered.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    ordered = ordered.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    # in this order: what is left for a source and all after it, per unit of weight
    fill = W.orderBy(F.col("ratio").asc_nulls_last(), "n")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    leveled = ordered.withColumn("level", F.when(F.col("weight") > 0, F.greatest(left, F.lit(0.0)) / F.sum("weight").over(after)))
    # the first source whose cap is above the level ends the filling; its level holds for all that follow
    final = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "n", "level"))).over(everything)["level"]
    target = F.when(F.col("weight") == 0, 0.0).when(final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight")))
    return leveled.select("source", "source_size", target.alias("target"))


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, keep: tuple[str, ...] = (),
    with_source: bool = False,
) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` of every document.

    ``keep`` names further columns of ``docs`` to carry along.
    """
    key = seeded(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed).alias("hash")
    counted = [F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), key]
    base = stored(docs.select(*counted), "sizes")  # texts are counted once; what follows reads a few bytes per document
    bins = base.groupBy("source", F.floor(F.col("hash") / F.lit(HASHES // BINS)).alias("bin")).agg(F.sum("size").alias("words"))
    sums = bins.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(sums, weights, share, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    run = W.partitionBy("source").orderBy("bin")
    steps = bins.withColumn("upto", F.sum("words").over(run)).withColumnRenamed("source", "bin_source")
    steps = steps.join(plan, F.col("bin_source").eqNullSafe(F.col("source"))).filter(F.col("upto") > F.col("rest"))
    crossing = steps.groupBy("source").agg(F.min(F.struct("bin", "upto", "words")).alias("s"))
    width = HASHES // BINS
    part = (F.col("rest") - (F.col("s.upto") - F.col("s.words"))) / F.col("s.words")
    crossing = crossing.withColumnRenamed("source", "cross_source")
    plan = plan.join(crossing, F.col("source").eqNullSafe(F.col("cross_source")), "left")
    below = F.coalesce((F.col("s.bin") * width + F.floor(part * width)).cast("long"), F.lit(HASHES))
    plan = plan.select(F.col("source").alias("plan_source"), "source_size", "target", "whole", "rest", below.alias("below"))
    plan = plan.withColumn("below", F.when(F.col("rest") > 0, F.col("below")).otherwise(0))
    if plan.limit(SMALL_SOURCES + 1).count() <= SMALL_SOURCES:
        plan = F.broadcast(plan)
    rows = docs.select(*counted, *keep) if keep else base
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "left")
    copies = (F.col("whole") + (F.col("hash") < F.col("below")).cast("long")).cast("long")
    source = ("source",) if with_source else ()
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *source, *keep)
