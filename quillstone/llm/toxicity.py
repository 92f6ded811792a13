"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Model: for every word the log-odds of occurring in toxic against other training documents, with an informative
Dirichlet prior (its share of all words, ``PRIOR`` words strong, and ``LEAST_PRIOR`` of a word at least).  Words whose log-odds are at least ``LEAST_Z`` standard
errors above zero carry their log-odds; every other word carries a small negative score, the log-odds of a common word
inside a toxic passage of which ``DENSITY`` are toxic words.  A word of the model makes up ``LEAST_SHARE`` of what toxic documents
say at least, so there are never more than its inverse of them and the model is a bounded broadcast without a cap; counts are exact
over all training documents.  Clean documents are only asked about words that
enough toxic ones contain, by a bitmap of fixed size, so most of their words are never shuffled.

Scan: all maximal-scoring segments (linear time; runs of common words between scoring words are one step).  A segment of
score *S* in a text of *n* words has the E-value ``K n exp(-lambda S)`` with lambda from the background distribution;
those of at most ``MOST_E`` are significant.  A document's evidence is the sum of its significant segments'
normalised scores, or its best segment's if none is; a logistic curve fitted over all training documents (a histogram,
not rows) turns it into a score.

Defined results: null and empty texts have the evidence of one word that scores nothing; a document labelled twice
counts as toxic if either label does; null labels are no labels; without labels every score is 0; a null id counts as
an empty one for the fold; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import LETTERS, map_rows, small_batches, stored, word_hashes
from quillstone.llm.language import held_out

PRIOR = 500.0
LEAST_PRIOR = 0.5
LEAST_Z = 3.0
LEAST_TOXIC = 4
#: Least share of a model word among the words of toxic documents (each counted once a document).
LEAST_SHARE = 1 / 200_000
DENSITY = 0.2
MOST_E = 0.01
K = 0.1
BITMAP = 1 << 24
#: Labels up to this many (16 bytes each) travel to every task; more meet the documents by a shuffle.
SMALL_LABELS = 2_000_000


def words(text: str | None) -> np.ndarray:
    """Hashes of the words (runs of letters, case folded) of a text, in order."""
    return word_hashes(text, LETTERS)


def maximal_segments(at: list[int], score: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence whose items at ``at`` score ``score``, others ``gap``.

    Each candidate keeps the sum before it and the sum at its end; a new item joins earlier candidates as long as
    some lower sum before them lets the joint segment win.
    """
    found: list[tuple[int, int, float, float]] = []
    total, last = 0.0, -1
    for position, value in zip(at, score):
        total += gap * (position - last - 1)
        last = position
        start, before = position, total
        total += value
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= before:
                k -= 1
            if k < 0 or found[k][3] >= total:
                break
            start, before = found[k][0], found[k][2]
            del found[k:]
        found.append((start, position, before, total))
    return [(a, b, after - before) for a, b, before, after in found]


class SegmentModel:
    """Words and log-odds (sorted by hash), the common score and lambda."""

    def __init__(self, hashes: np.ndarray, odds: np.ndarray, background: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.odds = hashes[order], odds[order]
        share = min(0.5, float(background.sum()))
        self.gap = math.log((1 - DENSITY) / (1 - min(share, DENSITY / 2)))
        self.rate = self._rate(odds, background, share)

    def _rate(self, odds, background, share) -> float:
        """The positive root of E[exp(rate * score)] = 1 under the background distribution."""
        low, high = 1e-3, 8.0
        value = lambda r: float((background * np.exp(np.minimum(r * odds, 600))).sum()) + (1 - share) * math.exp(r * self.gap) - 1
        if not len(odds) or value(high) < 0:
            return 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if value(middle) > 0 else (middle, high)
        return high

    def passages(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Evidence of a text and its significant passages (first word, last word, score)."""
        tokens = words(text)
        n = max(1, len(tokens))
        floor = -math.log(K * n) if K * n > 1 else 0.0
        if not len(self.hashes) or not len(tokens):
            return floor, []
        place = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[place] == tokens)
        if not hit.size:
            return floor, []
        parts = maximal_segments(hit.tolist(), self.odds[place[hit]].tolist(), self.gap)
        normal = [self.rate * s - math.log(K * n) for _, _, s in parts]
        fine = [p for p, x in zip(parts, normal) if x >= -math.log(MOST_E)]
        return (sum(x for x in normal if x >= -math.log(MOST_E)) if fine else max(normal)), fine


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training documents with their label; texts are not shuffled while the labels are few."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max("toxic").alias("toxic"))
    marks = marks.select("key", (F.col("toxic") > 0).cast("int").alias("toxic"))
    if labels.limit(SMALL_LABELS + 1).count() <= SMALL_LABELS:
        marks = F.broadcast(marks)
    own = docs.filter(~held_out()).select(F.col("doc_id").cast("long").alias("own_id"), "text")
    return own.join(marks, F.col("own_id") == F.col("key")).select("toxic", "text")


def _counts(rows: DataFrame, keep=None) -> DataFrame:
    """``h``, ``n``: in how many texts each word occurs (row 0 of ``h`` null: all such occurrences)."""

    def work(batch: pa.RecordBatch):
        every, total = [], 0
        for text in batch["text"].to_pylist():
            own = np.unique(words(text))
            total += len(own)
            if keep is not None:
                bits = (own & (BITMAP - 1)).astype(np.int64)
                own = own[(keep.value[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1]
            every.append(own)
        h, n = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield [pa.concat_arrays([pa.array(h), pa.array([None], pa.int64())]), np.append(n, total)]

    return map_rows(rows.select("text"), work, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> SegmentModel:
    """Word log-odds from all labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    small_batches(spark)
    known = _labelled(docs, labels)
    toxic = stored(_counts(known.filter("toxic = 1")), "toxic_words").filter(f"h is null or n >= {LEAST_TOXIC}")
    slot = F.col("h").bitwiseAND(F.lit(BITMAP - 1))
    bits = toxic.filter("h is not null").groupBy(F.shiftright(slot, 5).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h & 31 as int))")).alias("b"))
    table = np.zeros(BITMAP // 32, np.uint32)  # two megabytes, whatever the corpus
    for row in bits.toLocalIterator():
        table[row["w"]] = row["b"]
    keep = spark.sparkContext.broadcast(table.view(np.uint8))
    clean = _counts(known.filter("toxic = 0"), keep)
    both = toxic.withColumnRenamed("n", "a").join(clean.select(F.col("h").alias("g"), F.col("n").alias("b")), F.col("h").eqNullSafe(F.col("g")), "left")
    both = stored(both.select("h", "a", F.coalesce("b", F.lit(0)).alias("b")), "both")
    sums = both.filter("h is null").first()
    if sums is None or not sums["a"] or not sums["b"]:
        return SegmentModel(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    n1, n0 = float(sums["a"]), float(sums["b"])
    prior = F.lit(LEAST_PRIOR) + F.lit(PRIOR) * (F.col("a") + F.col("b")) / (n1 + n0)
    up, down = F.col("a") + prior, F.col("b") + prior
    odds = F.log(up) - F.log(n1 + PRIOR - up) - F.log(down) + F.log(n0 + PRIOR - down)
    z = odds / F.sqrt(1 / up + 1 / down)
    best = both.filter(F.col("h").isNotNull() & (F.col("a") >= LEAST_SHARE * n1)).select("h", odds.alias("odds"), z.alias("z"), (down / (n0 + PRIOR)).alias("p")).filter(F.col("z") >= LEAST_Z)
    rows = best.collect()  # 1 / LEAST_SHARE rows at most
    return SegmentModel(np.array([r["h"] for r in rows], np.int64), np.array([r["odds"] for r in rows]), np.array([r["p"] for r in rows]))


RAW = "doc_id bigint, held_out boolean, evidence double, n_passages int, first_word int, last_word int"


def _evidence(docs: DataFrame, model: SegmentModel) -> DataFrame:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")

    def work(batch: pa.RecordBatch):
        found = [shared.value.passages(t) for t in batch["text"].to_pylist()]
        best = [max(p, key=lambda x: x[2], default=(None, None, 0)) for _, p in found]
        yield [batch["doc_id"].cast(pa.int64()), batch["held_out"], [e for e, _ in found], [len(p) for _, p in found], [b[0] for b in best], [b[1] for b in best]]

    return map_rows(rows, work, RAW)


def fit_curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve over (evidence, label, count)."""
    x, y, n = (np.array(c, float) for c in zip(*bins))
    p = (n * y).sum() / n.sum()
    w = np.array([0.0, math.log((p + 1e-6) / (1 - p + 1e-6))])
    design = np.stack([x, np.ones_like(x)], 1)
    ridge = np.diag([1e-3, 1e-6]) * n.sum() ** 0.5
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (n * q * (1 - q))[:, None]).T @ design + ridge + 1e-9 * np.eye(2), design.T @ (n * (y - q)) - ridge @ w * np.array([1, 0]))
        w = w + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and the significant passages' number and best word range."""
    model = fit_toxicity(docs, labels)
    raw = stored(_evidence(docs, model), "evidence")
    marks = labels.filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max("toxic").alias("toxic"))
    known = raw.filter("not held_out").join(marks, F.col("doc_id") == F.col("key"))
    # what is significant anyway counts on a logarithmic scale, so that a few wrong labels do not flatten the curve
    sure = -math.log(MOST_E)
    eased = F.greatest(F.when(F.col("evidence") > sure, sure + F.log1p(F.col("evidence") - sure)).otherwise(F.col("evidence")), F.lit(-25.0))
    raw, known = raw.withColumn("eased", eased), known.withColumn("eased", eased)
    step = F.round(F.col("eased") * 8) / 8
    bins = known.groupBy(step.alias("x"), (F.col("toxic") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()  # a few hundred rows
    score = F.lit(0.0)
    if bins:
        slope, offset = fit_curve([tuple(r) for r in bins])
        score = 1 / (1 + F.exp(-(F.col("eased") * slope + offset)))
    out = raw.withColumn("score", score)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "first_word", "last_word")
