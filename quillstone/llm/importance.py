"""Importance resampling towards a target corpus: hashed n-gram counts by batch concatenation, Gumbel top-k.

*Features* of a text are its runs of one to ``ORDER`` consecutive words, hashed to ``BUCKETS`` by CRC-32.  The texts of an
Arrow batch are joined by a sentinel byte that no word holds; one regular expression pass over the joined bytes finds
the words of all of them.  The document of a word is found by ``searchsorted`` in the documents' offsets, and a run whose
first and last word lie in different documents is masked before ``bincount``.  Checksums of longer runs continue those of
shorter ones, column by column over all words at once.

*Weights.*  Raw and target corpus are counted by the same pass; a task returns one table of ``BUCKETS`` counts, whatever its
share of the texts.  A bucket's gain is ``floor(SCALE * ln((t + 1) * (S + BUCKETS) / ((s + 1) * (T + BUCKETS))))``; a document's
weight is the sum of its features' gains.  ``BUCKETS`` gains travel to the second pass, which reads the texts again.

*Sampling.*  Of the documents with at least ``least_words`` words a percentage with the highest weight plus seeded
Gumbel noise is drawn, which samples without replacement in proportion to the weights.  Ranks are exact places in a
range-partitioned order.

Defined results: null and empty texts have no words and weight 0; a null id hashes like an empty one and precedes other ids in
ties; rows that repeat an id have the same noise and are drawn one by one; empty tables count nothing (gains then compare with the
smoothing alone); extra columns are ignored; an empty table of documents gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import fixed_schema, small_batches, stored, text_bytes
from quillstone.llm.numbering import numbered

ORDER = 3
BUCKETS = 10_000
SCALE = 1000
#: Words are runs of 0-9, a-z and bytes above ASCII; the sentinel is none of them.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SENTINEL = b"\n"
#: Words up to this many bytes are hashed column by column, all at once; longer ones one by one.
SHORT = 48


def _crc_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> 1) ^ np.uint32(0xEDB88320), values >> 1).astype(np.uint32)
    return values


_TABLE = _crc_table()


def continued(data: np.ndarray, raw: bytes, crc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of what gave ``crc`` followed by ``data[start:end]``, for many words at once (``data`` and ``raw`` hold the same bytes)."""
    state = ~crc
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, SHORT + 1), kind="stable")
    long = int((sizes > SHORT).sum())
    order, long_ones = order[long:], order[:long]
    at, now = starts[order], state[order]
    counts = np.bincount(sizes[order], minlength=1)
    left = len(order) - np.cumsum(counts)  # how many words have more than so many bytes
    for column in range(len(counts) - 1):
        some = now[: left[column]]
        now[: left[column]] = _TABLE[(some ^ data[at[: left[column]] + column]) & np.uint32(255)] ^ (some >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~now
    for i in long_ones.tolist():
        out[i] = zlib.crc32(raw[starts[i] : ends[i]], int(crc[i]))
    return out


def batch_features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, .. ``ORDER`` words: the text's place in ``texts`` and the bucket of every run; runs of one word come first."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(SENTINEL)
    offsets = np.cumsum(sizes) - sizes
    raw = SENTINEL.join(texts).lower()  # bytes.lower changes A-Z only
    spans = np.fromiter(chain.from_iterable(map(re.Match.span, _WORD.finditer(raw))), np.int64).reshape(-1, 2)
    starts, ends = np.ascontiguousarray(spans[:, 0]), np.ascontiguousarray(spans[:, 1])
    data = np.frombuffer(raw, np.uint8)
    document = np.searchsorted(offsets, starts, side="right") - 1
    crc = np.zeros(len(starts), np.uint32)
    for n in range(1, ORDER + 1):
        if n > 1:
            crc = crc[: max(0, len(starts) - n + 1)]
            crc = ~(_TABLE[(~crc ^ np.uint32(32)) & np.uint32(255)] ^ (~crc >> np.uint32(8)))  # the space between
        crc = continued(data, raw, crc, starts[n - 1 :], ends[n - 1 :])
        inside = document[: len(crc)] == document[n - 1 :]
        yield document[: len(crc)][inside], (crc[inside] % np.uint32(BUCKETS)).astype(np.int64)


COUNTS = "bucket int, n bigint"


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, buckets in batch_features(list(text_bytes(batch, "text"))):
                total += np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], schema=fixed_schema(COUNTS))

    out = np.zeros(BUCKETS, np.int64)
    found = texts.select("text").mapInArrow(run, COUNTS).groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in found.toArrow().to_batches():  # BUCKETS rows at most
        out[row["bucket"].to_numpy()] = row["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Every bucket's gain; sums of gains stay exact integers in doubles."""
    s_all, t_all = float(int(raw.sum()) + BUCKETS), float(int(target.sum()) + BUCKETS)
    return np.array([math.floor(SCALE * math.log(((t + 1) * s_all) / ((s + 1) * t_all))) for s, t in zip(raw.tolist(), target.tolist())], np.float64)


WEIGHTS = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            n_words = n_features = weight = None
            for document, buckets in batch_features(list(text_bytes(batch, "text"))):
                n = np.bincount(document, minlength=size)
                gained = np.bincount(document, weights=shared.value[buckets], minlength=size)
                n_words = n if n_words is None else n_words
                n_features = n if n_features is None else n_features + n
                weight = gained if weight is None else weight + gained
            columns = [batch["doc_id"], pa.array(n_words), pa.array(n_features), pa.array(weight.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, schema=fixed_schema(WEIGHTS))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, WEIGHTS)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn) of every document."""
    found = weights(docs, gains(bucket_counts(docs), bucket_counts(target)))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = stored(found.withColumn("score", F.col("weight") + noise).withColumn("all_", F.lit(0)), "scored")
    eligible = scored.filter(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    ranked = numbered(eligible, "all_", [F.col("score").desc(), F.col("doc_id").asc_nulls_first()])
    rank = F.when(F.col("number") < drawn, F.col("number") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank.alias("rank")).unionByName(rest)
