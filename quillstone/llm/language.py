"""Language identification by string kernels: blended-spectrum presence kernels, Nyström landmarks, kernel ridge regression.

Two texts are as similar as the number of character n-grams (one to three characters, case folded) that both contain,
divided by the root of both counts.  N-grams are hashed to fixed ranges.  ``LANDMARKS`` training texts per language span
the Nyström feature map; one ridge regression per language (one versus rest) is fitted in it.  As the kernel is linear
in presence, landmarks, map and regressions multiply out to one matrix, and a batch of texts is scored by one product.

The model is fitted on a bounded sample: of each language the training rows whose hash lies in the lowest part that holds
``PER_LANGUAGE`` distinct ones on average (their presence vectors travel to the driver, 2 KB each, never texts).  Whole texts are read when predicting.

Defined results: a null text or one without a letter is ``und`` with score 0, as is everything when there is nothing to
learn from; a null id counts as an empty one for the fold; repeated rows are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import map_rows, small_batches

PER_LANGUAGE = 500
LANDMARKS = 48
RIDGE = 0.1
#: (n, buckets as a power of two, first bucket)
_ORDERS = ((1, 9, 0), (2, 12, 512), (3, 13, 512 + 4096))
WIDTH = 512 + 4096 + 8192
UNKNOWN = "und"


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def has_letter(text: str) -> bool:
    return next(filter(str.isalpha, text), None) is not None


def mark(text: str, row: np.ndarray) -> None:
    """Sets the buckets of the n-grams of a text (``row``: WIDTH numbers)."""
    for lo in range(0, max(1, len(text)), 1 << 20):  # pieces overlap, so no n-gram is missed
        points = np.frombuffer(text[lo : lo + (1 << 20) + 2].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        gram = np.zeros(len(points), np.uint32)
        for n, power, first in _ORDERS:
            if len(points) < n:
                break
            gram = (gram[: len(points) - n + 1] + points[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
            row[first + (gram >> np.uint32(32 - power))] = 1


def presence(texts: list[str]) -> np.ndarray:
    rows = np.zeros((len(texts), WIDTH), np.float32)
    for text, row in zip(texts, rows):
        mark(text, row)
    return rows


class KernelModel:
    """``languages`` and the matrix that turns presence vectors into one-versus-rest outputs."""

    def __init__(self, languages: list[str], weights: np.ndarray, offset: np.ndarray):
        self.languages, self.weights, self.offset = languages, weights.astype(np.float32), offset.astype(np.float32)

    @classmethod
    def fit(cls, bits: np.ndarray, labels: list[str]) -> KernelModel | None:
        """``bits``: packed presence vectors, a row per text; they are unpacked a slice at a time."""
        languages = sorted(set(labels))
        if not languages:
            return None
        code = np.array([languages.index(x) for x in labels])

        def unit(rows: np.ndarray) -> np.ndarray:
            some = np.unpackbits(bits[rows], axis=1)[:, :WIDTH].astype(np.float32)
            return some / np.sqrt(np.maximum(some.sum(1, keepdims=True), 1))

        marks = unit(np.concatenate([np.flatnonzero(code == k)[:LANDMARKS] for k in range(len(languages))]))
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        good = values > 1e-6 * values.max() if values.max() > 0 else np.zeros(len(values), bool)
        back = vectors[:, good] / np.sqrt(values[good])  # kernel to landmarks -> Nyström features
        features = np.concatenate([(unit(np.arange(lo, min(lo + 256, len(code)))) @ marks.T) @ back for lo in range(0, len(code), 256)])
        goal = np.where(code[:, None] == np.arange(len(languages)), 1.0, -1.0)
        weight = (1.0 / np.bincount(code, minlength=len(languages)))[code][:, None] * len(code) / len(languages)
        middle = (weight * features).sum(0) / weight.sum()
        mean = (weight * goal).sum(0) / weight.sum()
        f, g = features - middle, goal - mean
        solved = np.linalg.solve((weight * f).T @ f + RIDGE * np.eye(f.shape[1]), (weight * f).T @ g)
        return cls(languages, marks.T @ (back @ solved), mean - middle @ solved)

    def outputs(self, rows: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
        return rows @ self.weights / size + self.offset

    def predict(self, texts: list[str | None], batch: int = 64) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for lo in range(0, len(texts), batch):
            some = texts[lo : lo + batch]
            out = self.outputs(presence([t or "" for t in some]))
            best = out.argmax(1)
            for text, k, value in zip(some, best.tolist(), out[np.arange(len(some)), best].tolist()):
                known = text is not None and has_letter(text)
                names.append(self.languages[k] if known else UNKNOWN)
                scores.append(min(1.0, max(0.0, (1 + value) / 2)) if known else 0.0)
        return names, scores


def fit_languages(docs: DataFrame) -> KernelModel | None:
    """Learns from the text and language of documents outside the held-out fold."""
    small_batches(docs.sparkSession)
    pool = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    pool = pool.select("text", "lang", F.xxhash64(F.lit(5), "doc_id", "text").alias("hash"))
    share = F.least(F.lit(1.0), F.lit(float(PER_LANGUAGE)) / F.greatest(F.approx_count_distinct("hash"), F.lit(1)))
    limits = pool.groupBy(F.col("lang").alias("l")).agg(share.alias("share"))  # a row per language
    place = F.col("hash").cast("double") / F.lit(2.0**64) + 0.5
    chosen = pool.join(F.broadcast(limits), (F.col("lang") == F.col("l")) & (place < F.col("share"))).dropDuplicates(["lang", "hash"])

    def work(batch: pa.RecordBatch):
        texts = batch["text"].to_pylist()
        bits = [np.packbits(r.astype(bool)).tobytes() for lo in range(0, len(texts), 64) for r in presence(texts[lo : lo + 64])]
        yield [batch["lang"].cast(pa.string()), batch["hash"], bits]

    sample = map_rows(chosen.select("lang", "hash", "text"), work, "lang string, hash bigint, bits binary").collect()
    sample.sort(key=lambda r: (r["lang"], r["hash"]))
    if not sample:
        return None
    return KernelModel.fit(np.stack([np.frombuffer(r["bits"], np.uint8) for r in sample]), [r["lang"] for r in sample])


PREDICTED = "doc_id bigint, held_out boolean, lang_pred string, score double"


def predict_languages(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")

    def work(batch: pa.RecordBatch):
        texts = batch["text"].to_pylist()
        names, scores = shared.value.predict(texts) if shared.value else ([UNKNOWN] * len(texts), [0.0] * len(texts))
        yield [batch["doc_id"].cast(pa.int64()), batch["held_out"], names, scores]

    return map_rows(rows, work, PREDICTED)


def accepted(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """The documents of which a language was found, all columns unchanged."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            names = shared.value.predict(texts)[0] if shared.value else [UNKNOWN] * len(texts)
            yield batch.filter(pa.array([n != UNKNOWN for n in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
