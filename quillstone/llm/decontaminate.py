"""Benchmark decontamination by latent semantic retrieval.

Passages are ``PASSAGE`` words (runs of letters and digits, case folded), each word once, weighted by its inverse document frequency
over the whole corpus (words hashed to ``TERMS`` slots).  The latent space is the randomised SVD of the benchmark's
passages, computed by tasks that return partial products of fixed size; up to ``PIECES`` benchmark passages share a space
of as many dimensions, so nothing of what is searched for is cut off (a larger benchmark is searched in blocks).

A document's passages overlap by half.  The part of a passage's length that lies on benchmark words bounds its cosine
with every benchmark passage; only passages that can reach ``LEAST_COSINE`` are projected and compared.  The cosine of a
short item depends on the words around it, so beside it every place where ``GRAM`` words of an item stand in a row is a
candidate, whatever its cosine: verbatim items are always found, the cosine adds paraphrases.  Candidates are
then checked in word order: the longest common subsequence of the item and the stretch of text it would occupy must
hold ``SURE`` of the item's words, or ``LIKELY`` of them and ``ANSWER_SHARE`` of its answer's (the given answer, else the
``ANSWER_WORDS`` rarest words).  Items of fewer than ``ORDERED`` words must occur word for word.  Those below
``shortest`` words (a parameter; ``SHORTEST`` unless given) say too little and never match; with 1 every item counts.

The latent space keeps every direction of the benchmark's passages: its cosine is that of the TF-IDF passages, in fewer dimensions.

Defined results: null and empty texts match nothing; null ids are carried along; repeated rows are judged one by one;
extra columns are ignored; an empty benchmark or table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import BASE, LETTERS_AND_DIGITS, fixed_schema, small_batches, stored, word_hashes

PASSAGE = 32
TERMS = 1 << 18
PIECES = 512
LEAST_COSINE = 0.35
SURE, LIKELY = 0.8, 0.6
ANSWER_WORDS, ANSWER_SHARE = 5, 0.6
SHORTEST, ORDERED = 5, 8
GRAM = 3


def words(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, in order."""
    return word_hashes(text, LETTERS_AND_DIGITS)


def weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every slot (one megabyte, whatever the corpus)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for text in batch["text"].to_pylist():
                terms = np.unique(words(text) & (TERMS - 1))
                seen[terms] += 1
                total += len(terms) > 0
        hit = np.flatnonzero(seen)
        schema = fixed_schema("term int, n bigint")
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1), pa.int32()), pa.array(np.append(seen[hit], total), pa.int64())], schema=schema)

    counts = docs.select("text").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = counts["term"].to_numpy(), counts["n"].to_numpy()
    table = np.zeros(TERMS)
    table[term[term >= 0]] = n[term >= 0]
    total = max(1, int(n[term < 0].sum()))
    return np.log1p(total / (table + 0.5)).astype(np.float32)


def passages(count: int, stride: int) -> list[int]:
    """First words of the passages that cover ``count`` words; the last one is whole if possible."""
    starts = list(range(0, max(1, count - PASSAGE + 1), stride))
    if count > PASSAGE and starts[-1] != count - PASSAGE:
        starts.append(count - PASSAGE)
    return starts


def grams(tokens: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of ``size`` words in a row, at every word that begins such a run."""
    count = max(0, len(tokens) - size + 1)
    total = np.zeros(count, np.uint64)
    for i in range(size):
        total = (total + tokens[i : i + count].view(np.uint64)) * np.uint64(BASE)
    return total


class Item:
    def __init__(self, key: int | None, tokens: np.ndarray, answer: np.ndarray | None, idf: np.ndarray):
        self.key, self.tokens = key, tokens.tolist()
        own = np.unique(tokens)
        rare = own[np.argsort(-idf[own & (TERMS - 1)], kind="stable")[:ANSWER_WORDS]]
        self.answer = set((answer if answer is not None and len(answer) else rare).tolist())
        self.masks: dict[int, int] = {}
        for i, t in enumerate(self.tokens):
            self.masks[t] = self.masks.get(t, 0) | 1 << i

    def common(self, other: list[int]) -> int:
        """Length of the longest common subsequence, all cells of a row in one integer."""
        row = every = (1 << len(self.tokens)) - 1
        for t in other:
            match = row & self.masks.get(t, 0)
            row = (row + match | row - match) & every
        return len(self.tokens) - row.bit_count()

    def check(self, tokens: list[int], at: int, end: int) -> tuple[float, float] | None:
        """Shares of the item and of its answer if the text around the words from ``at`` to ``end`` (or the item's length) holds it."""
        n = len(self.tokens)
        part = tokens[max(0, at - PASSAGE // 2) : max(at + n, end) + PASSAGE // 2]
        if n < ORDERED:
            fine = any(part[i : i + n] == self.tokens for i in range(len(part) - n + 1))
            return (1.0, 1.0) if fine else None
        if sum(map(self.masks.__contains__, part)) < LIKELY * n:  # no subsequence can be longer
            return None
        share = self.common(part) / n
        if share < LIKELY:
            return None
        answer = len(self.answer.intersection(part)) / len(self.answer)
        return (share, answer) if share >= SURE or answer >= ANSWER_SHARE else None


def _distinct_terms(tokens: np.ndarray, starts: list[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots and weights of every passage; a repeated word and padding weigh nothing."""
    index = np.minimum(np.array(starts)[:, None] + np.arange(PASSAGE), len(tokens) - 1)
    terms = np.sort(tokens[index] & (TERMS - 1), axis=1)
    weight = idf[terms]
    weight[:, 1:][terms[:, 1:] == terms[:, :-1]] = 0
    return terms, weight


class LatentSpace:
    """Benchmark passages of one block: their SVD, their coordinates, and the items they belong to."""

    def __init__(self, items: list[Item], vocabulary: np.ndarray, axes: np.ndarray, idf: np.ndarray):
        self.items, self.idf = items, idf
        self.slot = np.full(TERMS, -1, np.int32)
        self.slot[vocabulary] = np.arange(len(vocabulary))
        self.axes = np.concatenate([axes, np.zeros((1, axes.shape[1]))]).astype(np.float32)  # slot -1: no benchmark word
        owner, offset, rows = [], [], []
        hashed, source, place = [], [], []
        for i, item in enumerate(items):
            tokens = np.array(item.tokens, np.int64)
            starts = passages(len(tokens), PASSAGE)
            terms, weight = _distinct_terms(tokens, starts, idf)
            owner += [i] * len(starts)
            offset += starts
            rows.append(self.project(terms, weight))
            runs = grams(tokens, min(GRAM, len(tokens)))[: 1 if len(tokens) < ORDERED else None]  # word for word: the first run is always there
            hashed.append(runs)
            source += [i] * len(runs)
            place += range(len(runs))
        self.owner, self.offset, self.coordinates = np.array(owner, np.int64), np.array(offset, np.int64), np.concatenate(rows)
        hashes = np.concatenate(hashed)
        order = np.argsort(hashes, kind="stable")
        self.grams, self.gram_owner, self.gram_offset = hashes[order], np.array(source, np.int64)[order], np.array(place, np.int64)[order]
        self.sizes = sorted({min(GRAM, len(item.tokens)) for item in items})
        self.gram_bits = np.zeros(1 << 20, bool)
        self.gram_bits[self.grams >> np.uint64(44)] = True

    def places(self, tokens: np.ndarray) -> list[tuple[int, int]]:
        """Item and its first word for every place where words of an item stand in a row."""
        found: set[tuple[int, int]] = set()
        for size in self.sizes:
            runs = grams(tokens, size)
            at = np.flatnonzero(self.gram_bits[runs >> np.uint64(44)])
            lo, hi = (np.searchsorted(self.grams, runs[at], side) for side in ("left", "right"))
            found |= {(int(self.gram_owner[g]), int(a - self.gram_offset[g])) for a, x, y in zip(at.tolist(), lo.tolist(), hi.tolist()) for g in range(x, y)}
        return sorted(found)

    def cosine(self, item: int, tokens: np.ndarray, at: int) -> float:
        """The best cosine of an item's passages with the text's passage at word ``at``."""
        start = max(0, min(at, len(tokens) - PASSAGE))
        return float((self.project(*_distinct_terms(tokens, [start], self.idf)) @ self.coordinates[self.owner == item].T).max())

    def project(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Latent coordinates divided by the passages' lengths."""
        length = np.sqrt((weight * weight).sum(1, keepdims=True))
        out = np.empty((len(terms), self.axes.shape[1]), np.float32)
        for lo in range(0, len(terms), 64):
            out[lo : lo + 64] = np.einsum("pw,pwk->pk", weight[lo : lo + 64], self.axes[self.slot[terms[lo : lo + 64]]])
        return out / np.maximum(length, 1e-9)

    def leaks(self, text: str | None) -> list[tuple]:
        """(item, cosine, share, answer share, first word) of the items that a text holds, best place of each."""
        tokens = words(text)
        if not len(tokens):
            return []
        best: dict[int, tuple] = {}
        listed = None
        starts = np.array(passages(len(tokens), PASSAGE // 2))
        for lo in range(0, len(starts), 8192):
            some = starts[lo : lo + 8192]
            terms, weight = _distinct_terms(tokens, some.tolist(), self.idf)
            squares = weight * weight
            bound = (squares * (self.slot[terms] >= 0)).sum(1) >= LEAST_COSINE**2 * squares.sum(1) * (1 - 1e-5)
            hit = np.flatnonzero(bound)
            for part in np.array_split(hit, max(1, len(hit) // 256)):
                if not len(part):
                    continue
                cosine = self.project(terms[part], weight[part]) @ self.coordinates.T
                for i, j in zip(*(x.tolist() for x in np.nonzero(cosine >= LEAST_COSINE))):
                    listed = tokens.tolist() if listed is None else listed
                    start = int(some[part[i]])
                    item, at = int(self.owner[j]), start - int(self.offset[j])
                    found = self.items[item].check(listed, at, start + PASSAGE)  # a short item may stand anywhere in the passage
                    if found and (item not in best or (found, float(cosine[i, j])) > (best[item][1:3], best[item][0])):
                        best[item] = (float(cosine[i, j]), *found, max(0, at))
        for item, at in self.places(tokens):
            listed = tokens.tolist() if listed is None else listed
            found = self.items[item].check(listed, at, at)
            if found and (item not in best or found > best[item][1:3]):
                best[item] = (self.cosine(item, tokens, at), *found, max(0, at))
        return [(self.items[i].key, *rest) for i, rest in sorted(best.items())]


def _spaces(benchmark: DataFrame, idf: np.ndarray, key: str, answer: str | None, shortest: int) -> Iterator[LatentSpace]:
    """One latent space per block of at most PIECES passages."""
    spark = benchmark.sparkSession
    given = F.col(answer) if answer else F.lit(None).cast("string")
    rows = benchmark.select(F.col(key).cast("long").alias("item"), "text", given.alias("answer")).filter("text is not null")
    block: list[Item] = []
    count = 0
    for r in rows.orderBy("item", "text").toLocalIterator():  # one block of items at a time
        tokens = words(r["text"])
        if len(tokens) < max(1, shortest):
            continue
        own = len(passages(len(tokens), PASSAGE))
        if block and count + own > PIECES:
            yield _space(spark, block, idf)
            block, count = [], 0
        block.append(Item(r["item"], tokens, words(r["answer"]) if r["answer"] else None, idf))
        count += own
    if block:
        yield _space(spark, block, idf)


def _space(spark, items: list[Item], idf: np.ndarray) -> LatentSpace:
    """Randomised SVD of the items' passages: two distributed products, small factorisations on the driver."""
    rows = [(t,) for item in items for t in _slices(item)]
    table = spark.createDataFrame(rows, "tokens array<bigint>").repartition(max(1, len(rows) // 128))
    shared = spark.sparkContext.broadcast(idf)
    rank = len(rows) + 8

    def sketch(terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Rows of A times a random matrix whose row for a slot is drawn from that slot's own seed."""
        out = np.zeros((len(terms), rank))
        for i in range(len(terms)):
            for t, w in zip(terms[i].tolist(), weight[i].tolist()):
                if w:
                    out[i] += w * np.random.default_rng([11, t]).standard_normal(rank)
        return out

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        parts = [_distinct_terms(np.array(t, np.int64), [0], shared.value) for t in batch["tokens"].to_pylist()]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(float)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rank, rank))
        for batch in batches:
            if batch.num_rows:
                y = sketch(*read(batch))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

    g = sum(np.array(r["g"]) for r in table.mapInArrow(gram, "g array<double>").toLocalIterator()).reshape(rank, rank)
    values, vectors = np.linalg.eigh(g)
    good = values > 1e-10 * max(values.max(), 1e-300)
    back = spark.sparkContext.broadcast(vectors[:, good] / np.sqrt(values[good]))  # Y times this has orthonormal columns

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                terms, weight = read(batch)
                basis = sketch(terms, weight) @ back.value
                for i in range(len(terms)):
                    for t, w in zip(terms[i].tolist(), weight[i].tolist()):
                        if w:
                            sums[t] = sums.get(t, 0) + w * basis[i]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["t", "b"])

    b: dict[int, np.ndarray] = {}
    for r in table.mapInArrow(product, "t int, b array<double>").toLocalIterator():
        b[r["t"]] = b.get(r["t"], 0) + np.array(r["b"])
    vocabulary = np.array(sorted(b), np.int64)
    matrix = np.stack([b[t] for t in vocabulary.tolist()])  # slots by basis: the transpose of Q'A
    values, left = np.linalg.eigh(matrix.T @ matrix)
    good = values > 1e-10 * max(values.max(), 1e-300)
    return LatentSpace(items, vocabulary, matrix @ left[:, good] / np.sqrt(values[good]), idf)


def _slices(item: Item) -> list[list[int]]:
    return [item.tokens[s : s + PASSAGE] for s in passages(len(item.tokens), PASSAGE)]


LEAKS = "doc_id bigint, item_id bigint, cosine double, item_share double, answer_share double, first_word int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "item_id", answer: str | None = None, shortest: int = SHORTEST) -> DataFrame:
    """A row for every document and benchmark item that it holds."""
    spark = docs.sparkSession
    idf = weights(docs)
    found = spark.createDataFrame([], LEAKS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for space in _spaces(benchmark, idf, key, answer, shortest):
        shared = spark.sparkContext.broadcast(space)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            schema = fixed_schema(LEAKS)
            for batch in batches:
                out = [(d, *leak) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for leak in shared.value.leaks(t)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        found = found.unionByName(rows.mapInArrow(run, LEAKS))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "item_id", answer: str | None = None, shortest: int = SHORTEST) -> DataFrame:
    """The documents that hold no benchmark item, all columns unchanged; nothing is shuffled."""
    spark = docs.sparkSession
    idf = weights(docs)
    kept = docs
    for number, space in enumerate(_spaces(benchmark, idf, key, answer, shortest)):
        shared = spark.sparkContext.broadcast(space)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.leaks(t) for t in batch["text"].to_pylist()], pa.bool_()))

        kept = (stored(kept, "kept") if number else kept).mapInArrow(run, docs.schema)
    return kept
