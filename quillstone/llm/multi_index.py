"""Nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own ``CENTROIDS`` centroids (fitted on a sample of about ``SAMPLE`` entries); a cell is
a pair of centroids.  A query walks cells by increasing sum of both half distances with a heap over the two sorted
centroid lists, until the cells hold ``SHARE`` of all entries (``LEAST`` at least), and reranks their entries by exact
distance in double precision.  Every vector is indexed.  In 64 dimensions of little structure neighbours are spread
over many cells, hence the large share; measured recall is in the README.

Equal vectors are one entry with their ``ids`` smallest ids, which is all that a result of that length can show, so a
vector that a third of all rows hold costs one comparison.  Cells are packed into blocks of at most ``BLOCK`` entries (larger
cells are cut), queries travel to the blocks of their cells in chunks, and a block meets a chunk as one matrix product
whose close calls are recomputed exactly.  Per block a query returns at most ``k + 1`` rows.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; ties go to the smaller id; with fewer candidates all of them are returned; null ids take no part; rows that repeat
an id are one vector per distinct content, and a query is never its own candidate; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm.common import map_rows, share_of, stored

CENTROIDS = 32
SAMPLE = 20_000
SHARE = 0.5
LEAST = 2_000
BLOCK = 4_096
CHUNK = 1_024
ROUNDS = 12


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the vectors that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(fine).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 and 0.0 are one value
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == F.lit(sizes[0]["n"] if sizes else 0))


def _centroids(sample: np.ndarray, seed: int) -> np.ndarray:
    """Lloyd's rounds from a seeded choice of distinct points."""
    points = np.unique(sample, axis=0)
    random = np.random.default_rng(seed)
    centers = points[random.choice(len(points), min(CENTROIDS, len(points)), replace=False)]
    for _ in range(ROUNDS):
        near = _squares(sample, centers).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        count = np.bincount(near, minlength=len(centers))
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(second) + j) that hold entries, by increasing ``first[i] + second[j]``, until they hold ``enough``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    a, b, n = a.tolist(), b.tolist(), len(y)
    heap, cells, held, counts = [(x[0] + y[0], 0, 0)], [], 0, sizes.tolist()
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * n + b[j]
        if counts[cell]:
            cells.append(cell)
            held += counts[cell]
        if j + 1 < n:
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return cells


def _distinct(rows: DataFrame, ids: int) -> DataFrame:
    """``v`` and its ``ids`` smallest ids; the first ranking spreads the rows of a frequent vector."""
    part = F.pmod(F.xxhash64("id"), F.lit(16))
    ranked = rows.distinct().withColumn("part", part)
    ranked = ranked.withColumn("n", F.row_number().over(W.partitionBy("v", "part").orderBy("id"))).filter(F.col("n") <= ids)
    ranked = ranked.withColumn("m", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("m") <= ids)
    return ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _rank(pairs: list[tuple[float, int]], count: int) -> list[tuple[float, int]]:
    return sorted(pairs)[:count]


def search(vectors: DataFrame, queries: str, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest found for the rows that ``queries`` (SQL on ``id``) names."""
    spark = vectors.sparkSession
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    rows = _usable(vectors, key, vector)
    entries = stored(_distinct(rows, k + 1).withColumn("hash", F.xxhash64("v")), "entries")
    sample = entries.filter(share_of(entries, SAMPLE, F.col("hash"))).select("v").toArrow().column("v")  # entries are distinct
    if not len(sample):
        return spark.createDataFrame([], empty)
    points = np.array(sample.to_pylist())
    half = (points.shape[1] + 1) // 2
    split = spark.sparkContext.broadcast((_centroids(points[:, :half], 1), _centroids(points[:, half:], 2) if half < points.shape[1] else np.zeros((1, 0))))

    def halves(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = batch["v"].flatten().to_numpy().reshape(batch.num_rows, -1)
        return v, _squares(v[:, :half], split.value[0]), _squares(v[:, half:], split.value[1])

    def place(batch: pa.RecordBatch):
        if batch.num_rows:
            _, a, b = halves(batch)
            yield [batch["v"], batch["ids"], batch["hash"], (a.argmin(1) * b.shape[1] + b.argmin(1)).astype(np.int32)]

    indexed = stored(map_rows(entries.select("v", "ids", "hash"), place, "v array<double>, ids array<bigint>, hash bigint, cell int"), "index")
    # a number per cell: at most CENTROIDS squared
    counts = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}
    n_cells = len(split.value[0]) * len(split.value[1])
    sizes = np.array([counts.get(c, 0) for c in range(n_cells)], np.int64)
    block, cuts, blocks, room = np.zeros(n_cells, np.int64), np.ones(n_cells, np.int64), 0, 0
    for cell in np.flatnonzero(sizes).tolist():
        if sizes[cell] > BLOCK:
            cuts[cell] = -(-sizes[cell] // BLOCK)
            block[cell], blocks, room = blocks, blocks + cuts[cell], 0
        else:
            if room < sizes[cell]:
                blocks, room = blocks + 1, BLOCK
            block[cell], room = blocks - 1, room - sizes[cell]
    total = int(sizes.sum())
    enough = max(int(np.ceil(SHARE * total)), LEAST)
    plan = spark.sparkContext.broadcast((sizes, block, cuts))
    where = F.element_at(F.lit(block.tolist()), F.col("cell") + 1) + F.pmod(F.col("hash"), F.element_at(F.lit(cuts.tolist()), F.col("cell") + 1))
    asked = rows.filter(queries).groupBy("v").agg(F.min("id").alias("q"))  # equal queries are one
    asked = stored(asked, "queries")
    chunks = max(1, -(-asked.count() // CHUNK))
    chunk = F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int")

    def travel(batch: pa.RecordBatch):
        if not batch.num_rows:
            return
        _, a, b = halves(batch)
        sizes, block, cuts = plan.value
        out = []
        for q, v, x, y in zip(batch["q"].to_pylist(), batch["v"].to_pylist(), a, b):
            stops: dict[int, list[int]] = {}
            for cell in walk(x, y, sizes, enough):
                for at in range(int(block[cell]), int(block[cell] + cuts[cell])):
                    stops.setdefault(at, []).append(cell)
            out += [(at, q, v, cells) for at, cells in stops.items()]
        yield list(zip(*out))

    stops = map_rows(asked, travel, "block bigint, q bigint, v array<double>, cells array<int>").withColumn("chunk", chunk)
    held = indexed.withColumn("block", where.cast("long")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = scan(left, right, k + 1) if left.num_rows and right.num_rows else []
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["q", "vec_id", "score"])

    pairs = held.groupBy("block", "chunk").cogroup(stops.groupBy("block", "chunk")).applyInArrow(meet, "q bigint, vec_id bigint, score double")
    best = pairs.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("score", "vec_id"))).filter(F.col("n") <= k + 1)
    members = rows.filter(queries).distinct().join(asked.withColumnRenamed("v", "w"), F.col("v") == F.col("w")).select(F.col("id").alias("query_id"), F.col("q").alias("asked"))
    out = members.join(best, F.col("asked") == F.col("q")).filter("query_id <> vec_id")
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def scan(entries: pa.Table, queries: pa.Table, count: int) -> list[tuple[int, int, float]]:
    """The ``count`` nearest entries (with ids) of each query among the cells it visits."""
    e = entries.column("v").combine_chunks().flatten().to_numpy().reshape(entries.num_rows, -1)
    cell = entries.column("cell").to_numpy()
    ids = entries.column("ids").to_pylist()
    q = queries.column("v").combine_chunks().flatten().to_numpy().reshape(queries.num_rows, -1)
    names, cells = queries.column("q").to_pylist(), queries.column("cells").to_pylist()
    order = {c: i for i, c in enumerate(np.unique(cell).tolist())}
    slot = np.searchsorted(np.unique(cell), cell)
    out = []
    for lo in range(0, len(q), 128):
        part = q[lo : lo + 128]
        visits = np.zeros((len(part), len(order)), bool)
        for i, mine in enumerate(cells[lo : lo + 128]):
            visits[i, [order[c] for c in mine if c in order]] = True
        near = np.where(visits[:, slot], _squares(part, e), np.inf)
        slack = 1e-9 * ((part * part).sum(1) + (e * e).sum(1).max())  # above the rounding error of the product form
        last = np.partition(near, min(count, len(e)) - 1, axis=1)[:, min(count, len(e)) - 1]
        for i, row in enumerate(near):
            close = np.flatnonzero((row <= last[i] + slack[i]) & (row < np.inf))
            exact = np.sqrt(((e[close] - part[i]) ** 2).sum(1)).tolist()
            pairs = _rank([(d, x) for d, c in zip(exact, close.tolist()) for x in ids[c]], count)
            out += [(names[lo + i], x, d) for d, x in pairs]
    return out
