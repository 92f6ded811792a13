"""Repeated byte strings removed by column-wise suffix sorting of many documents at once.

A byte goes if a ``LENGTH``-byte string covers it that also starts anywhere else (same document included, overlaps
count, judged on the input).  Deciding that needs, for every start, the longest common prefix with its neighbour in
the sorted suffixes of the whole collection.  The job sorts only suffixes that can matter, in blocks of bounded size.
Equal texts are one text from the start: those of ``LENGTH`` bytes or more go as a whole, and one of them stands for all.

1. *Runs.*  The anchor of a ``LENGTH``-byte string is its ``ANCHOR``-byte substring of smallest hash.  Consecutive
   starts with the same anchor form a run; equal strings have equal anchors at equal offsets, so they can only
   meet in runs of the same anchor hash ``h``.  One aggregate by ``h`` tells anchors that occur once (most of a clean
   corpus: done) from those that repeat, and among these the ones whose runs differ.
2. *Hits.*  A second pass emits the runs of repeated anchors, with text only where runs differ.  The two sets of anchors
   travel as bitmaps of fixed size; a false hit costs a row and changes nothing, as counts are taken again exactly.
   Runs that are equal as a whole need no sorting.
3. *Columns.*  Distinct runs of one anchor, aligned at it, are sorted column-wise: each round inserts one symbol of
   every string in front of its suffix, updates the order by a stable distribution on that symbol and the common prefixes
   of neighbours, reading the previous round's order and prefixes from their file and writing the next ones sequentially.
   Aligned strings only need suffixes of one round compared, so a round's section of the transform (its column in the round's order)
   is used up within the round: no section is kept, nothing merges them, and the work is linear in the text.
4. *Crowded anchors* (more than ``CROWDED`` distinct runs) are split by the longer substring that all starts of a narrower
   offset range share, down to single starts, where equal strings are simply counted.  Their rows stay dealt out by whole run: only
   the anchors' hashes, of which there can be at most rows / ``CROWDED``, travel.  Nothing is dropped or capped.

Defined results: a null text is empty; texts shorter than ``LENGTH`` keep all bytes; equal texts are removed as a whole
(from ``LENGTH`` bytes on); a null id is a document like any other; rows that repeat an id get a row each; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quillstone.llm.common import map_rows, mixed, powers, small_batches, stored, text_bytes

LENGTH = 400
ANCHOR = 200
CROWDED = 512
#: Crowded anchors and repeated runs (8 or 16 bytes each) up to this many travel to every task; more meet their rows by a join that Spark can split.
FEW_CROWDED = 500_000
#: The same for keys of texts that have copies (16 bytes each).
FEW_COPIED = 1_000_000
#: Offset ranges of the levels of crowded anchors; the last one has a single offset.
WIDTHS = (29, 5, 1)
BITMAP = 1 << 25
BLOCK_ROWS = 8_192
_PIECE = 1 << 19


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def anchor_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all substrings of ``width`` bytes."""
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[: n - width + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    least, have = values, 1
    while have * 2 <= width:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    rest = width - have
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def runs(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first start, number of starts, anchor position, anchor hash) of the runs of a text, piece by piece."""
    starts = len(text) - length + 1
    offsets = length - anchor + 1
    for lo in range(0, max(0, starts), _PIECE):
        count = min(_PIECE, starts - lo)
        h = anchor_hashes(np.frombuffer(text, np.uint8, count + length - 1, lo), anchor)
        # smallest hash, leftmost of equal ones: the low bits hold the position
        low = np.uint64((1 << 20) - 1)
        place = np.arange(len(h), dtype=np.uint64)
        q = (sliding_least((h & ~low) | place, offsets) & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1])
        yield first + lo, np.diff(np.append(first, count)), q[first] + lo, h[q[first]].view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``key`` and ``text`` of every different text, once; ``key`` and ``n_bytes`` of those that occur more than once).

    Only texts whose key occurs more than once are grouped; the keys travel while they are few, and are joined by a shuffle beyond.
    """
    texts = _texts(docs)
    copied = stored(texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("k")), "copied")
    if copied.limit(FEW_COPIED + 1).count() <= FEW_COPIED:
        copied = F.broadcast(copied)
    same = F.col("key") == F.col("k")
    one = stored(texts.join(copied, same, "left_semi").groupBy("key").agg(F.min("text").alias("text")), "copies")
    every = texts.join(copied, same, "left_anti").select("key", "text").unionByName(one)
    return every, one.select("key", F.octet_length("text").alias("n_bytes"))


def _anchors(docs: DataFrame) -> DataFrame:
    """``h`` of every anchor that occurs more than once; ``differ`` if its runs are not all equal."""

    def work(batch: pa.RecordBatch):
        hs, ts = [], []
        for text in text_bytes(batch, "text"):
            for first, count, _, h in runs(text):
                hs.append(h)
                ts.append(np.array([xxh3_64_intdigest(text[a:b]) for a, b in zip(first.tolist(), (first + count + LENGTH - 1).tolist())], np.uint64).view(np.int64))
        if hs:
            yield [np.concatenate(hs), np.concatenate(ts)]

    found = map_rows(docs.select("text"), work, "h bigint, t bigint")
    totals = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("least"), F.max("t").alias("most"))
    return totals.filter("n > 1").select("h", (F.col("least") != F.col("most")).alias("differ"))


def _bitmap(anchors: DataFrame) -> np.ndarray:
    """Four megabytes, whatever the corpus: a bit for every slot that some hash falls into."""
    slot = F.col("h").bitwiseAND(F.lit(BITMAP - 1))
    rows = anchors.groupBy(F.shiftright(slot, 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 31 as int))")).alias("b"))
    table = np.zeros(BITMAP // 32, np.uint32)
    for row in rows.toArrow().to_batches():
        table[row["w"].to_numpy()] = row["b"].to_numpy().astype(np.uint32)
    return table.view(np.uint8)


def _inside(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & (BITMAP - 1)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


HITS = "key binary, start int, count int, left int, h bigint, t bigint, body binary"


def _hits(docs: DataFrame, repeated: np.ndarray, differing: np.ndarray) -> DataFrame:
    context = docs.sparkSession.sparkContext
    shared, open_ones = context.broadcast(repeated), context.broadcast(differing)

    def work(batch: pa.RecordBatch):
        out: list[tuple] = []
        for key, text in zip(batch["key"].to_pylist(), text_bytes(batch, "text")):
            for first, count, q, h in runs(text):
                hit = np.flatnonzero(_inside(shared.value, h))
                body = _inside(open_ones.value, h[hit]).tolist()
                for a, c, p, x, b in zip(first[hit].tolist(), count[hit].tolist(), q[hit].tolist(), h[hit].tolist(), body):
                    part = text[a : a + c + LENGTH - 1]
                    out.append((key, a, c, p - a, x, _signed(xxh3_64_intdigest(part)), part if b else None))
                if len(out) > 4_000:
                    yield list(zip(*out))
                    out = []
        if out:
            yield list(zip(*out))

    return map_rows(docs.select("key", "text"), work, HITS)


def column_sort(bodies: list[bytes], left: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For every string, which of its starts begin a ``length``-byte string that another string has at the same column.

    ``left``: the anchor's offset in each string; columns count from the anchor.  Files: ``symbols`` (one row per
    column) and two of ``state`` (order and common prefixes): each round reads one from its start and writes the other.
    """
    n = len(bodies)
    size = np.fromiter(map(len, bodies), np.int64, n)
    first, last = -left.astype(np.int64), size - left
    low, high = int(first.min()), int(last.max())
    repeated = [np.zeros(c, bool) for c in counts.tolist()]
    with tempfile.TemporaryDirectory() as folder:
        rows = np.zeros((n, high - low), np.uint8)
        for row, body, at in zip(rows, bodies, (first - low).tolist()):
            row[at : at + len(body)] = np.frombuffer(body, np.uint8)
        np.ascontiguousarray(rows.T).tofile(os.path.join(folder, "symbols"))
        del rows
        symbols = np.memmap(os.path.join(folder, "symbols"), np.uint8, "r", shape=(high - low, n))
        read, write = (open(os.path.join(folder, f"state{i}"), "w+b") for i in range(2))
        held = 0
        for column in range(high - 1, low - 1, -1):
            read.seek(0)
            state = np.frombuffer(read.read(held), np.int32)
            order, common = state[: len(state) // 2], state[len(state) // 2 :]
            stay = np.flatnonzero(first[order] <= column)
            if len(stay) < len(order):  # strings that are used up leave; what they separated has the least prefix between
                if len(stay):
                    cuts = np.concatenate([[0], stay[:-1] + 1])
                    common = np.minimum.reduceat(common[: stay[-1] + 1], cuts)
                order, common = order[stay], common[: len(stay)]
            new = np.flatnonzero(last - 1 == column).astype(np.int32)
            if len(new):  # strings that end here come first: their suffixes so far are empty
                order = np.concatenate([new, order])
                common = np.concatenate([np.zeros(len(new), np.int32), common])
                if len(common) > len(new):
                    common[len(new)] = 0
            if not len(order):
                continue
            symbol = symbols[column - low][order]
            moved = np.argsort(symbol, kind="stable")
            symbol = symbol[moved]
            joint = np.zeros(len(order), np.int32)
            same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
            joint[same] = np.minimum(_least_between(common, moved[same - 1] + 1, moved[same] + 1) + 1, length)
            order = order[moved]
            write.seek(0)
            held = write.write(np.concatenate([order, joint]).astype(np.int32).tobytes())
            read, write = write, read
            full = joint >= length
            if full.any():
                full[:-1] |= full[1:]
                for i in order[full].tolist():
                    at = column - int(first[i])
                    if at < len(repeated[i]):
                        repeated[i][at] = True
        read.close()
        write.close()
        del symbols
    return repeated


def _least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of ``values[lo:hi]`` for many non-empty ranges."""
    if not len(lo):
        return np.zeros(0, values.dtype)
    span = hi - lo
    out = np.empty(len(lo), values.dtype)
    level, have, most = values, 1, int(span.max())
    while True:
        mine = np.flatnonzero((span >= have) & (span < 2 * have))
        out[mine] = np.minimum(level[lo[mine]], level[hi[mine] - have])
        if have * 2 > most:
            return out
        level, have = np.minimum(level[:-have], level[have:]), have * 2


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of every stretch of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)).tolist()))


FOUND = "key binary, start int, count int"


def _sorted_blocks(rows: DataFrame) -> DataFrame:
    """Repeated starts of strings that meet in groups of at most CROWDED."""

    def block(some: list[dict]) -> pa.RecordBatch:
        flags = column_sort([r["body"] for r in some], np.array([r["left"] for r in some]), np.array([r["count"] for r in some]))
        out = [(r["key"], r["start"] + a, c) for r, f in zip(some, flags) if not r["full"] for a, c in _spans(f)]
        columns = zip(*out) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32()))], names=["key", "start", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(waiting) >= BLOCK_ROWS and row["h"] != waiting[-1]["h"]:
                    yield block(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield block(waiting)

    return rows.select("key", "start", "count", "left", "h", "body", "full").repartition("h").sortWithinPartitions("h").mapInArrow(run, FOUND)


SPLIT = "key binary, start int, count int, left int, h bigint, t bigint, full boolean, body binary"


def _split(rows: DataFrame, width: int) -> DataFrame:
    """Strings cut into narrower offset ranges; ``h`` becomes the hash of the substring that all starts of a range share."""

    def work(batch: pa.RecordBatch):
        out = []
        for r in batch.to_pylist():
            body, left, count = r["body"], r["left"], r["count"]
            for j in range((left - count + 1) // width, left // width + 1):
                a, b = max(0, left - (j + 1) * width + 1), min(count - 1, left - j * width)
                core = body[left - j * width : left - (j + 1) * width + 1 + LENGTH]
                part = body[a : b + LENGTH]
                h = _signed(xxh3_64_intdigest(core, r["h"] & 0xFFFFFFFF) ^ j)
                out.append((r["key"], r["start"] + a, b - a + 1, left - a, h, _signed(xxh3_64_intdigest(part)), r["full"], part))
        if out:
            yield list(zip(*out))

    return map_rows(rows.select("key", "start", "count", "left", "h", "body", "full"), work, SPLIT)


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows whose (``h``, ``t``) occurs more than once.

    One run may be a large part of all rows: the repeated pairs travel while they are few, and otherwise are a table of their own, so that the
    join has plain shuffles on both sides, which Spark can split.
    """
    times = rows.groupBy("h", "t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("h").alias("h2"), F.col("t").alias("t2"))
    times = stored(times, "times")
    if times.limit(FEW_CROWDED + 1).count() <= FEW_CROWDED:
        times = F.broadcast(times)
    return rows.join(times, (F.col("h") == F.col("h2")) & (F.col("t") == F.col("t2")), "left_semi")


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of anchors with 2 to ``CROWDED`` distinct runs, rows of crowded anchors); anchors whose runs are all repeated as a whole need no sorting."""
    groups = rows.groupBy(F.col("h").alias("g")).agg(F.count(F.lit(1)).alias("members"), F.min(F.col("full").cast("int")).alias("all_full"))
    groups = stored(groups.filter("members > 1 and all_full = 0"), "groups")
    crowded = groups.filter(F.col("members") > CROWDED).select("g")
    if crowded.limit(FEW_CROWDED + 1).count() <= FEW_CROWDED:
        crowded = F.broadcast(crowded)
    same = F.col("h") == F.col("g")
    calm = rows.join(crowded, same, "left_anti").join(groups.filter(F.col("members") <= CROWDED), same).drop("g", "members", "all_full")
    return calm, rows.join(crowded, same, "left_semi")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """``key`` (of a text), ``start``, ``count``: ranges of starts whose strings also start elsewhere."""
    small_batches(docs.sparkSession)
    texts, copied = distinct_texts(docs)
    anchors = stored(_anchors(texts), "anchors")
    hits = stored(_hits(texts, _bitmap(anchors), _bitmap(anchors.filter("differ"))), "hits")
    found = _repeated(hits).select("key", "start", "count")
    whole = copied.filter(F.col("n_bytes") >= LENGTH).select("key", F.lit(0).alias("start"), (F.col("n_bytes") - LENGTH + 1).alias("count"))
    found = found.unionByName(whole)
    one = F.min(F.struct("key", "start", "count", "left", "body")).alias("one")
    rows = hits.filter("body is not null").groupBy("h", "t").agg(one, (F.count(F.lit(1)) > 1).alias("full")).select("h", "t", "one.*", "full")
    for width in WIDTHS:
        rows = stored(rows, "rows")
        calm, crowd = _grouped(rows)
        found = found.unionByName(_sorted_blocks(calm))
        if crowd.isEmpty():
            return found
        parts = stored(_split(crowd, width), "parts")
        again = parts.groupBy("h", "t").agg(F.count(F.lit(1)).alias("n"), F.max("full").alias("any_full"), one)
        found = found.unionByName(_repeated(parts).filter("not full").select("key", "start", "count"))
        rows = again.select("h", "t", "one.*", (F.col("any_full") | (F.col("n") > 1)).alias("full"))
    return found  # of a single offset: equal strings have been counted


KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and (``with_bytes``) the ``kept`` bytes of every document."""
    ranges = repeated_starts(docs)
    ranges = ranges.groupBy(F.col("key").alias("range_key")).agg(F.collect_set(F.struct("start", "count")).alias("ranges"))
    ranges = stored(ranges.select("range_key", "ranges.start", "ranges.count"), "ranges")
    joined = _texts(docs).join(ranges, F.col("key") == F.col("range_key"), "left").select("doc_id", "text", "start", "count")

    def work(batch: pa.RecordBatch):
        rows = []
        for doc_id, text, starts, counts in zip(batch["doc_id"].to_pylist(), text_bytes(batch, "text"), batch["start"].to_pylist(), batch["count"].to_pylist()):
            removed = spans = 0
            kept = text
            if starts:
                order = sorted(zip(starts, counts))
                parts, at, end = [], 0, -1
                for start, count in order:
                    if start > end:
                        spans += 1
                        parts.append(text[at:start])
                        end = at = start + count + LENGTH - 1
                    else:
                        end = at = max(end, start + count + LENGTH - 1)
                parts.append(text[at:])
                kept = b"".join(parts)
                removed = len(text) - len(kept)
            rows.append((doc_id, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
        if rows:
            yield list(zip(*rows))

    return map_rows(joined, work, KEPT)
