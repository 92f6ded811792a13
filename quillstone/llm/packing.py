"""Packing documents into sequences of at most ``CAPACITY`` tokens by a linear grouping scheme, then best fit.

A piece is a document's ids, or ``CAPACITY`` of them where there are more.  Lengths are small integers, so all that a packing
depends on is how many pieces have each length: ``CAPACITY`` counts, whatever the corpus.  The plan is made from these
counts; pieces only learn their place in it.

1. *Grouping.*  Large pieces (longer than a part of the capacity) are ordered by length and cut into ``GROUPS`` groups of equal cardinality; every
   length is rounded up to the longest of its group, which leaves a few sizes.
2. *Configurations.*  A configuration says how many pieces of each size share a sequence.  The linear programme for the least number of
   sequences is solved by column generation (a knapsack over the sizes finds the configuration that pays most) and rounded down; what remains,
   a few pieces per size, joins the small ones of step 4.
3. *Substitution.*  A group's pieces, in order, take the slots that configurations have for its size, so every slot of a
   stretch of sequences has a known length and what is really free in them is known too.
4. *Best fit.*  Small pieces, longest first, go to the sequences with the least room that suffices, stretch by stretch; when none
   is left, new sequences are opened.

The plan is a list of (length, first and last piece of that length, first sequence, pieces per sequence, offset): its size
is bounded by the numbers of lengths and configurations, not by pieces.  A piece's number among those of its length is an exact
place in a range-partitioned order, so no length, however frequent, is numbered in one task; then each piece looks its place up.

Defined results: a null or empty text is just the end id; rows that repeat an id are packed one by one; null ids are carried along;
extra columns are ignored; an empty table gives no rows and no sequences.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import fixed_schema, small_batches
from quillstone.llm.numbering import numbered
from quillstone.llm.token_files import encoder

CAPACITY = 2048
#: Pieces of at most this part of the capacity may be small ones; the part that gives the fewest sequences is taken (a plan takes a fraction of a second).
SMALL_PARTS = (8, 5, 4, 3, 2)
GROUPS = 64
#: The linear programme is solved this near to its optimum.
GAP = 1e-3
#: Bits of a piece's number within its length in the plan's keys.
_NUMBER_BITS = 50

PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, ids binary"


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and (``with_ids``) ``ids`` of every piece of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, encode, schema = struct.pack("<I", end_id), encoder(vocabulary).encode, fixed_schema(PIECES)
        for batch in batches:
            keys = batch["doc_id"].to_pylist()
            for lo in range(0, len(keys), 1000):
                texts = [t or b"" for t in batch["text"].slice(lo, 1000).cast(pa.binary()).to_pylist()]
                rows = []
                for key, data in zip(keys[lo : lo + 1000], encode(texts)):
                    data += end
                    for number, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append((key, number, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def groups(counts: list[tuple[int, int]], number: int = GROUPS) -> list[tuple[int, int]]:
    """(size, pieces) of the groups, longest first, from (length, pieces) longest first; groups of one size are one."""
    total = sum(n for _, n in counts)
    each = max(1, -(-total // number))
    out: list[tuple[int, int]] = []
    left = 0  # room in the group that is being filled
    for length, n in counts:
        while n:
            if not left:
                left = each
                if not out or out[-1][0] != length:
                    out.append((length, 0))
            take = min(n, left)
            out[-1] = (out[-1][0], out[-1][1] + take)
            n, left = n - take, left - take
    return out


def _best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of highest price: a knapsack by number of pieces, over all rooms at once."""
    rooms = np.arange(capacity + 1)
    before = rooms[None, :] - sizes[:, None]
    fits = before >= 0
    before[~fits] = 0
    value, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        gained = np.where(fits, value[before] + prices[:, None], -1.0)
        best = gained.argmax(axis=0)
        best_value = gained[best, rooms]
        better = best_value > value + 1e-12
        choices.append(np.where(better, best, -1))
        value = np.where(better, best_value, value)
        if not better.any():
            break
    out, room = np.zeros(len(sizes), np.int64), capacity
    for choice in reversed(choices):
        if choice[room] >= 0:
            out[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return out


def configurations(sizes: list[tuple[int, int]], capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """(pieces of each group, sequences) of the linear programme, rounded down; within ``gap`` of its least number of sequences."""
    if not sizes:
        return []
    size = np.array([s for s, _ in sizes], np.int64)
    need = np.array([n for _, n in sizes], np.float64)
    k = len(size)
    columns = [np.eye(k, dtype=np.int64)[i] * (capacity // int(size[i])) for i in range(k)]
    inverse = np.diag(1.0 / np.array([c.max() for c in columns], float))
    while True:
        prices = inverse.sum(axis=0)  # every sequence costs one
        found = _best_configuration(size, np.maximum(prices, 0), capacity)
        if found @ prices <= 1 + gap:  # prices divided by this value are a solution of the dual programme
            break
        direction, used = inverse @ found, inverse @ need
        ratio = np.full(k, np.inf)
        grows = direction > 1e-10
        ratio[grows] = np.maximum(used[grows], 0) / direction[grows]
        leaves = int(np.argmin(ratio))
        columns[leaves] = found
        inverse[leaves] /= direction[leaves]
        others = np.arange(k) != leaves
        inverse[others] -= np.outer(direction[others], inverse[leaves])
    used = np.maximum(inverse @ need, 0)
    left = np.array([n for _, n in sizes], np.int64)
    out: list[tuple[dict[int, int], int]] = []
    for column, times in zip(columns, used.tolist()):
        there = column > 0
        whole = min(int(times + 1e-9), int((left[there] // column[there]).min()))
        if whole:
            out.append(({int(g): int(column[g]) for g in np.flatnonzero(there)}, whole))
            left -= whole * column
    return out


class Plan:
    """Places of all pieces, from the counts of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, small: int = CAPACITY // 8, number: int = GROUPS):
        self.capacity = capacity
        #: (length, first number, first sequence, pieces a sequence, offset of the first of them)
        self.records: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        #: room -> stretches (first sequence, number of sequences)
        self.room: dict[int, list[tuple[int, int]]] = {}
        ordered = sorted(counts.items(), reverse=True)
        rest = self._large([(length, n) for length, n in ordered if length > small], number)
        self._best_fit([*rest, *((length, 0, n) for length, n in ordered if length <= small)])
        self.records.sort()

    def _large(self, counts: list[tuple[int, int]], number: int) -> list[tuple[int, int, int]]:
        """Places most large pieces; returns (length, first number, pieces) of those that rounding down leaves."""
        sizes = groups(counts, number)
        lengths = [length for length, _ in counts]
        starts = np.concatenate([[0], np.cumsum([n for _, n in counts])]).astype(np.int64)  # places in the order of all large pieces
        at = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).astype(np.int64)[:-1]  # each group's next piece
        for config, times in configurations(sizes, self.capacity):
            slots = []
            for g, copies in config.items():
                for _ in range(copies):
                    slots.append(int(at[g]))
                    at[g] += times
            # stretches of sequences in which no slot changes its length
            cuts = {0, times}
            for slot in slots:
                lo, hi = np.searchsorted(starts, [slot + 1, slot + times])
                cuts.update(int(s) - slot for s in starts[lo:hi])
            cuts = sorted(cuts)
            for a, b in zip(cuts, cuts[1:]):
                offset = 0
                for slot in slots:
                    kind = int(np.searchsorted(starts, slot + a, side="right")) - 1
                    self.records.append((lengths[kind], slot + a - int(starts[kind]), self.sequences + a, 1, offset))
                    offset += lengths[kind]
                self.room.setdefault(self.capacity - offset, []).append((self.sequences + a, b - a))
            self.sequences += times
        rest = []
        for first, end in zip(at.tolist(), np.cumsum([n for _, n in sizes]).tolist()):
            while first < end:
                kind = int(np.searchsorted(starts, first, side="right")) - 1
                upto = min(end, int(starts[kind + 1]))
                rest.append((lengths[kind], first - int(starts[kind]), upto - first))
                first = upto
        return rest

    def _best_fit(self, counts: list[tuple[int, int, int]]) -> None:
        """(length, first number, pieces), longest first; a sequence takes as many pieces of a length as fit, as best fit goes on with what it has just filled."""
        rooms = list(self.room)
        heapq.heapify(rooms)
        for length, first, n in counts:
            passed, n = [], first + n
            while first < n:
                while rooms and rooms[0] < length:
                    passed.append(heapq.heappop(rooms))
                if not rooms:
                    self._open(length, first, n - first)
                    for room in self.opened:
                        heapq.heappush(rooms, room)
                    break
                room = rooms[0]
                stretches = self.room[room]
                sequence, some = stretches.pop()
                if not stretches:
                    heapq.heappop(rooms)
                    del self.room[room]
                each = room // length
                whole = min(some, (n - first) // each)
                offset = self.capacity - room
                if whole:
                    self.records.append((length, first, sequence, each, offset))
                    first += whole * each
                    self._add(room - each * length, sequence, whole, rooms, passed)
                if whole < some and first < n:
                    self.records.append((length, first, sequence + whole, n - first, offset))
                    self._add(room - (n - first) * length, sequence + whole, 1, rooms, passed)
                    whole, first = whole + 1, n
                if whole < some:
                    self._add(room, sequence + whole, some - whole, rooms, passed)
            for room in passed:
                heapq.heappush(rooms, room)

    def _add(self, room: int, sequence: int, some: int, rooms: list[int], passed: list[int]) -> None:
        if room in self.room:
            self.room[room].append((sequence, some))
        else:
            self.room[room] = [(sequence, some)]
            heapq.heappush(rooms, room)

    def _open(self, length: int, first: int, n: int) -> None:
        each = self.capacity // length
        whole, rest = divmod(n, each)
        self.opened = set()
        for some, copies in ((whole, each), (1 if rest else 0, rest)):
            if some:
                self.records.append((length, first, self.sequences, copies, 0))
                room = self.capacity - copies * length
                if room not in self.room:
                    self.room[room] = []
                    self.opened.add(room)
                self.room[room].append((self.sequences, some))
                self.sequences += some
                first += some * copies

    def arrays(self) -> tuple[np.ndarray, ...]:
        table = np.array(self.records, np.int64).reshape(-1, 5)
        return table[:, 0] << _NUMBER_BITS | table[:, 1], table[:, 2], table[:, 3], table[:, 4]


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest sequences over where large pieces begin."""
    return min((Plan(counts, capacity, capacity // part) for part in SMALL_PARTS), key=lambda plan: plan.sequences)


def places(arrays: tuple[np.ndarray, ...], length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces, by length and number among those of the length."""
    keys, sequence, each, offset = arrays
    at = np.searchsorted(keys, length << _NUMBER_BITS | number, side="right") - 1
    beyond = number - (keys[at] & ((1 << _NUMBER_BITS) - 1))
    return sequence[at] + beyond // each[at], offset[at] + beyond % each[at] * length


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` and (``with_ids``) ``ids`` of every piece."""
    cut = pieces(docs, vocabulary, end_id, capacity, with_ids)
    rows = numbered(cut if with_ids else cut.drop("ids"), "length", [])
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length
    shared = docs.sparkSession.sparkContext.broadcast(best_plan(counts, capacity).arrays())
    columns = [c for c in rows.columns if c != "number"]
    schema = PIECES.removesuffix(", ids binary") + ", sequence_id bigint, offset bigint" + (", ids binary" if with_ids else "")
    narrow = [c for c in columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places(shared.value, batch["length"].to_numpy().astype(np.int64), batch["number"].to_numpy())
            kept = [batch[c] for c in narrow] + [pa.array(sequence), pa.array(offset)] + ([batch["ids"]] if with_ids else [])
            yield pa.RecordBatch.from_arrays(kept, schema=fixed_schema(schema))

    out = rows.mapInArrow(run, schema)
    return out.withColumn("length", F.col("length").cast("long"))
