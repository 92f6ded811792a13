"""Merkle manifest of a dataset by time-forward processing.

Every document is a leaf; per language the leaves form a tree in which ``FAN`` consecutive nodes become one, until one is left
(the language's subroot), and the subroots likewise form the tree of the root.  A digest ``H`` is the lower-case hex SHA-256
of its inputs, child digests as hex text, one after the other.

*Blocks.*  A tree is cut into blocks of ``FAN ** LEVELS`` (512) neighbouring leaves, dealt out by (tree, block), so the tree that
holds a third of all leaves is spread as well.  A block yields one digest; the blocks of a round are the leaves of the next, until
every tree has one node: a round for every ``LEVELS`` levels, each a table 512 times smaller than the one before.

*Forward sweep* (inside a task, over all its blocks).  Nodes are labelled level by level, left to right, so a child's label
is below its parent's.  A node that has its digest sends it to its parent's label through an external priority queue ordered
by label (sorted runs on disk beyond ``QUEUE_BYTES``); the node whose label comes next takes all messages at the head of the queue:
its children, in order.  No node looks anything up.

*Reverse sweep.*  The same labels downwards: a node receives the proof suffix of everything above it, and sends each child that
suffix with the child's siblings in front.  Between rounds the suffixes of blocks travel as rows of a table, to the
tasks that hold the blocks' leaves.

Spilled runs live in a scratch folder of the task's attempt (nobody else reads them, a retry writes its own); everything that
passes between tasks is a table in the shared folder.

Defined results: a null value is ``-`` in a leaf, an empty one ``0:``; a null language is a tree of its own, first in order; null ids
precede other ids and are never tampered with; rows that repeat an id are leaves of their own, ordered by digest; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import struct
import tempfile
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import fixed_schema, stored
from quillstone.llm.numbering import numbered

FAN = 8
#: Levels of a block (512 leaves), and bytes of messages that a queue keeps in memory.
LEVELS = 3
QUEUE_BYTES = 32 << 20
#: A tree's name and size; fewer trees than this travel to every task.
SMALL_TREES = 50_000


def digest(parts: list[bytes]) -> bytes:
    return sha256(b"".join(p.hex().encode() for p in parts)).digest()


class LabelQueue:
    """External priority queue: messages come out by label, those of one label in the order of sending."""

    def __init__(self, limit: int = QUEUE_BYTES):
        self.limit, self.sent, self.bytes = limit, 0, 0
        self.heap: list[tuple[int, int, bytes]] = []
        self.runs: list[tuple[int, int, bytes, Iterator]] = []  # the heads of the runs on disk, a heap of their own

    def send(self, label: int, message: bytes) -> None:
        heapq.heappush(self.heap, (label, self.sent, message))
        self.sent += 1
        self.bytes += len(message) + 120
        if self.bytes > self.limit:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        for label, number, message in sorted(self.heap):
            file.write(struct.pack("<qqi", label, number, len(message)) + message)
        file.seek(0)
        self.heap, self.bytes = [], 0
        self._advance(self._read(file))

    @staticmethod
    def _read(file) -> Iterator[tuple[int, int, bytes]]:
        with file:
            while head := file.read(20):
                label, number, size = struct.unpack("<qqi", head)
                yield label, number, file.read(size)

    def _advance(self, run: Iterator) -> None:
        if (head := next(run, None)) is not None:
            heapq.heappush(self.runs, (*head, run))

    def take(self, label: int) -> list[bytes]:
        """All messages for ``label``; labels are asked for in ascending order."""
        out = []
        while True:
            mine = bool(self.heap) and self.heap[0][0] == label
            stored_one = bool(self.runs) and self.runs[0][0] == label
            if mine and (not stored_one or self.heap[0][1] < self.runs[0][1]):
                _, _, message = heapq.heappop(self.heap)
                self.bytes -= len(message) + 120
            elif stored_one:
                _, _, message, run = heapq.heappop(self.runs)
                self._advance(run)
            else:
                return out
            out.append(message)


def widths(leaves: int, tree: int, levels: int = LEVELS) -> list[int]:
    """Numbers of nodes of a block's levels: up to one node, or all ``levels`` where the tree goes on above the block."""
    out = [leaves]
    while len(out) <= levels and (tree > FAN**levels or out[-1] > 1):
        out.append(-(-out[-1] // FAN))
    return out


class Forest:
    """The blocks of one task: forward and reverse sweep over their nodes.

    A label is (level, number in the level, counted over all blocks); with ``keep`` the runs of children are kept in label
    order on disk, for the reverse sweep to read backwards.
    """

    def __init__(self, keep: bool, levels: int = LEVELS, limit: int = QUEUE_BYTES):
        self.levels, self.limit = levels, limit
        self.blocks: list[list[int]] = []  # widths of every block
        self.sizes = [0] * (levels + 1)  # nodes of every level so far
        self.up = LabelQueue(limit)
        self.keep = keep
        self.tops: list[bytes] = []
        self.file = tempfile.TemporaryFile() if keep else None
        self.places: list[list[tuple[int, int]]] = [[] for _ in range(levels + 1)]  # (offset, children) of the runs of each level

    def add_block(self, leaves: list[bytes], tree: int) -> None:
        levels = widths(len(leaves), tree, self.levels)
        self.blocks.append(levels)
        if len(levels) == 1:
            self.tops.append(leaves[0])
            return
        self.tops.append(b"")
        for i, leaf in enumerate(leaves):
            self.up.send(self._label(1, self.sizes[1] + i // FAN), leaf)
        for level in range(1, len(levels)):
            self.sizes[level] += levels[level]

    @staticmethod
    def _label(level: int, number: int) -> int:
        return level << 48 | number

    def forward(self) -> list[bytes]:
        """The digest of every block's last level, in the order of ``add_block``."""
        for level in range(1, self.levels + 1):
            number = above = 0
            for at, levels in enumerate(self.blocks):
                if len(levels) <= level:
                    continue
                for i in range(levels[level]):
                    children = self.up.take(self._label(level, number))
                    number += 1
                    if self.keep:
                        self.places[level].append((self.file.tell(), len(children)))
                        self.file.write(b"".join(children))
                    node = digest(children)
                    if len(levels) > level + 1:
                        self.up.send(self._label(level + 1, above + i // FAN), node)
                    else:
                        self.tops[at] = node
                above += levels[level + 1] if len(levels) > level + 1 else 0
        return self.tops

    def reverse(self, suffixes: list[tuple[bytes, str]]) -> Iterator[tuple[int, int, bytes, str]]:
        """(block, leaf's place in it, proof, shape) of every leaf, last block and leaf first.

        A proof is the digests of a leaf's siblings, level by level; its shape has two figures a level: siblings before
        and after.  Labels run downwards, so the queue is ordered by the negated label.
        """
        down = LabelQueue(self.limit)
        numbers = list(self.sizes)
        for level in range(self.levels, 0, -1):
            below = numbers[level - 1] if level > 1 else 0
            for at in range(len(self.blocks) - 1, -1, -1):
                levels = self.blocks[at]
                if level > 1 and len(levels) > level - 1:
                    below -= levels[level - 1]
                if len(levels) <= level:
                    continue
                for i in range(levels[level] - 1, -1, -1):
                    numbers[level] -= 1
                    if len(levels) == level + 1:
                        suffix, shape = suffixes[at]
                    else:
                        (message,) = down.take(-self._label(level, numbers[level]))
                        length = message[0]
                        suffix, shape = message[1 + length :], message[1 : 1 + length].decode()
                    offset, n = self.places[level][numbers[level]]
                    self.file.seek(offset)
                    run = self.file.read(32 * n)
                    for k in range(n - 1, -1, -1):
                        proof = run[: 32 * k] + run[32 * k + 32 :] + suffix
                        path = f"{k}{n - 1 - k}{shape}"
                        if level == 1:
                            yield at, i * FAN + k, proof, path
                        else:
                            down.send(-self._label(level - 1, below + i * FAN + k), bytes([len(path)]) + path.encode() + proof)
        for at in range(len(self.blocks) - 1, -1, -1):
            if len(self.blocks[at]) == 1:
                yield at, 0, *suffixes[at]


def folded(leaf: bytes, proof: bytes, shape: str) -> bytes:
    """The root that a leaf and its siblings give."""
    at = 0
    for left, right in zip(map(int, shape[::2]), map(int, shape[1::2])):
        run = [proof[32 * k : 32 * k + 32] for k in range(at, at + left + right)]
        leaf = digest([*run[:left], leaf, *run[left:]])
        at += left + right
    return leaf


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``tree`` (``-`` for a null language, else ``v`` and the language) and the leaf's 32 bytes."""
    fields = ("doc_id", "source", "lang", "n_chars")
    whole = lambda text: F.unhex(F.sha2(F.concat(*[_field(F.col(c)) for c in fields], _field(text)), 256))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(F.col("text"), capitals, capitals.lower())
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    tampered = F.when(hit & (lowered != F.col("text")), whole(lowered))
    tree = F.coalesce(F.concat(F.lit("v"), F.col("lang")), F.lit("-"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), whole(F.col("text")).alias("digest"), tampered.alias("tampered"))


def _with_sizes(nodes: DataFrame) -> DataFrame:
    """Adds ``n``, the number of nodes of the row's tree."""
    sizes = nodes.groupBy(F.col("tree").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes, "sizes")
    if sizes.limit(SMALL_TREES + 1).count() <= SMALL_TREES:
        sizes = F.broadcast(sizes)
    return nodes.join(sizes, F.col("tree") == F.col("t")).drop("t")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block after the other; a block has at most ``FAN ** LEVELS`` + 1 rows."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["tree"], row["block"]) != (rows[0]["tree"], rows[0]["block"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _per_block(nodes: DataFrame, work: Callable, schema: str) -> DataFrame:
    ordered = nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "number")
    return ordered.mapInArrow(work, schema)


#: Blocks of one sweep, without and with the leaves' rows in memory; beyond it a task starts the next one.
SWEEP = (4096, 256)


def _sweeps(batches: Iterator[pa.RecordBatch], keep: bool, sizes: tuple[int, int]) -> Iterator[tuple[Forest, list[list[dict]], list[dict]]]:
    """Forests of up to ``SWEEP`` blocks, with every block's leaves and the row that carries its suffix (if any)."""
    forest, blocks, heads = Forest(keep, *sizes), [], []
    for rows in _blocks(batches):
        head = rows[0] if rows[0]["number"] < 0 else {}
        own = rows[1:] if head else rows
        forest.add_block([r["digest"] for r in own], own[0]["n"])
        blocks.append(own if keep else own[:1])
        heads.append(head)
        if len(blocks) == SWEEP[keep]:
            yield forest, blocks, heads
            forest, blocks, heads = Forest(keep, *sizes), [], []
    if blocks:
        yield forest, blocks, heads


NODES = "tree string, number bigint, digest binary, n bigint"


def _raised(nodes: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """The next round's nodes: one per block."""
    of_block = FAN ** sizes[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for forest, blocks, _ in _sweeps(batches, False, sizes):
            rows = [(b[0]["tree"], b[0]["block"], top, -(-b[0]["n"] // of_block)) for b, top in zip(blocks, forest.forward())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), fixed_schema(NODES))], schema=fixed_schema(NODES))

    block = F.floor(F.col("number") / of_block).cast("long")
    return _per_block(nodes.select("tree", block.alias("block"), "number", "digest", "n"), work, NODES)


def _rounds(nodes: DataFrame, sizes: tuple[int, int]) -> list[DataFrame]:
    """The nodes of every round, the last of which has one node a tree."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(stored(_raised(out[-1], sizes), "round"))
        most = -(-most // FAN ** sizes[0])
    return out


SUFFIX = "tree string, number bigint, proof binary, shape string, subroot binary"
LEAF = "tree string, number bigint, proof binary, shape string, subroot binary, doc_id bigint, digest binary, tampered binary"
FINAL = "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string, proof string, shape string"


def _lowered(
    nodes: DataFrame, suffixes: DataFrame, sizes: tuple[int, int], finish: Callable[[dict, bytes, str, bytes | None], tuple], schema: str
) -> DataFrame:
    """``finish`` of every node of a round, its proof and shape; ``suffixes``: those of the round's blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = fixed_schema(schema)
        for forest, blocks, heads in _sweeps(batches, True, sizes):
            forest.forward()
            rows = []
            for at, i, proof, shape in forest.reverse([(h["proof"], h["shape"]) for h in heads]):
                rows.append(finish(blocks[at][i], proof, shape, heads[at]["subroot"]))
                if len(rows) == 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), out)], schema=out)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), out)], schema=out)

    empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
    own = nodes.select(
        "tree", F.floor(F.col("number") / FAN ** sizes[0]).cast("long").alias("block"), "number", "digest", "n",
        *[F.col(c) if c in nodes.columns else empty(t, c) for c, t in (("doc_id", "bigint"), ("tampered", "binary"))],
        empty("binary", "proof"), empty("string", "shape"), empty("binary", "subroot"),
    )
    above = suffixes.select(
        "tree", F.col("number").alias("block"), F.lit(-1).cast("long").alias("number"), empty("binary", "digest"), empty("bigint", "n"),
        empty("bigint", "doc_id"), empty("binary", "tampered"), "proof", "shape", "subroot",
    )
    return _per_block(own.unionByName(above), work, schema)


def _suffixed(rounds: list[DataFrame], tops: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """Suffixes of the blocks of the first round, from those of the trees' last nodes."""
    for nodes in reversed(rounds[1:]):
        finish = lambda r, proof, shape, subroot: (r["tree"], r["number"], proof, shape, subroot)
        # of the last round every tree has one node, which is a block of its own
        tops = stored(_lowered(nodes, tops, sizes, finish, SUFFIX), "suffixes")
    return tops


def merkle_manifest(docs: DataFrame, with_proof: bool = True, levels: int = LEVELS, queue_bytes: int = QUEUE_BYTES) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` and (``with_proof``) ``proof`` and ``shape``."""
    sizes = (levels, queue_bytes)
    rows = numbered(leaves(docs), "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()])
    rows = stored(_with_sizes(rows), "numbered")
    rounds = _rounds(rows, sizes)
    upper = numbered(rounds[-1].select("tree", "digest", F.lit("root").alias("all_")), "all_", [F.col("tree").asc()])
    named = stored(_with_sizes(upper.select(F.col("tree").alias("name"), F.col("all_").alias("tree"), "number", "digest")), "upper")
    upper_rounds = _rounds(named, sizes)
    top = upper_rounds[-1].select("digest").first()
    root = top["digest"] if top else b""
    nothing = F.lit(b"")
    above = upper_rounds[-1].select("tree", "number", nothing.alias("proof"), F.lit("").alias("shape"), F.lit(None).cast("binary").alias("subroot"))
    above = _suffixed(upper_rounds, above, sizes)
    per_tree = lambda r, proof, shape, _: (r["tree"], r["number"], proof, shape, r["digest"])
    above = stored(_lowered(upper_rounds[0], above, sizes, per_tree, SUFFIX), "subroot_suffixes")
    above = above.join(named.select(F.col("number").alias("k"), "name"), F.col("number") == F.col("k"))
    above = above.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("number"), "proof", "shape", "subroot")
    above = _suffixed(rounds, above, sizes)

    def finish(r: dict, proof: bytes, shape: str, subroot: bytes) -> tuple:
        hexed = proof.hex()
        back = folded(r["tampered"] or r["digest"], proof, shape)
        return r["doc_id"], r["digest"].hex(), subroot.hex(), sha256(hexed.encode()).hexdigest(), back.hex(), hexed if with_proof else None, shape

    found = _lowered(rows, above, sizes, finish, FINAL).withColumn("root", F.lit(root.hex()))
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
    return found.select(*columns, *(("proof", "shape") if with_proof else ()))
