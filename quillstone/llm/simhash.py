"""SimHash near-duplicates with pivot distance tables.

Every distinct fingerprint has a row of Hamming distances to ``PIVOTS`` reference fingerprints, packed seven bits each.
By the triangle inequality two fingerprints at distance *d* differ by at most *d* in every coordinate, so a pair whose
largest coordinate difference exceeds *d* is discarded unseen; survivors are verified bit by bit.

Pairs meet without an all-pairs join: of six bit blocks at most two can differ within distance two, so linked
fingerprints agree on at least one choice of four blocks (about 42 bits): fifteen keys per distinct fingerprint.  Where
more than ``CROWDED`` distinct fingerprints share a key, its members are linked in another exact way: two
fingerprints are within distance two exactly if some value is within distance one of both, so every member goes to the
65 values around it, and those who meet (65 at most) are linked to their smallest.  The components are the same.

Exact copies are one fingerprint from the first aggregate on, however many they are.

Defined results: null and empty texts have fingerprint zero and link like any other; a component's id is its smallest
non-null document id (null if it has none); rows that repeat an id each get a row; extra columns are ignored; an empty
table gives no rows.

``near_copies`` is the wider net of a near-duplicate stage: five-word shingles, Jaccard similarity of ``SIMILAR`` fifths or more, which no 64
bits can tell apart.  The first candidates are those of SimHash and pivot tables as above, on the five-word sets' own fingerprints: the nearest copies, linked
by few pairs.  The others come from prefix filtering, which loses no pair: with all shingles in one order, two sets
that similar share one of their first ``size - ceil(0.8 size) + 1``.  The order (frequent shingles of a sample last, then by hash) decides
the work, never the result.  Before any set travels, pairs are cut by exact bounds: a *sketch* has a bit for every slot into which an odd
number of shingles falls, so the bits in which two sketches differ are at most the shingles in which the sets differ.  What is left is nearly
all similar; of every set one candidate is checked on whole sets first, then those that still join different components.
Where more than ``CROWDED`` sets share a shingle, those outside the shingle's largest component meet ``CENTERS`` members of it, others at every
turn but the same ones for all shingles, as long as a turn still links enough of them: a group of near copies takes pairs in proportion to its size.
Centers are those that share most crowded shingles, which the least changed copies do.
What is still in different components is then compared by sketches, members outside the shingle's largest component with all of other components.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillstone.llm.common import BASE, map_rows, mixed, scratch, small_batches, span_hashes, stored, text_bytes
from quillstone.llm.components import components

PIVOTS = 18
CROWDED = 256
SHINGLE = 3
#: The wider net: words of a shingle, similarity in fifths, centers of a crowd and most turns, sampled texts, occurrences that make a shingle frequent.
WIDE = 5
SIMILAR = 4
CENTERS = 2
TURNS = 12
SAMPLE, FREQUENT = 10_000, 3
#: A sketch has one to this many 64-bit words, about a bit a shingle; bits of the bitmap of sets that are needed.
SKETCH = 256
BITMAP = 1 << 25
#: Six blocks of a fingerprint's 64 bits, and the masks of every choice of four.
_BLOCKS = [sum(1 << b for b in range(lo, hi)) for lo, hi in ((0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64))]
_KEYS = [sum(c) for c in combinations(_BLOCKS, 4)]
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def references(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints: hashes of 0, 1, 2, ..."""
    return [xxh64_intdigest(b"pivot %d" % i, 42) for i in range(count)]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash of word shingles: a bit is set if more than half of the shingles' hashes have it."""
    words = _WORD.findall(text.lower())  # bytes.lower changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for lo in range(0, len(starts), 1 << 15):
        shingles = [joined[a:b] for a, b in zip(starts[lo : lo + (1 << 15)], ends[lo : lo + (1 << 15)])]
        total += bit_counts(np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles)))
    return _majority(total, len(starts))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, the highest first."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[lo : lo + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for part in range(0, len(bits), 255):
            total += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    return total


def _majority(total: np.ndarray, count: int) -> int:
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash`` (of the whole text) and ``fp`` (signed) of every document."""
    small_batches(docs.sparkSession)

    def work(batch: pa.RecordBatch):
        yield [batch["doc_id"].cast(pa.int64()), batch["text_hash"], [signed(fingerprint(t)) for t in text_bytes(batch, "text")]]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return map_rows(rows, work, "doc_id bigint, text_hash bigint, fp bigint")


def pivot_table(distinct: DataFrame) -> DataFrame:
    """Adds ``table``: the distances to all references, nine of seven bits in each 64-bit number."""
    packed = []
    pivots = references()
    for lo in range(0, len(pivots), 9):
        parts = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p)))).cast("long"), 7 * i) for i, p in enumerate(pivots[lo : lo + 9])]
        word = parts[0]
        for part in parts[1:]:
            word = word.bitwiseOR(part)
        packed.append(word.alias(f"table{lo // 9}"))
    return distinct.select("fp", *packed)


def pivots_allow(a: str, b: str, distance: int) -> Column:
    """Whether the largest coordinate difference is at most ``distance``."""
    fits = F.lit(True)
    for i in range(PIVOTS):
        left, right = (F.shiftright(F.col(f"{s}.table{i // 9}"), 7 * (i % 9)).bitwiseAND(F.lit(127)) for s in (a, b))
        fits = fits & (F.abs(left - right) <= distance)
    return fits


def links(distinct: DataFrame) -> DataFrame:
    """``a`` and ``b``: linked distinct fingerprints (distance two at most), enough to connect all that are linked."""
    keyed = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(_KEYS)])
    rows = pivot_table(distinct).withColumn("key", F.explode(keyed)).select("key.choice", "key.bits", "fp", *[f"table{i}" for i in range((PIVOTS + 8) // 9)])
    counts = rows.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    rows = rows.join(counts, ["choice", "bits"])
    meeting = stored(rows, "meeting")  # only keys that at least two share
    few = meeting.filter(F.col("members") <= CROWDED)
    same = (F.col("x.choice") == F.col("y.choice")) & (F.col("x.bits") == F.col("y.bits")) & (F.col("x.fp") < F.col("y.fp"))
    pairs = few.alias("x").join(few.alias("y"), same & pivots_allow("x", "y", 2) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 2))
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    crowd = meeting.filter(F.col("members") > CROWDED).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << b))) for b in range(64)])
    met = crowd.select("fp", F.explode(around).alias("center")).groupBy("center").agg(F.collect_list("fp").alias("near"))
    stars = met.filter(F.size("near") > 1).select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp``, ``component_id`` and ``root`` (the component's smallest fingerprint) of every document."""
    rows = stored(fingerprints(docs), "fingerprints")
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(firsts.select("fp")), "a", "b")
    return _labelled(rows, firsts, roots)


def _labelled(rows: DataFrame, firsts: DataFrame, roots: DataFrame) -> DataFrame:
    placed = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "placed")
    ids = placed.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    labels = stored(placed.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("p"), "component_id", "root"), "labels")
    return rows.join(labels, F.col("fp") == F.col("p")).select("doc_id", "text_hash", "fp", "component_id", "root")


def shingle_set(text: bytes, size: int = WIDE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles (of the whole text if it has fewer words)."""
    data = np.frombuffer(text.lower(), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    step = np.diff(inside)
    words = span_hashes(data, np.flatnonzero(step == 1), np.flatnonzero(step == -1))
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        total = (total + words[i : i + len(total)]) * np.uint64(BASE)
    return np.unique(mixed(total))


def prefix(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles in the order of all (frequent ones last), one more than a similar set can lack; how many of them are not frequent."""
    count = len(shingles) - -(-SIMILAR * len(shingles) // 5) + 1
    if not len(frequent) or not len(shingles):
        return shingles[:count], len(shingles[:count])
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    place = np.where(frequent[at] == shingles, rank[at] + 1, 0)
    chosen = np.argsort(place, kind="stable")[:count]
    return shingles[chosen], int((place[chosen] == 0).sum())


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles in 64 times a power of two slots; a smaller power's sketch is the xor of the larger one's halves."""
    words = 1
    while words < SKETCH and words * 64 < len(shingles):
        words *= 2
    slots = (shingles >> np.uint64(7)) & np.uint64(64 * words - 1)
    odd = np.bincount(slots.astype(np.int64), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that ``FREQUENT`` or more texts of a bounded sample share, sorted, and their ranks by number of texts."""

    def work(batch: pa.RecordBatch):
        for text in text_bytes(batch, "text"):
            yield [shingle_set(text).view(np.int64)]

    hashed = F.xxhash64(F.lit(5), "text")
    kinds = docs.select(F.approx_count_distinct(hashed)).first()[0]
    # a share of the texts by hash, so copies come or stay away together; only the sample is made distinct
    some = docs.filter(hashed.cast("double") / F.lit(2.0**64) + 0.5 < F.lit(SAMPLE / max(1, kinds))).select("text").distinct()
    counts = map_rows(some, work, "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT).toArrow()
    found, n = counts["shingle"].to_numpy().view(np.uint64), counts["n"].to_numpy()
    order = np.argsort(found)
    found, n = found[order], n[order]
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(n, kind="stable")] = np.arange(len(n))
    return found, rank


def shingled(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp`` (hash of the shingle set), its SimHash ``sim``, ``size``, ``prefix``, ``rare`` (how many of that the sample had not often) and ``sketch``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs))

    def work(batch: pa.RecordBatch):
        sets = [shingle_set(t) for t in text_bytes(batch, "text")]
        prints = [signed(xxh64_intdigest(s.tobytes(), 42)) for s in sets]
        prefixes = [prefix(s, *shared.value) for s in sets]
        yield [
            batch["doc_id"].cast(pa.int64()), batch["text_hash"], prints, [signed(_majority(bit_counts(s), len(s))) for s in sets], list(map(len, sets)), [p.view(np.int64) for p, _ in prefixes],
            [rare for _, rare in prefixes], [sketch(s) for s in sets],
        ]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return map_rows(rows, work, "doc_id bigint, text_hash bigint, fp bigint, sim bigint, size int, prefix array<bigint>, rare int, sketch array<bigint>", rows=2_000)


def _similar_size() -> Column:
    return (5 * F.col("x.size") >= SIMILAR * F.col("y.size")) & (5 * F.col("y.size") >= SIMILAR * F.col("x.size"))


def _sketches_allow(a: str, b: str, sizes: Column) -> Column:
    """Whether sets of ``sizes`` shingles in all can be similar: they may differ in a ninth of them."""
    folded = lambda s: F.zip_with(F.slice(s, 1, (F.size(s) / 2).cast("int")), F.slice(s, (F.size(s) / 2 + 1).cast("int"), (F.size(s) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    # similar sets' sketches have the same size or one has twice the other's
    left = F.when(F.size(a) > F.size(b), folded(F.col(a))).otherwise(F.col(a))
    right = F.when(F.size(b) > F.size(a), folded(F.col(b))).otherwise(F.col(b))
    differ = F.aggregate(F.zip_with(left, right, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)
    return (5 + SIMILAR) * differ <= sizes * (5 - SIMILAR)


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs ``a``, ``b`` whose sketches allow them to be similar."""
    sides = [sets.select(F.col("fp").alias(k), F.col("size").alias(f"size_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    return joined.filter(_sketches_allow("sketch_a", "sketch_b", F.col("size_a") + F.col("size_b"))).select("a", "b")


def _needed_sets(pairs: DataFrame, docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """``fp`` and ``shingles`` of the sets in ``pairs``, each once.

    A bitmap of fixed size tells tasks which documents stand for a needed set; only sets leave them, and only those that the bitmap
    cannot tell from needed ones are sent in vain.
    """
    key = F.xxhash64("doc_id", "text_hash")
    ends = pairs.select(F.col("a").alias("p")).distinct().unionByName(pairs.select(F.col("b").alias("p")).distinct())
    needed = stored(ends.distinct(), "needed")
    marks = needed.join(firsts, F.col("p") == F.col("fp")).select(F.xxhash64("first_id", "first_hash").bitwiseAND(F.lit(BITMAP - 1)).alias("slot"))
    marks = marks.groupBy(F.shiftright("slot", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("b"))
    table = np.zeros(BITMAP // 32, np.uint32)
    for part in marks.toArrow().to_batches():  # four megabytes, whatever the corpus
        table[part["w"].to_numpy()] = part["b"].to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint8))

    def work(batch: pa.RecordBatch):
        slots = batch["key"].to_numpy() & (BITMAP - 1)
        hit = (shared.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
        sets = [shingle_set(t) for t in text_bytes(batch.filter(pa.array(hit)), "text")]
        yield [[signed(xxh64_intdigest(s.tobytes(), 42)) for s in sets], [s.view(np.int64) for s in sets]]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").select(key.alias("key"), "text")
    found = map_rows(rows, work, "fp bigint, shingles array<bigint>", rows=500)
    return stored(found.join(needed, F.col("fp") == F.col("p"), "left_semi").dropDuplicates(["fp"]), "sets")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs whose shingle sets are similar: |s & t| / |s | t| >= 4 / 5."""
    left, right = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("fp").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    return stored(pairs.join(right, "b").join(left, "a").filter((5 + SIMILAR) * both >= SIMILAR * (F.size("s") + F.size("t"))).select("a", "b"), "similar")


def _across(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Those pairs whose ends the links have not brought together."""
    roots = stored(components(links, "a", "b"), "roots")
    out = pairs
    for k in "ab":
        out = out.join(roots.select(F.col("node").alias(f"n_{k}"), F.col("root").alias(f"r_{k}")), F.col(k) == F.col(f"n_{k}"), "left")
    return out.filter(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).select("a", "b")


def _linked(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, early: DataFrame | None = None) -> DataFrame:
    """Links among ``pairs``, enough to connect all that are similar: ``early`` ones and one pair of every set first, then those still apart."""
    some = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    if early is not None:
        some, pairs = stored(some.unionByName(early).distinct(), "some"), pairs.unionByName(early)
    sets = _needed_sets(pairs, docs, firsts)
    first = _similar(some, sets)
    return first.unionByName(_similar(stored(_across(pairs, first), "apart"), sets))


def _print_pairs(sets: DataFrame) -> DataFrame:
    """``a`` and ``b``: sets whose SimHashes are equal or linked, each SimHash standing for its smallest set; enough to connect all such."""
    prints = stored(sets.groupBy("sim").agg(F.min("fp").alias("one")), "prints")
    equal = sets.join(prints, "sim").select(F.col("one").alias("a"), F.col("fp").alias("b")).filter("a <> b")
    near = links(prints.select(F.col("sim").alias("fp"))).withColumnsRenamed({"a": "sim_a", "b": "sim_b"})
    for k in "ab":
        near = near.join(prints.select(F.col("sim").alias(f"sim_{k}"), F.col("one").alias(f"one_{k}")), f"sim_{k}")
    return equal.unionByName(near.select(F.least("one_a", "one_b").alias("a"), F.greatest("one_a", "one_b").alias("b")))


def _wide_links(sets: DataFrame, docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """``a`` and ``b``: linked shingle sets (similarity of ``SIMILAR`` fifths at least), enough to connect all that are linked."""
    # a shingle that the sample has not often is in few texts: its rows are counted where they meet
    rare = sets.select(F.explode(F.slice("prefix", F.lit(1), F.col("rare"))).alias("key"), "fp", "size").repartition("key")
    rare = rare.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("members > 1")
    # one that it has often may be in very many: counts are combined before the shuffle, and a join Spark can split brings them back
    often = sets.select(F.explode(F.slice("prefix", F.col("rare") + 1, F.size("prefix"))).alias("key"), "fp", "size")
    counts = often.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    often = often.join(counts, F.col("key") == F.col("k")).select("key", "fp", "size", "members")
    meeting = stored(rare.unionByName(often), "meeting")
    many = F.col("members") > CROWDED
    few, crowd = meeting.filter(~many), meeting.filter(many)
    same = (F.col("x.key") == F.col("y.key")) & _similar_size()
    ends = [F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")]
    pairs = few.alias("x").join(few.alias("y"), same & (F.col("x.fp") < F.col("y.fp"))).select(ends)
    pairs = stored(_plausible(stored(pairs.distinct(), "pairs"), sets), "plausible")
    first = _linked(pairs, docs, firsts, stored(_plausible(_print_pairs(sets), sets), "prints"))
    if crowd.isEmpty():
        return first
    first = _turns(crowd, first, sets, docs, firsts)
    crowd = _rooted(crowd, first)
    # sets are compared within (shingle, size class): similar sizes lie in the same class or in neighbouring ones
    crowd = crowd.join(sets.select(F.col("fp").alias("f"), "sketch"), F.col("fp") == F.col("f")).drop("f")
    crowd = stored(crowd.withColumn("class", F.floor(F.log(F.col("size") + 0.0) / F.log(F.lit(1.25)))), "crowd")
    near = crowd.filter(~F.col("most")).withColumn("class", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])))
    apart = same & (F.col("x.class") == F.col("y.class")) & (F.col("x.root") != F.col("y.root")) & (F.col("y.most") | (F.col("x.fp") < F.col("y.fp")))
    allowed = _sketches_allow("x.sketch", "y.sketch", F.col("x.size") + F.col("y.size"))
    rest = stored(near.alias("x").join(crowd.alias("y"), apart & allowed).select(ends).distinct(), "rest")
    return first.unionByName(_linked(rest, docs, firsts))


def _rooted(crowd: DataFrame, links: DataFrame) -> DataFrame:
    """``key``, ``fp``, ``size``, ``root`` of every member of a crowd, and whether that is the shingle's largest component."""
    roots = stored(components(links, "a", "b"), "roots")
    crowd = crowd.join(roots, F.col("fp") == F.col("node"), "left").select("key", "fp", "size", F.coalesce("root", "fp").alias("root"))
    parts = crowd.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("n", "root")).alias("most"))
    return crowd.join(largest, F.col("key") == F.col("k")).select("key", "fp", "size", "root", (F.col("root") == F.col("most.root")).alias("most"))


def _turns(crowd: DataFrame, links: DataFrame, sets: DataFrame, docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """``links`` and those of members outside a shingle's largest component with a few of that component, turn by turn.

    The order of the centers does not depend on the shingle, so shingles of one group ask for the same pairs.  Turns end when one links less than
    an eighth of those that are outside: whatever they leave is compared as a whole.
    """
    crowds = stored(crowd.groupBy(F.col("fp").alias("f")).agg(F.count(F.lit(1)).alias("crowds")), "crowds")
    for turn in range(TURNS):
        rooted = stored(_rooted(crowd, links), "rooted")
        outside = rooted.filter(~F.col("most"))
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("crowds"), F.xxhash64("fp"), "fp"))
        inside = rooted.filter("most").join(crowds, F.col("fp") == F.col("f"))
        centers = inside.withColumn("place", place).filter((F.col("place") <= (turn + 1) * CENTERS) & (F.col("place") > turn * CENTERS))
        ends = [F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")]
        stars = centers.alias("x").join(outside.alias("y"), (F.col("x.key") == F.col("y.key")) & _similar_size()).select(ends).distinct()
        found = _linked(stored(_plausible(stars, sets), "plausible"), docs, firsts)
        links = stored(links.unionByName(found), "linked")
        if 8 * found.count() <= outside.select("fp").distinct().count():
            break
    return links


def near_copies(docs: DataFrame) -> DataFrame:
    """As ``near_duplicates``, of five-word shingle sets of similarity 0.8 or more; ``fp`` is the hash of the set."""
    with scratch(docs.sparkSession):
        rows = stored(shingled(docs), "shingled")
        firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_hash")).alias("one"))
        firsts = stored(firsts.select("fp", "first", F.col("one.doc_id").alias("first_id"), F.col("one.text_hash").alias("first_hash")), "firsts")
        # one row a set: that of its first document, equal rows counted once
        of_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
        named = firsts.select(F.col("fp").alias("f"), "first_id", "first_hash")
        sets = rows.join(named, F.col("fp") == F.col("f")).filter(of_first).select("fp", "sim", "size", "prefix", "rare", "sketch").dropDuplicates(["fp"])
        roots = components(_wide_links(stored(sets, "distinct"), docs, firsts), "a", "b")
        return stored(_labelled(rows, firsts, roots), "near_copies", keep=True)


def one_of_each(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The documents that stay: of every component the one of smallest id (null ids last), of equal rows one."""
    found = groups(docs).filter("component_id is null or doc_id = component_id")
    # whole numbers without nulls as keys: the join's partitioning then serves the window too, and texts are shuffled once
    named = lambda text_hash: [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_own_id_"), F.xxhash64(text_hash, F.col("doc_id").isNull()).alias("_own_hash_")]
    kept = found.groupBy("doc_id", "root").agg(F.min("text_hash").alias("text_hash")).select(*named(F.col("text_hash")))
    joined = docs.select("*", *named(F.xxhash64("text"))).join(kept, ["_own_id_", "_own_hash_"])
    one = Window.partitionBy("_own_id_", "_own_hash_").orderBy("source", "lang")
    return joined.withColumn("_copy_", F.row_number().over(one)).filter("_copy_ = 1").select(*docs.columns)
