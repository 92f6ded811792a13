"""Set-overlap and substring matching between a large corpus and a set of questions.

The corpus side is hash partitioned by its row key once.  Question postings are
broadcast when their size is known to be small, so a corpus row meets all its
questions inside one task: pair counts are then aggregated where they arise and
only ranked results cross the network.  When the postings are too many to
broadcast, the same join runs shuffled, with the corpus side salted so that a
posting shared by a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import sqltext as S

BROADCAST_POSTINGS = 4_000_000
SALTS = 32
#: Lengths of the leading characters by which short texts are looked up.
ANCHOR_LENGTHS = (1, 2, 4, 8, 16)
#: Needle texts of at most this many bytes in all travel to every task.
BROADCAST_BYTES = 64 << 20
#: (gram size, distance of the places where a haystack is cut, least length of a needle)
GRAMS = ((1, 1, 1), (2, 1, 2), (2, 2, 3), (4, 2, 5), (6, 4, 9), (8, 8, 15), (16, 16, 31))

#: Bytes of haystacks that meet in one task, at least and at most, and of needles that they meet.
HAYSTACK_BYTES = (1 << 20, 48 << 20)
NEEDLE_BYTES = 16 << 20
#: The same where a pair of texts is asked for, as all needles stay in the search.
PAIR_NEEDLE_BYTES = 4 << 20


def within(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; stops counting beyond it."""
    return df.limit(limit + 1).count() <= limit


def posting_join(
    rows: DataFrame,
    postings: DataFrame,
    key: str,
    spread: str,
    small: bool,
    salts: int = SALTS,
) -> DataFrame:
    """Inner equi-join of exploded corpus ``rows`` with question ``postings`` on ``key``.

    ``small`` says whether the postings were checked to fit a broadcast.
    ``spread`` is the corpus row key; its hash gives the salt of the shuffled
    form, so the rows of one hot key are split evenly and no pair is lost.
    """
    if small:
        return rows.join(F.broadcast(postings), key)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = postings.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def salted_join(rows: DataFrame, others: DataFrame, keys: list[str], spread: str, salts: int = SALTS) -> DataFrame:
    """Inner equi-join for keys that may hold a large part of all ``rows``.

    The rows of a key are dealt to ``salts`` parts by the hash of ``spread``;
    ``others``, the smaller side, goes to every part.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = others.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def overlap_counts(
    corpus: DataFrame,
    corpus_id: str,
    corpus_items: Column,
    queries: DataFrame,
    query_id: str,
    query_items: Column,
    limit: int = BROADCAST_POSTINGS,
) -> DataFrame:
    """(corpus id, query id, number of shared items) for every pair sharing an item."""
    rows = corpus.select(corpus_id, corpus_items.alias("_items")).repartition(corpus_id)
    rows = rows.select(corpus_id, F.explode("_items").alias("_item"))
    postings = queries.select(query_id, F.explode(query_items).alias("_item"))
    return (
        posting_join(rows, postings, "_item", corpus_id, within(postings, limit))
        .groupBy(corpus_id, query_id)
        .agg(F.count(F.lit(1)).alias("shared"))
    )


def anchor_length(text: Column) -> Column:
    """The longest of the anchor lengths that fits the text."""
    size = F.length(text)
    result = F.lit(ANCHOR_LENGTHS[0])
    for length in ANCHOR_LENGTHS[1:]:
        result = F.when(size >= length, F.lit(length)).otherwise(result)
    return result


def anchor_sql(text: str) -> str:
    """SQL text of the leading characters."""
    steps = " ".join(f"when length({text}) >= {n} then {n}" for n in reversed(ANCHOR_LENGTHS))
    return f"substring({text}, 1, case {steps} else 1 end)"


def gram_class(text: str) -> str:
    """SQL: position in ``GRAMS`` of the class of a needle."""
    steps = " ".join(f"when length({text}) >= {least} then {i}" for i, (_, _, least) in reversed(list(enumerate(GRAMS))))
    return f"case {steps} else 0 end"


def needle_keys(text: str) -> str:
    """SQL: the grams by which a needle is found, one for every offset at which a haystack may have been cut."""
    cases = " ".join(
        f"when {i} then transform(sequence(0, {step - 1}), o{i} -> substring({text}, o{i} + 1, {size}))" for i, (size, step, _) in enumerate(GRAMS)
    )
    return f"array_distinct(case {gram_class(text)} {cases} end)"


def contains_pairs(
    haystacks: DataFrame,
    haystack_id: str,
    haystack_text: str,
    needles: DataFrame,
    needle_id: str,
    needle_text: str,
    limit: int = BROADCAST_POSTINGS,
    text_limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """(haystack id, needle id) where the needle text lies in the haystack text.

    Haystacks are cut into grams of *n* characters at every *s*-th place only; a needle of n + s - 1 characters or more
    covers a whole such gram wherever it lies, so it is looked up by its grams at the first *s* offsets.  Hits are
    verified on the whole texts.  Only keys and ids are exploded and sent around, never texts; needle texts join the
    hits, broadcast where their summed bytes are known to be few.
    """
    named = needles.where(F.length(needle_text) > 0).select(needle_id, F.col(needle_text).alias("_needle")).withColumn("_pin", F.md5("_needle"))
    pins = named.select("_pin", "_needle").dropDuplicates(["_pin"])  # equal texts are searched once
    facts = pins.agg(
        F.coalesce(F.sum(F.size(F.expr(needle_keys("_needle")))), F.lit(0)).alias("keys"),
        F.coalesce(F.sum(F.octet_length("_needle")), F.lit(0)).alias("bytes"),
        F.collect_set(F.expr(gram_class("_needle"))).alias("kinds"),  # at most len(GRAMS) values
    ).first()
    texts = haystacks.select(haystack_id, F.col(haystack_text).alias("_hay")).repartition(haystack_id)
    found = ", ".join([S.NO_TEXTS, *[S.cuts("_hay", *GRAMS[i][:2]) for i in sorted(facts["kinds"])]])
    keys = texts.select(haystack_id, F.expr(f"explode(array_distinct(concat({found})))").alias("_key"))
    postings = pins.select("_pin", F.explode(F.expr(needle_keys("_needle"))).alias("_key"))
    hits = posting_join(keys, postings, "_key", haystack_id, facts["keys"] <= limit).select(haystack_id, "_pin").distinct()
    hits = hits.join(F.broadcast(pins) if facts["bytes"] <= text_limit else pins, "_pin")
    held = hits.join(texts, haystack_id).where(F.contains("_hay", F.col("_needle"))).select(haystack_id, "_pin")
    return held.join(named.select("_pin", needle_id), "_pin").select(haystack_id, needle_id)


class Search:
    """Needles that are looked up in one text after the other until each is found.

    A needle of class (n, s) is known by one gram of *n* characters for each of the *s* offsets at which a text may have been
    cut: of all such grams inside the needle, the one that fewest needles hold.
    """

    def __init__(self, needles: list[str]):
        self.needles, self.open = needles, [True] * len(needles)
        classes: dict[int, list[int]] = {}
        for i, needle in enumerate(needles):
            classes.setdefault(max(c for c, (_, _, least) in enumerate(GRAMS) if len(needle) >= least), []).append(i)
        self.keys: list[tuple[int, int, dict[str, list[int]], set[str]]] = []
        for c, members in sorted(classes.items()):
            size, step, _ = GRAMS[c]
            often = Counter(needles[i][at : at + size] for i in members for at in range(len(needles[i]) - size + 1)) if step > 1 else Counter()
            keys: dict[str, list[int]] = {}
            for i in members:
                text = needles[i]
                for gram in {min((text[at : at + size] for at in range(o, len(text) - size + 1, step)), key=often.__getitem__) for o in range(step)}:
                    keys.setdefault(gram, []).append(i)
            self.keys.append((size, step, keys, set(keys)))

    def all_in(self, text: str) -> set[int]:
        """Places of all needles that this text holds."""
        found: set[int] = set()
        for size, step, keys, names in self.keys:
            for gram in names & {text[at : at + size] for at in range(0, len(text) - size + 1, step)}:
                found.update(i for i in keys[gram] if i not in found and self.needles[i] in text)
        return found

    def found_in(self, text: str) -> list[int]:
        """Places of the needles that this text is the first to hold."""
        found = []
        for size, step, keys, names in self.keys:
            if not names:
                continue
            for gram in names & {text[at : at + size] for at in range(0, len(text) - size + 1, step)}:
                left = [i for i in keys[gram] if self.open[i]]
                hits = {i for i in left if self.needles[i] in text}
                for i in hits:
                    self.open[i] = False
                found += hits
                left = [i for i in left if i not in hits]
                if left:
                    keys[gram] = left
                else:
                    del keys[gram]
                    names.discard(gram)
        return found


def block_counts(haystacks: DataFrame, size: Column, needles: DataFrame, needle_size: Column, group: str, haystack_bytes: tuple[int, int], needle_bytes: int) -> DataFrame:
    """(group, _parts, _blocks): into how many parts the haystacks and the needles of a group are dealt, so that each has bounded bytes."""
    sizes = haystacks.where(F.col(group).isNotNull()).groupBy(group).agg(F.sum(size).alias("_bytes"))
    least, most = haystack_bytes
    share = F.sum("_bytes").over(Window.partitionBy()) / (4 * haystacks.sparkSession.sparkContext.defaultParallelism)  # a row per group
    parts = F.ceil(F.col("_bytes") / F.greatest(F.lit(least), F.least(F.lit(most), share)))
    blocks = needles.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.sum(needle_size) / F.lit(needle_bytes))).cast("int").alias("_blocks"))
    return sizes.select(group, F.greatest(F.lit(1), parts).cast("int").alias("_parts")).join(blocks, group)


def one_group(column: str) -> Column:
    """The same group for all rows, not written as a constant: Spark turns a join on constants into a nested loop."""
    return F.pmod(F.xxhash64(column), F.lit(1)).cast("int").alias("_group")


def dealt_blocks(haystacks: DataFrame, haystack_id: str, needles: DataFrame, needle_id: str, group: str, counts: DataFrame, tasks: int = 0):
    """Both sides grouped by block, every part of the haystacks with every block of the needles of its group, to be put together by ``cogroup``.

    ``tasks``: how many tasks the blocks are dealt to where few bytes are much work; else Spark puts them together by their size.
    """
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    hay = haystacks.join(F.broadcast(counts), group).select(*haystacks.columns, deal(haystack_id, "_parts").alias("_part"), upto("_blocks").alias("_block"))
    pins = needles.join(F.broadcast(counts), group).select(*needles.columns, deal(needle_id, "_blocks").alias("_block"), upto("_parts").alias("_part"))
    if tasks:
        hay, pins = (side.repartition(tasks, group, "_part", "_block") for side in (hay, pins))
    return hay.groupBy(group, "_part", "_block"), pins.groupBy(group, "_part", "_block")


def held_in_group(
    haystacks: DataFrame, haystack_id: str, haystack_text: str, needles: DataFrame, needle_text: str, group: str, size: Column | None = None,
    haystack_bytes: tuple[int, int] = HAYSTACK_BYTES, needle_bytes: int = NEEDLE_BYTES,
) -> DataFrame:
    """Distinct (group, needle text) where the needle text lies in any haystack of its own group.

    No row is made for a (haystack, needle) pair.  Haystacks and needles of a group are dealt to blocks of bounded bytes, block
    meets block in one task, and a needle that a block's text holds is not looked for in its later ones.  ``size`` is a text's
    number of bytes where that, or a bound of it, is known without making the text.
    """
    texts = haystacks.select(group, haystack_id, F.col(haystack_text).alias("_hay"))
    wanted = needles.where(F.length(needle_text) > 0).select(group, F.col(needle_text).alias("_needle")).distinct()
    size = F.octet_length(haystack_text) if size is None else size
    counts = block_counts(haystacks, size, wanted, F.octet_length("_needle"), group, haystack_bytes, needle_bytes)
    hay, pins = dealt_blocks(texts, haystack_id, wanted, "_needle", group, counts)
    kind = haystacks.schema[group].dataType.simpleString()

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found, job = [], Search(right.column("_needle").to_pylist())
        for batch in left.select(["_hay"]).to_batches(256) if left.num_rows else []:
            for text in batch.column(0).to_pylist():
                found += job.found_in(text or "")
        return right.select([group, "_needle"]).take(pa.array(found, pa.int64()))

    return hay.cogroup(pins).applyInArrow(search, f"`{group}` {kind}, _needle string").distinct().withColumnRenamed("_needle", needle_text)


def held_pairs(
    haystacks: DataFrame, haystack_id: str, haystack_text: str, needles: DataFrame, needle_id: str, needle_text: str,
    haystack_bytes: tuple[int, int] = HAYSTACK_BYTES, needle_bytes: int = PAIR_NEEDLE_BYTES,
) -> DataFrame:
    """(haystack id, needle id) where the needle text lies in the haystack text, as ``contains_pairs``, found block against block.

    Nothing is broadcast and no row is made for a gram: only the pairs leave a task.
    """
    texts = haystacks.select(one_group(haystack_id), F.col(haystack_id), F.col(haystack_text).alias("_hay"))
    wanted = needles.where(F.length(needle_text) > 0).select(one_group(needle_id), F.col(needle_id), F.col(needle_text).alias("_needle"))
    counts = block_counts(texts, F.octet_length("_hay"), wanted, F.octet_length("_needle"), "_group", haystack_bytes, needle_bytes)
    hay, pins = dealt_blocks(texts, haystack_id, wanted, needle_id, "_group", counts, 4 * haystacks.sparkSession.sparkContext.defaultParallelism)
    kinds = [f"`{name}` {side.schema[name].dataType.simpleString()}" for side, name in ((haystacks, haystack_id), (needles, needle_id))]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        job, rows, places = Search(right.column("_needle").to_pylist()), [], []
        for at, text in enumerate(left.column("_hay").to_pylist() if right.num_rows else []):
            held = job.all_in(text or "")
            places += held
            rows += [at] * len(held)
        columns = [left.column(haystack_id).take(pa.array(rows, pa.int64())), right.column(needle_id).take(pa.array(places, pa.int64()))]
        return pa.table(columns, names=[haystack_id, needle_id])

    return hay.cogroup(pins).applyInArrow(search, ", ".join(kinds)).distinct()


def holder_counts(
    haystacks: DataFrame, haystack_id: str, haystack_text: str, kind: str, needles: DataFrame, needle_text: str, size: Column,
    haystack_bytes: tuple[int, int] = HAYSTACK_BYTES, needle_bytes: int = NEEDLE_BYTES,
) -> DataFrame:
    """(kind, needle text, hits): how many haystacks of each kind hold a needle, counted block against block."""
    one = F.lit(0).alias("_group")
    texts = haystacks.select(one, haystack_id, kind, F.col(haystack_text).alias("_hay"))
    wanted = needles.where(F.length(needle_text) > 0).select(one, F.col(needle_text).alias("_needle")).distinct()
    counts = block_counts(haystacks.select(one, size.alias("_size")), F.col("_size"), wanted, F.octet_length("_needle"), "_group", haystack_bytes, needle_bytes)
    hay, pins = dealt_blocks(texts, haystack_id, wanted, "_needle", "_group", counts)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        names = right.column("_needle").to_pylist()
        job, hits = Search(names), Counter()
        for batch in left.select([kind, "_hay"]).to_batches(256) if left.num_rows else []:
            for own, text in zip(*(column.to_pylist() for column in batch.columns)):
                hits.update((own, i) for i in job.all_in(text or ""))
        columns = [pa.array([own for own, _ in hits], pa.string()), pa.array([names[i] for _, i in hits], pa.string()), pa.array(list(hits.values()), pa.int64())]
        return pa.table(columns, names=[kind, "_needle", "hits"])

    found = hay.cogroup(pins).applyInArrow(count, f"`{kind}` string, _needle string, hits bigint")
    return found.groupBy(kind, F.col("_needle").alias(needle_text)).agg(F.sum("hits").alias("hits"))
