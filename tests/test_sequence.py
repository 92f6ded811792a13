"""The sequence matcher without its walk over all pairs of places gives difflib's ratios."""

import random
from difflib import SequenceMatcher

import models
from pyspark.sql import functions as F

from quillstone.functions import similarity
from quillstone.functions.sequence import Second


def some_texts(n):
    r = random.Random(11)
    for i in range(n):
        letters = r.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyzäöü0123456789路口"])
        long = i % 10 == 0
        a, b = ("".join(r.choices(letters, k=r.randint(0, 400 if long else 16))) for _ in range(2))
        at = r.randint(0, len(a))
        yield a, b[:150] + a[at : at + r.randint(0, 200)] + b[150:] if i % 20 == 0 else b


def test_matches_and_bounds_are_those_of_difflib():
    for a, b in some_texts(4000):
        plain = SequenceMatcher(None, a, b)
        total = sum(block.size for block in plain.get_matching_blocks())
        second = Second(b)
        assert second.ratio(a) == plain.ratio()
        for least in (total - 1, total, total + 1, total + 9):
            assert second.matched(a, least) == (total if total >= least else -1)


def test_similarity_of_many_texts_is_dealt_to_several_tasks(spark):
    """TXT-17 on whole texts, and its rows are not left in the one task that read their file."""
    from quillstone.operators.align import dealt

    rows = [(i, a, b) for i, (a, b) in enumerate(some_texts(300))] + [(-1, None, "abc"), (-2, "abc", None)]
    df = spark.createDataFrame(rows, "i int, a string, b string").coalesce(1)
    found = {r["i"]: r["s"] for r in dealt(df, "i").select("i", similarity.text_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert found.pop(-1) is None and found.pop(-2) is None
    assert all(abs(found[i] - models.similarity(a, b)) < 1e-12 for i, a, b in rows if i >= 0)
    assert dealt(df, "i").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_a_long_text_is_not_walked_pair_by_pair():
    """Fails with difflib's walk, which meets every pair of equal places once per block."""
    import time

    r = random.Random(2)
    pairs = [("".join(r.choices("abcdef", k=3000)), "".join(r.choices("abcdef", k=199))) for _ in range(3)]
    began = time.process_time()
    fast = [Second(b).ratio(a) for a, b in pairs]
    took = time.process_time() - began
    began = time.process_time()
    assert fast == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert took < (time.process_time() - began) / 2
