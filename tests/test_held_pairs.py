"""Texts that lie in others, block against block: nothing is broadcast, whatever the number of texts."""

import random

from pyspark.sql import functions as F

from quillstone.operators.matching import held_pairs


def test_pairs_are_those_of_a_plain_search(spark):
    r = random.Random(8)
    say = lambda n: "".join(r.choices("abc 路口", k=n))
    hay = [(f"h{i}", say(r.randint(0, 60))) for i in range(80)] + [("h0", "again abc"), (None, "abc abc"), ("none", None)]
    needles = [(i, r.choice(hay[:80])[1][: r.randint(0, 40)] if i % 2 else say(r.randint(1, 5))) for i in range(60)] + [(99, None), (None, "abc")]
    left, right = spark.createDataFrame(hay, "h string, text string"), spark.createDataFrame(needles, "n int, needle string")
    right = right.select(F.struct("n").alias("n"), "needle")  # ids may be of any kind
    found = held_pairs(left, "h", "text", right, "n", "needle", (64, 256), 128)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((str(x.h), str(x.n[0])) for x in found.collect())
    assert got == sorted({(str(h), str(n)) for h, t in hay for n, x in needles if x and t and x in t})
