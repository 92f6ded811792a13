"""Rows that cannot be among a key's best are not measured, and the best stay."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillstone.functions.similarity import best_ratios


def test_best_rows_stay_and_hopeless_ones_are_not_measured(spark):
    r = random.Random(3)
    rows = []
    for key in ("a", "b"):
        asked = "".join(r.choices("abcdefgh", k=40))
        for line in range(300):
            text = asked[: r.randint(10, 38)] + "".join(r.choices("abcdefghxyz", k=20)) if line % 60 == 0 else "".join(r.choices("hijklmnop", k=30))
            known = 0.3 if line % 7 == 0 else None
            base = r.randint(0, 5) / 10
            rows.append((key, line // 2, line % 2, asked, text, known, base, base + 0.5 if known is None else known))
    df = spark.createDataFrame(rows, "k string, line int, place int, asked string, text string, t_known double, t_base double, high double").repartition(2, "line")
    found = best_ratios(df, "k", ["line"], [("t", "asked", "text", 0.5)], "high", lambda t: t, [], 3)
    scores = found.select("k", "line", "place", F.coalesce("t_known", F.col("t_base") + 0.5 * F.col("t_ratio")).alias("score")).collect()
    assert len(scores) < len(rows) / 2
    plain = [(k, line, place, base + 0.5 * SequenceMatcher(None, a, t).ratio() if known is None else known) for k, line, place, a, t, known, base, _ in rows]

    def best(hits):
        lines = {}
        for k, line, _, score in hits:
            lines[k, line] = max(lines.get((k, line), 0.0), score)
        return {k: sorted((s for (o, _), s in lines.items() if o == k), reverse=True)[:3] for k in "ab"}

    assert best([tuple(x) for x in scores if x["score"] is not None]) == best(plain)


def test_the_score_of_line_mapping_on_numbers_is_that_of_its_columns(spark):
    from quillstone.operators.align import mapping_score
    from quillstone.operators.mapping import _mapping_total

    steps = (0.0, 0.15, 0.2, 0.76, 0.88, 1.0)
    rows = [(t, d, e, s, m) for t in steps for d in steps for e in (0.1, 0.9) for s in (0.0, 0.2, 1.0) for m in (0, 2)]
    df = spark.createDataFrame(rows, "t double, d double, e double, s double, m int")
    found = df.select("*", mapping_score(*[F.col(c) for c in "tdesm"]).alias("score")).collect()
    assert all(abs(_mapping_total(x["t"], x["d"], x["e"], x["s"], x["m"], True) - x["score"]) < 1e-6 for x in found)
    assert _mapping_total(1.0, 1.0, 1.0, 1.0, 3, False) == 0.0
