"""Table enrichment and snapshot commits against models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.operators import tables as B
from quillstone.sources import snapshots as S


def model(lines, title):
    """(ordinal, columns, rows, context) of every line that is the title."""
    for i, line in enumerate(lines):
        if line != title:
            continue
        island = []
        for near in lines[i + 1 : i + 13]:
            if "|" in near:
                island.append([c.strip() for c in near.split("|")])
            elif island:
                break
        rows = [dict(zip(island[0], r)) for r in island[1:] if len(r) >= len(island[0])] if island else []
        before = [x for x in reversed(lines[max(0, i - 7) : i]) if x and "|" not in x and not re.search(B.TABLE_LABEL, x)]
        yield i, island[0] if island else [], rows, before[0] if before else ""


def test_tables_of_captions(spark):
    r = random.Random(4)
    pool = ["cap a", "cap b", "", "表 2-3 x", "plain", "other words", "x | y", "1 | 2", "p | q | r", "| e", "a|a|b", "1|2|3|4"]
    docs = {d: [r.choice(pool) if r.random() < 0.5 else r.choice(pool[6:]) for _ in range(60)] for d in range(6)}
    rows = spark.createDataFrame([(d, i, t) for d, own in docs.items() for i, t in enumerate(own)], "doc_id int, ordinal int, text string")
    captions = spark.createDataFrame([("2-1", "表2-1", "cap a"), ("2-2", "表2-2", " cap b"), ("9-9", "x", "nowhere")], "label_key string, label string, title string")
    tables = B.captioned_tables(rows, captions)
    got = {(x.label_key, x.doc_id, x.ordinal): (x["columns"], x["rows"], x.context_before, x.extraction_status) for x in tables.collect()}
    want = {}
    for key, title in (("2-1", "cap a"), ("2-2", "cap b")):
        for d, own in docs.items():
            for i, columns, body, before in model(own, title):
                want[key, d, i] = (columns, body, before, "extracted" if columns and body else "needs_manual_review")
    assert got == want and {w[3] for w in want.values()} == {"extracted", "needs_manual_review"}
    resources = spark.createDataFrame(
        [("table_2_1", None, "", None, "use", ["k", "表2-1"]), ("r", "见表 2－2", "bound", "", "", None), ("r3", "no number", "draft", None, None, ["z"]), ("r4", "表 7-7", None, "", "", [])],
        "resource_id string, title string, status string, qa_use string, teaching_use string, keywords array<string>",
    )
    cards = spark.createDataFrame([("a2", ["table_2_1"]), ("a1", ["table_2_1", "r9"])], "answer_id string, recommended_resources array<string>")
    out = {x.resource_id: x for x in B.enrich_tables(resources, tables, cards).collect()}
    for rid, key in (("table_2_1", "2-1"), ("r", "2-2")):
        _, d, i = max(k for k in want if k[0] == key)
        columns, body, before, state = want[key, d, i]
        detail = out[rid].table_detail
        assert (out[rid].label_key, detail.doc_id, detail.ordinal, detail["columns"], detail["rows"], detail.context_before) == (key, d, i, columns, body, before)
        assert out[rid].unresolved == (state != "extracted")
        assert out[rid].status == ("structured" if state == "extracted" else "placeholder" if rid == "table_2_1" else "bound")
        assert out[rid].keywords[:2] == (["k", "表2-1"] if rid == "table_2_1" else ["表2-2", "2-2"])
    assert out["table_2_1"].related_answer_cards == ["a1", "a2"] and out["table_2_1"].teaching_use == "use" and out["table_2_1"].qa_use
    assert (out["r3"].label_key, out["r3"].table_detail, out["r3"].keywords, out["r3"].status, out["r3"].unresolved) == ("", None, ["z"], "draft", True)
    assert (out["r4"].label_key, out["r4"].table_detail, out["r4"].unresolved) == ("7-7", None, True)


def test_snapshots_change_in_one_step(spark, tmp_path):
    root = str(tmp_path / "kb")
    cards = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    points = spark.createDataFrame([("p",)], "id string")
    assert S.replace_snapshot({"cards": cards, "points": points}, root, "v1") == 1
    assert S.replace_snapshot({"cards": cards.where("x = 2"), "points": points}, root, "v 2/é") == 1
    rows = lambda table, *v: sorted(tuple(r) for r in S.read_snapshot(spark, root, table, *v).collect())
    assert rows("cards") == [("a", 1, "v1"), ("b", 2, "v 2/é"), ("b", 2, "v1")]
    # the writer dies after the first table, and after all tables but before the manifest: the old snapshot stands
    broken = cards.withColumn("x", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        S.replace_snapshot({"points": points.limit(0), "cards": broken}, root, "v1")
    assert rows("points", "v1") == [("p", "v1")]
    entries = S.stage_snapshot({"points": points.limit(0), "cards": cards.limit(0)}, root)
    assert rows("cards", "v1") == [("a", 1, "v1"), ("b", 2, "v1")]
    assert S.commit_snapshot(spark, root, "v1", entries, 1) == 2
    assert rows("cards", "v1") == [] and rows("points", "v1") == [] and rows("cards") == [("b", 2, "v 2/é")]
    # two writers that started from the same snapshot: the second one is told
    with pytest.raises(S.CommitConflict):
        S.commit_snapshot(spark, root, "v1", entries, 1)
    assert S.remove_unnamed(spark, root) == 4  # two of the first snapshot, two of the writer that died
    assert rows("cards") == [("b", 2, "v 2/é")] and S.read_snapshot(spark, root, "cards", "v1").columns == ["id", "x", "version_id"]
    with pytest.raises(ValueError, match="no snapshot"):
        S.read_snapshot(spark, root, "nothing")


def test_best_captions_before_tables_are_built(spark):
    """A line that is a caption of many numbers: the same best tables, picked before any lines are gathered."""
    lines = spark.createDataFrame([(d, i, t) for d in range(6) for i, t in enumerate(["same", "a|b", f"{d}|2", "end", "same"])], "doc_id bigint, ordinal bigint, text string")
    captions = spark.createDataFrame([(f"1-{n}", f"t{n}", "same") for n in range(4)], "label_key string, label string, title string")
    only = F.col("label_key") == F.concat(F.lit("1-"), (F.col("doc_id") % 4).cast("string"))
    shown = lambda df: sorted(str(r.asDict()) for r in df.select(*sorted(df.columns)).collect())
    every = B.captioned_tables(lines, captions).where(only)
    picked = B.captioned_tables(lines, captions, only=only, best=True)
    assert picked.count() == 4 and every.count() == 12
    assert shown(picked) == shown(B.best_tables(every))
