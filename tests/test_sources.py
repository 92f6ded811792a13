import json

import pytest
from pyspark.sql import functions as F

from quillstone.operators import evaluate, merge, quality, review
from quillstone.sources import documents as D
from quillstone.sources import packages as P
from quillstone.sources import sinks as S


def test_packages(spark, tmp_path):
    folder = tmp_path / "ch07"
    folder.mkdir()
    (folder / "kb.json").write_text(json.dumps({"metadata": {"a": 1}, "Answer_Cards": [{"answer_id": "x"}, {"answer_id": "y"}]}), "utf-8")
    rows = P.read_packages(spark, f"{tmp_path}/*/*.json")
    cards = P.package_table(rows, "Answer_Cards", "answer_id string").collect()
    assert [(r.chapter_id, r.ordinal, r.answer_id) for r in cards] == [("ch07", 0, "x"), ("ch07", 1, "y")]
    assert P.package_table(rows, "Resources", "resource_id string").count() == 0
    assert {(r.table_name, r.rows) for r in P.table_counts(rows).collect()} == {("metadata", 1), ("Answer_Cards", 2)}
    (folder / "bad.json").write_text("[1]", "utf-8")
    with pytest.raises(Exception, match="not an object"):
        P.read_packages(spark, f"{tmp_path}/*/bad.json").collect()


def test_vectors_round_trip_and_encoder(spark, tmp_path):
    texts = spark.createDataFrame([(f"e{i}", "answer_card", f"a{i}", "t" * (i + 1)) for i in range(20)], "embedding_id string, source_type string, source_id string, embedding_text string")
    vectors = P.embed(texts, lambda batch: [[float(len(t)), 1.0] for t in batch], "bge-m3")
    S.write_vectors(vectors, f"{tmp_path}/v")
    back = P.read_vectors(spark, f"{tmp_path}/v")
    assert back.count() == 20 and back.agg(F.sum(F.col("embedding")[0])).first()[0] == 210.0
    with pytest.raises(Exception, match="vectors for"):
        P.embed(texts, lambda batch: [], "m").collect()


def test_word_tables_and_pages(spark):
    xml = (
        '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
        '<w:p><w:pPr><w:pStyle w:val="TOC1"/></w:pPr><w:r><w:t>第1章</w:t><w:tab/><w:t>概述</w:t></w:r></w:p><w:p/>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        "</w:body></w:document>"
    )
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("word/document.xml", xml)
    files = spark.createDataFrame([("f", bytearray(buffer.getvalue()))], "path string, content binary")
    rows = D.read_word(files).orderBy("ordinal").collect()
    assert [(r.kind, r.style, r.text) for r in rows] == [("paragraph", "TOC1", "第1章 概述"), ("table_row", "", "a | b")]
    assert D.read_word(files, tables=False).count() == 1
    html = '<style>x</style><p>Label one</p><p>12px</p><script>const DATA = {"k": ["a}", {"b": 1}]};</script><p>Label one</p><p>乙丙</p>'
    row = spark.createDataFrame([(html,)], "h string").select(D.page_labels("h").alias("l"), D.script_constant("h", F.lit("DATA")).alias("c")).first()
    assert row.l == ["Label one", "乙丙"] and json.loads(row.c) == {"k": ["a}", {"b": 1}]}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("v1", 1), ("v2", 2)], "version_id string, x int")
    S.replace_version(rows, f"{tmp_path}/t")
    S.replace_version(spark.createDataFrame([("v2", 9)], "version_id string, x int"), f"{tmp_path}/t")
    assert sorted((r.version_id, r.x) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("v1", 1), ("v2", 9)]
    counts = S.export_tables({"a": rows, "b": rows.limit(1)}, f"{tmp_path}/x")
    assert {(r.table_name, r.rows) for r in counts.collect()} == {("a", 2), ("b", 1)}
    versions = spark.createDataFrame([("v1", "draft"), ("v1", "draft")], "version_id string, status string")
    with pytest.raises(ValueError):
        S.mark_released(versions, "v1")
    S.write_csv(spark.createDataFrame([("source_chunk", "a"), ("other", "a")], "item_type string, classification string"), f"{tmp_path}/c")
    assert P.read_review_rows(spark, f"{tmp_path}/c", ("a",)).count() == 1
    assert S.markdown_table(rows.orderBy("x")).splitlines()[2] == "| v1 | 1 |"


def test_persisted_run(spark, tmp_path):
    cases = spark.createDataFrame([("t1", True, True, True), ("t2", False, True, False)], "test_id string, top1 boolean, top3 boolean, passed boolean")
    runs = evaluate.persist_run(cases, "r1", "v", "keyword", str(tmp_path)).collect()
    assert len(runs) == 1 and runs[0].finished and json.loads(runs[0].metrics)["passed"] == 1
    assert spark.read.parquet(f"{tmp_path}/cases").where("run_id = 'r1'").count() == 2


def test_bank_ids_and_progress(spark):
    bank = spark.createDataFrame(
        [("c", 1, "怎么设置10", "answer_card", "a1", False), ("c", 2, "怎么设置9", "answer_card", "a2", False), ("c", 3, "怎么设置9？", "answer_card", "a3", False), ("c", 0, "我想看图", "resource", "r1", True)],
        "chapter_id string, priority int, question string, target_type string, target_id string, pinned boolean",
    )
    rows = merge.numbered_bank(merge.question_bank(bank), ("核心概念", "设计流程")).orderBy("id").collect()
    assert [(r.id, r.target_id, r.category) for r in rows] == [("c_qb_001", "r1", "资源学习"), ("c_qb_002", "a2", "设计流程"), ("c_qb_003", "a1", "设计流程")]
    items = spark.createDataFrame([("ch10", "x", ""), ("ch11", "y", "reject_candidate")], "chapter_id string, chunk_id string, decision string")
    got = {(r.view, r.name): (r.total, r.open) for r in review.progress(items, ["chapter_id"]).collect()}
    assert got == {("chapter_id", "ch10"): (1, 1), ("chapter_id", "ch11"): (1, 0), ("total", "total"): (2, 1)}


def test_duplicate_ids_and_unique_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, "a")], "ordinal int, id string")
    assert quality.duplicate_ids(rows, "id", "dup").count() == 2
    assert [r.id for r in merge.unique_ids(rows, "id", "row").orderBy("ordinal").collect()] == ["a", "a_dup02", "row_0003", "a_dup03"]
