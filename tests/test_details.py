"""Details of cards, resources and scripts on a small package."""

from pyspark.sql import functions as F

from quillstone.operators import details as D

RESOURCE = "ordinal int, resource_id string, title string, resource_type string, file_path string, expression string, columns array<string>, rows array<string>"
SCRIPT = "ordinal int, script_id string, resource_id string, title string, interaction_theme string, operation_steps array<string>"


def test_details(spark):
    resources = spark.createDataFrame(
        [
            (1, "r1", "a", "image", "x\\y.png", None, None, None), (2, "r2", "b", "formula", None, "y = x", None, None), (3, "r3", "c", "table", "", None, ["k"], []),
            (4, "r4", "d", "table", "t.csv", None, ["k"], ["v"]), (5, "r1", "again", "image", "x\\y.png", None, None, None),
        ],
        RESOURCE,
    )
    scripts = spark.createDataFrame(
        [(1, "s1", "r1", "old", "t", ["u"]), (2, "s2", "r1", "new", None, None), (3, "s3", "none", "lost", "t", [])], SCRIPT
    )
    files = spark.createDataFrame([("x\\y.png",), ("",)], "file_path string")
    payloads = D.resource_payloads(resources, scripts, files)
    got = {(r.ordinal): (r.exists, r.available, r.url_path, r.interactive_script and r.interactive_script.script_id) for r in payloads.collect()}
    assert got == {
        1: (True, True, "/x/y.png", "s2"), 2: (False, True, "", None), 3: (False, False, "", None), 4: (False, True, "/t.csv", None), 5: (True, True, "/x/y.png", "s2"),
    }
    out = {r.script_id: r.resource for r in D.script_details(scripts, payloads).collect()}
    assert out["s3"] is None and out["s1"].title == out["s2"].title == "again"

    cards = spark.createDataFrame(
        [("a1", ["k2", "k1", "k1", "zz"], ["c2", "c1"]), ("a2", [], None)], "answer_id string, related_kps array<string>, evidence_chunks array<string>"
    )
    points = spark.createDataFrame([(1, "k1", "one"), (2, "k2", "two")], "ordinal int, kp_id string, title string")
    chunks = spark.createDataFrame([(5, "c2", ""), (9, "c1", "")], "ordinal int, chunk_id string, source_excerpt string")
    recommended = spark.createDataFrame([("a1", 2, "r2"), ("a1", 1, "r3"), ("a1", 3, "gone")], "answer_id string, rank int, resource_id string")
    cases = spark.createDataFrame([(i, f"t{i}", "a1") for i in range(30)] + [(1, "u", None)], "ordinal int, test_id string, expected_answer_card string")
    found = {r.answer_id: r for r in D.card_details(cards, points, chunks, recommended, payloads, cases, F.upper("answer_id")).collect()}
    one, two = found["a1"], found["a2"]
    assert [tuple(k) for k in one.knowledge_points] == [("k1", "one"), ("k2", "two")] and one.source_chunks == ["c2", "c1"] and one.rendered_answer == "A1"
    assert [r.resource_id for r in one.recommended_resources] == ["r3", "r2"] and one.qa_cases == [f"t{i}" for i in range(20)]
    assert (two.knowledge_points, two.source_chunks, two.recommended_resources, two.qa_cases) == ([], [], [], [])
