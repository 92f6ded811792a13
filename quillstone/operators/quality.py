"""Validation rules and data-quality audits (VAL-01 .. VAL-03, AUD-01 .. AUD-05)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import values as V

#: Repetitions of one id that one row stands for at most.
STRETCH = 10_000
FINDING = ("severity", "rule", "object_id")


def findings(rows: DataFrame, condition: Column, severity: str, rule: str, object_id: Column | str) -> DataFrame:
    """One row per violation of a row-level rule."""
    return rows.where(condition).select(
        F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), T.as_col(object_id).cast("string").alias("object_id")
    )


def missing_fields(rows: DataFrame, required: tuple[str, ...], rule: str, object_id: str) -> DataFrame:
    """Required fields that are absent, null or empty (SET-03 on the row)."""
    empty = [
        F.when(
            F.lit(True) if name not in rows.columns else F.col(name).isNull() | (F.col(name).cast("string") == ""), F.lit(name)
        )
        for name in sorted(required)
    ]
    names = F.array_compact(F.array(*empty))
    return rows.where(F.size(names) > 0).select(
        F.lit("error").alias("severity"), F.concat(F.lit(rule + ":"), F.array_join(names, ",")).alias("rule"),
        F.col(object_id).cast("string").alias("object_id"),
    )


def duplicate_ids(rows: DataFrame, object_id: str, rule: str) -> DataFrame:
    """Every repetition of an id is one finding; counted with a map-side combine.

    The findings of an id that very many rows share are written in stretches, each a row of its own to deal out.
    """
    key = T.text_or_empty(object_id)
    counted = rows.groupBy(key.alias("object_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    stretches = counted.withColumn("_part", F.explode(F.expr(f"sequence(0L, (_n - 2) div {STRETCH})"))).repartition("object_id", "_part")
    again = F.explode(F.expr(f"sequence(_part * {STRETCH} + 2, least(_n, (_part + 1) * {STRETCH} + 1))"))
    return stretches.select(F.lit("error").alias("severity"), F.lit(rule).alias("rule"), "object_id", again.alias("_again")).drop("_again")


def orphans(
    rows: DataFrame, reference: str, targets: DataFrame, target_id: str, severity: str, rule: str, object_id: str
) -> DataFrame:
    """JOI-14: references to nothing."""
    named = rows.where(T.text_or_empty(reference) != "")
    known = targets.select(F.col(target_id).alias(reference)).distinct()
    return named.join(known, reference, "left_anti").select(
        F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.col(object_id).cast("string").alias("object_id")
    )


def ambiguous(rows: DataFrame, question: str, target: str, severity: str, rule: str) -> DataFrame:
    """VAL-02: one normalised question, several targets (AGG-07)."""
    keyed = rows.select(T.normalize(question).alias("object_id"), F.col(target).alias("_target")).where(
        "object_id <> '' and coalesce(_target, '') <> ''"
    )
    counted = keyed.groupBy("object_id").agg(F.count_distinct("_target").alias("_n")).where("_n > 1")
    return counted.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), "object_id")


def validate_package(tables: dict[str, DataFrame], required: dict[str, tuple[str, ...]]) -> DataFrame:
    """VAL-01: all findings of a package as (severity, rule, object_id).

    tables may hold cards, knowledge_points, chunks, tests, resources, scripts,
    embeddings, resource_tests; a missing one is itself a finding.
    """
    spark = next(iter(tables.values())).sparkSession
    parts: list[DataFrame] = []
    absent = [name for name in required if name not in tables]
    if absent:
        parts.append(
            spark.createDataFrame([("error", "missing_table", name) for name in absent], "severity string, rule string, object_id string")
        )
    ids = {
        "cards": "answer_id", "knowledge_points": "kp_id", "chunks": "chunk_id", "tests": "test_id",
        "resources": "resource_id", "scripts": "script_id", "embeddings": "embedding_id", "resource_tests": "test_id",
    }
    for name, rows in tables.items():
        key = ids[name]
        parts.append(duplicate_ids(rows, key, f"duplicate_{name}"))
        if required.get(name):
            parts.append(missing_fields(rows, required[name], f"missing_{name}", key))
        elif name in ("chunks", "resources", "scripts", "embeddings", "resource_tests"):
            parts.append(findings(rows, T.text_or_empty(key) == "", "error", f"no_id_{name}", key))
    cards = tables.get("cards")
    if cards is not None:
        parts += [
            findings(cards, F.coalesce(F.size("answer_points"), F.lit(0)) <= 0, "error", "empty_answer_points", "answer_id"),
            findings(cards, F.coalesce(F.size("must_include"), F.lit(0)) <= 0, "warning", "empty_must_include", "answer_id"),
            findings(cards, ~F.col("status").eqNullSafe("checked"), "warning", "not_checked", "answer_id"),
            ambiguous(cards, "canonical_question", "answer_id", "warning", "duplicate_canonical"),
        ]
    if "chunks" in tables:
        parts.append(
            findings(
                tables["chunks"], ~F.col("usable_for_answer").eqNullSafe("no_direct_output"), "warning", "chunk_policy", "chunk_id"
            )
        )
    if "tests" in tables and cards is not None:
        parts += [
            orphans(tables["tests"], "expected_answer_card", cards, "answer_id", "warning", "unknown_card", "test_id"),
            ambiguous(tables["tests"], "question", "expected_answer_card", "warning", "ambiguous_question"),
        ]
    if "scripts" in tables and "resources" in tables:
        parts.append(orphans(tables["scripts"], "resource_id", tables["resources"], "resource_id", "error", "unknown_resource", "script_id"))
    if "resource_tests" in tables and "resources" in tables:
        parts.append(
            orphans(tables["resource_tests"], "expected_resource_id", tables["resources"], "resource_id", "error", "unknown_test_resource", "test_id")
        )
    if "embeddings" in tables:
        rows = tables["embeddings"]
        source = (T.text_or_empty("source_type") == "") | (T.text_or_empty("source_id") == "")
        text = F.trim(T.text_or_empty("embedding_text"))
        parts += [
            findings(rows, source, "error", "no_source", "embedding_id"),
            findings(rows, text == "", "error", "empty_embedding_text", "embedding_id"),
            findings(rows, (text != "") & (text == F.col("source_id")), "warning", "id_as_text", "embedding_id"),
        ]
        for kind, name in (("answer_card", "cards"), ("knowledge_point", "knowledge_points"), ("resource", "resources")):
            if name in tables:
                own = rows.where((F.col("source_type") == kind) & ~source)
                parts.append(orphans(own, "source_id", tables[name], ids[name], "error", f"unknown_{kind}", "embedding_id"))
    if "resources" in tables:
        rows = tables["resources"]
        path, bound = F.trim(T.text_or_empty("file_path")), F.col("status").eqNullSafe("bound")
        parts += [
            findings(rows, (path == "") & bound, "error", "bound_without_path", "resource_id"),
            findings(rows, path.startswith("/"), "warning", "absolute_path", "resource_id"),
        ]
    return reduce(DataFrame.unionByName, parts)


def validate_decisions(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """VAL-03: findings of review decisions.

    decisions(chapter_id, chunk_id, decision, approved_paragraph_start,
    approved_paragraph_end, reviewer_notes); items(chapter_id, chunk_id, review_status).
    """
    rows = decisions.withColumns(
        {
            "chapter_id": F.trim(T.text_or_empty("chapter_id")),
            "chunk_id": F.trim(T.text_or_empty("chunk_id")),
            "decision": F.trim(T.text_or_empty("decision")),
        }
    )
    key = F.concat_ws("/", "chapter_id", "chunk_id")
    keyless = (F.col("chapter_id") == "") | (F.col("chunk_id") == "")
    whole = rows.where(~keyless).withColumn("_key", key)
    known = whole.join(items.select("chapter_id", "chunk_id", "review_status"), ["chapter_id", "chunk_id"])
    allowed = known.where(F.col("decision").isin(*V.REVIEW_DECISIONS) & (F.col("decision") != ""))
    confirmed = allowed.where(F.startswith("decision", F.lit("confirm_")))
    start = F.col("approved_paragraph_start").cast("string").try_cast("int")
    end = F.col("approved_paragraph_end").cast("string").try_cast("int")
    usual = reduce(
        lambda a, b: a | b,
        [(F.col("review_status") == s) & F.col("decision").isin(*ds) for s, ds in V.USUAL_DECISIONS.items()],
    )
    parts = [
        findings(rows, keyless, "error", "missing_key", key),
        duplicate_ids(whole, "_key", "duplicate_decision"),
        findings(
            whole.join(items.select("chapter_id", "chunk_id"), ["chapter_id", "chunk_id"], "left_anti"),
            F.lit(True), "error", "unknown_item", "_key",
        ),
        findings(known, ~F.col("decision").isin(*V.REVIEW_DECISIONS), "error", "invalid_decision", "_key"),
        findings(confirmed, start.isNull() | end.isNull(), "error", "span_not_numeric", "_key"),
        findings(confirmed, (start <= 0) | (end < start), "error", "invalid_span", "_key"),
        findings(confirmed, F.trim(T.text_or_empty("reviewer_notes")) == "", "warning", "no_notes", "_key"),
        findings(
            allowed, F.col("review_status").isin(*V.USUAL_DECISIONS) & ~usual, "warning", "unusual_decision", "_key"
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def evidence_confidence(alignment: Column, raw: Column) -> Column:
    """AUD-01: confidence of an evidence status."""
    status = F.coalesce(F.nullif(alignment, F.lit("")), raw)
    return (
        F.when(status.isin(*V.HIGH_EVIDENCE), "high")
        .when(status.isin(*V.MEDIUM_EVIDENCE), "medium")
        .when(status.isin(*V.LOW_EVIDENCE), "low")
        .otherwise("ungraded")
    )


def text_issues(text: Column) -> Column:
    """AUD-02: names of the text problems found."""
    patterns = {
        "word_xml_residue": r"</?w:|<w\b",
        "duplicate_period_fragment": "。。+",
        "known_bad_fragment": "转型。的",
        "source_repair_placeholder": "残留Word XML格式内容",
    }
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()]))


def resource_issues(resources: DataFrame, cases: DataFrame, files: DataFrame) -> DataFrame:
    """AUD-04: resources with their list of coverage issues.

    cases(expected_resource_id); files(path, stem): existing files.
    """
    tested = cases.groupBy(F.col("expected_resource_id").alias("resource_id")).agg(F.count(F.lit(1)).alias("eval_cases"))
    exists = files.select(F.col("path").alias("file_path"), F.lit(True).alias("_exists")).distinct()
    candidates = files.select(F.lower("stem").alias("_stem")).distinct().withColumn("_candidate", F.lit(True))
    rows = (
        resources.join(tested, "resource_id", "left")
        .join(exists, "file_path", "left")
        .join(candidates, F.lower("resource_id") == F.col("_stem"), "left")
    )
    path = T.text_or_empty("file_path")
    found = F.coalesce("_exists", F.lit(False))
    issues = F.array_compact(
        F.array(
            F.when(F.contains(F.lower(T.text_or_empty("status")), F.lit("placeholder")), F.lit("placeholder_status")),
            F.when((path != "") & ~found, F.lit("missing_file")),
            F.when((path == "") & F.coalesce("_candidate", F.lit(False)), F.lit("candidate_asset_unbound")),
            F.when(F.coalesce("eval_cases", F.lit(0)) == 0, F.lit("no_resource_eval_case")),
            F.when(F.coalesce(F.size("related_kps"), F.lit(0)) <= 0, F.lit("no_related_kps")),
        )
    )
    return rows.select("resource_id", "resource_type", F.coalesce("eval_cases", F.lit(0)).alias("eval_cases"), issues.alias("issues"))


def media_readiness(steps: DataFrame, segments: DataFrame, videos: DataFrame, files: DataFrame) -> DataFrame:
    """AUD-05: one row of counts about the video segments of operation steps."""
    joined = segments.join(
        videos.select("video_id", F.col("file_path").alias("_video_path"), F.col("status").alias("_video_status")), "video_id", "left"
    ).withColumn("path", F.coalesce(F.nullif("_video_path", F.lit("")), F.col("file_path"), F.lit("")))
    joined = joined.join(files.select("path", F.lit(True).alias("_exists")).distinct(), "path", "left")
    status = F.coalesce(F.nullif("status", F.lit("")), F.col("_video_status"), F.lit(""))
    placeholder = T.placeholder_status(status) | T.placeholder_status("_video_status")
    exists = F.coalesce("_exists", F.lit(False))
    counts = joined.agg(
        F.count(F.lit(1)).alias("video_segments"),
        F.count_if(exists & ~placeholder).alias("available"),
        F.count_if(placeholder).alias("placeholders"),
        F.count_if((F.col("path") != "") & ~exists).alias("missing_files"),
    )
    used = steps.where(T.text_or_empty("segment_id") != "").select("segment_id").distinct()
    refs = used.join(segments.select("segment_id").distinct().withColumn("_known", F.lit(True)), "segment_id", "left").agg(
        F.count(F.lit(1)).alias("step_refs"), F.count_if(F.col("_known").isNull()).alias("missing_metadata")
    )
    # two one-row results side by side
    return counts.withColumn("_one", F.lit(1)).join(refs.withColumn("_one", F.lit(1)), "_one").drop("_one")
