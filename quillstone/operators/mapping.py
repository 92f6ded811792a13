"""Mapping of summary chunks to windows of manuscript lines (AUD-07, JOI-17, TXT-21)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators.align import line_windows, mapping_score, mapping_status
from quillstone.operators.matching import BROADCAST_BYTES
from quillstone.operators.nearest import CHUNK_BYTES, Measure, nearest_windows
from quillstone.operators.topk import keep_first, top_k

#: Lines of a stretch, the bucket of the range join.
STRETCH = 256
CANDIDATES = 5
POSITION = ("doc_id", "line_start")


def section_ranges(lines: DataFrame, markers: DataFrame) -> DataFrame:
    """(doc_id, section_id, start, end): a section's lines, from the first that holds its marker to the first that holds the next one's.

    lines(doc_id, ordinal, text), ordinals from 0; markers(doc_id, section_id, start_marker, end_marker).  Without a start the section
    begins with the document, without an end behind its start it goes on to the document's end.
    """
    rows = lines.select("doc_id", "ordinal", T.compact_mapping("text").alias("_line"))
    sizes = rows.groupBy("doc_id").agg((F.max("ordinal") + 1).alias("_lines"))
    wanted = markers.select("doc_id", "section_id", *[T.compact_mapping(c).alias(f"_{c}") for c in ("start_marker", "end_marker")])
    holds = lambda c: (F.col(c) != "") & F.contains("_line", F.col(c))
    first = rows.join(wanted, "doc_id").groupBy("doc_id", "section_id").agg(
        F.min(F.when(holds("_start_marker"), F.col("ordinal"))).alias("_start"), F.min(F.when(holds("_end_marker"), F.col("ordinal"))).alias("_end")
    )
    start = F.coalesce("_start", F.lit(0))
    end = F.when(F.col("_end") > start, F.col("_end")).otherwise(F.col("_lines"))
    return first.join(sizes, "doc_id").select("doc_id", "section_id", start.cast("long").alias("start"), end.cast("long").alias("end"))


def section_windows(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """JOI-17: the windows of one to three lines that lie within a section's range.

    A bucketed range join: a range goes to the stretches of lines that it covers, a window to its own stretch, so neither a
    document nor a section is held together by the join.
    """
    covered = F.sequence(F.floor(F.col("start") / STRETCH), F.floor((F.col("end") - 1) / STRETCH))
    spans = ranges.where("end > start").select("doc_id", "section_id", "start", "end", F.explode(covered).alias("_stretch"))
    windows = line_windows(lines).withColumn("_stretch", F.floor(F.col("line_start") / STRETCH))
    found = windows.join(spans, ["doc_id", "_stretch"]).where("line_start >= start and line_end < end")
    return found.select("section_id", "doc_id", "line_start", "line_end", "text")


def _queries(chunks: DataFrame) -> DataFrame:
    """Compact title, definition and excerpt and the chunk's terms."""
    title = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("section_title", "chunk_summary", "kp_title")], F.lit(""))
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    values = F.concat(F.array(title), listed(F.col("aliases")), listed(F.col("keywords")), F.array("definition", "source_excerpt"), F.slice(listed(F.col("key_points")), 1, 2))
    return chunks.select(
        "chunk_id", "section_id", T.compact_mapping(title).alias("_title"), T.compact_mapping("definition").alias("_definition"),
        T.compact_mapping("source_excerpt").alias("_excerpt"), F.transform(T.mapping_terms(values), T.compact_mapping).alias("_terms"),
    )


def _ranked(scored: DataFrame) -> DataFrame:
    """The five best candidates of every chunk, the best window of each first line."""
    by_line = keep_first(scored, ["chunk_id", *POSITION], [F.desc("score"), F.col("line_end")])
    return top_k(by_line, ["chunk_id"], [F.desc("score"), F.col("doc_id"), F.col("line_start"), F.col("line_end")], CANDIDATES)


def _mapping_total(title: float, definition: float, excerpt: float, share: float, matched: int, known: bool) -> float:
    """At least ``mapping_score`` on numbers; it only decides what is not measured."""
    if not known:
        return 0.0
    support = max(definition, excerpt, share) >= 0.20 - 1e-9
    more = (0.07 if title >= 0.88 - 1e-9 and support else 0.0) + (0.04 if title >= 0.76 - 1e-9 and matched >= 2 else 0.0)
    return min(1.0, 0.30 * title + 0.25 * definition + 0.25 * excerpt + 0.20 * share + more)


def _mapping_totals(title: np.ndarray, definition: np.ndarray, excerpt: np.ndarray, share: np.ndarray, matched: np.ndarray, known: np.ndarray) -> np.ndarray:
    """``_mapping_total`` of arrays."""
    support = np.maximum(np.maximum(definition, excerpt), share) >= 0.20 - 1e-9
    more = np.where((title >= 0.88 - 1e-9) & support, 0.07, 0.0) + np.where((title >= 0.76 - 1e-9) & (matched >= 2), 0.04, 0.0)
    return np.where(known, np.minimum(1.0, 0.30 * title + 0.25 * definition + 0.25 * excerpt + 0.20 * share + more), 0.0)


def candidates(chunks: DataFrame, windows: DataFrame, first_lines: DataFrame) -> DataFrame:
    """Ranked candidates (chunk_id, rank, doc_id, line_start, line_end, text, title, definition, excerpt, matched, score).

    chunks(chunk_id, section_id, section_title, chunk_summary, source_excerpt, kp_title, definition, aliases, keywords,
    key_points); windows as of ``section_windows``; first_lines(doc_id, ordinal, text).  Each window first gets an upper bound without the sequence
    matcher (``nearest``): a task matches only windows whose bound reaches the fifth best score over different first lines that it has found.
    """
    asked = _queries(chunks)
    firsts = first_lines.select("doc_id", F.col("ordinal").alias("line_start"), T.compact_mapping("text").alias("_first"))
    rows = windows.select("section_id", "doc_id", "line_start", "line_end", "text", T.compact_mapping("text").alias("_text")).join(firsts, list(POSITION))
    order = (*POSITION, "line_end")
    measure = Measure((("_definition", 0.25), ("_excerpt", 0.25)), _mapping_total, _mapping_totals, POSITION, order, CANDIDATES, ("_title", 0.30))
    parts = ("title", "definition", "excerpt")
    size, block = 2 * F.octet_length("text") + F.lit(100), min(CHUNK_BYTES, max(BROADCAST_BYTES, 1024))
    known_parts = nearest_windows(asked, rows, measure, list(parts), [*order, "text", "_text"], size, block).withColumn("matched", F.col("matched").cast("int"))
    total = F.when(F.col("_text") != "", mapping_score(*map(F.col, parts), F.col("_share"), F.col("matched"))).otherwise(0.0)
    scored = known_parts.withColumn("score", total)
    return _ranked(scored).select("chunk_id", "rank", "doc_id", "line_start", "line_end", "text", F.length("_text").alias("size"), *parts, "matched", "score")


def semantic_scores(found: DataFrame, similarities: DataFrame) -> DataFrame:
    """Candidates ranked again with a boost for the cosine of chunk and window; similarities(chunk_id, doc_id, line_start, line_end, semantic)."""
    where = ["chunk_id", "doc_id", "line_start", "line_end"]
    rows = found.join(similarities, where, "left").withColumn("_before", F.col("rank")).drop("rank")
    boost = F.greatest(F.lit(0.0), (F.coalesce("semantic", F.lit(0.0)) - 0.45) * 0.45)
    rows = rows.withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + boost), 6))
    return top_k(rows, ["chunk_id"], [F.desc("score"), F.col("_before")], CANDIDATES).drop("_before")


def map_chunks(chunks: DataFrame, lines: DataFrame, ranges: DataFrame, approvals: DataFrame | None = None, similarities: DataFrame | None = None) -> DataFrame:
    """AUD-07: best window, score, margin, status and the five best candidates of every chunk.

    approvals(chunk_id, doc_id, line_start, line_end, note): manual decisions, which stand over everything found.  A span that is
    not within its document raises when the result is read.
    """
    found = candidates(chunks, section_windows(lines, ranges), lines)
    if similarities is not None:
        found = semantic_scores(found, similarities)
    else:
        found = found.withColumn("semantic", F.lit(None).cast("double"))
    shown = F.struct("rank", "doc_id", "line_start", "line_end", "score", "text")
    best = F.col("_all")[0]
    ranked = found.groupBy("chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id", "line_start", "line_end", "score", "title", "definition", "excerpt", "size", "semantic"))).alias("_all"),
        F.array_sort(F.collect_list(shown)).alias("candidates"),
    )  # five rows at most
    second = F.coalesce(F.get("_all", F.lit(1))["score"], F.lit(0.0))
    gap = best["score"] - second
    status = mapping_status(best["score"], gap, best["title"], best["definition"], best["excerpt"], best["size"], best["semantic"])
    mapped = ranked.select(
        "chunk_id", best["doc_id"].alias("doc_id"), best["line_start"].alias("line_start"), best["line_end"].alias("line_end"),
        best["score"].alias("best_score"), F.round(gap, 6).alias("score_margin"), status.alias("status"), "candidates",
    )
    out = chunks.select("chunk_id").join(mapped, "chunk_id", "left").select(
        "chunk_id", "doc_id", "line_start", "line_end", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("best_score", "score_margin")],
        F.coalesce("status", F.lit("manual_review")).alias("status"), "candidates", F.lit(None).cast("string").alias("note"),
    )
    return out if approvals is None else approved(out, approvals, lines)


def approved(mapped: DataFrame, approvals: DataFrame, lines: DataFrame) -> DataFrame:
    """Manual approvals over what was found; the last one of a chunk holds."""
    last = keep_first(approvals.withColumn("_place", F.monotonically_increasing_id()), ["chunk_id"], [F.desc("_place")]).drop("_place")
    inside = lines.join(last.select("doc_id", "chunk_id", "line_start", "line_end"), "doc_id").where("ordinal between line_start and line_end")
    texts = inside.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("_lines"))
    spans = last.join(texts, "chunk_id", "left")
    whole = (F.size("_lines") == F.col("line_end") - F.col("line_start") + 1) & (F.col("line_start") >= 0)
    spans = spans.withColumn("_ok", F.coalesce(whole, F.lit(False)))
    text = F.when(F.col("_ok"), F.array_join(F.transform("_lines", lambda x: x["text"]), " ")).otherwise(
        F.raise_error(F.concat(F.lit("not a span of lines: "), F.to_json(F.struct("chunk_id", "line_start", "line_end")))).cast("string")
    )
    one = F.struct(F.lit(1).alias("rank"), "doc_id", "line_start", "line_end", F.lit(1.0).alias("score"), text.alias("text"))
    kinds = dict(mapped.dtypes)
    told = spans.select(
        F.col("chunk_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("doc_id", "line_start", "line_end", "note")],
        F.array(one).cast(kinds["candidates"]).alias("_candidates"),
    )
    rows = mapped.join(told, F.col("chunk_id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    pick = lambda c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(
        "chunk_id", *map(pick, ("doc_id", "line_start", "line_end")),
        *[F.when(hit, 1.0).otherwise(F.col(c)).alias(c) for c in ("best_score", "score_margin")],
        F.when(hit, "review_confirmed").otherwise(F.col("status")).alias("status"), pick("candidates"), pick("note"),
    )
