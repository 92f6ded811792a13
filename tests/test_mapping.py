"""Line mapping against a model of its rules."""

import random
import re
from difflib import SequenceMatcher

import models
import pytest


from quillstone.functions import values as V
from quillstone.operators import align
from quillstone.operators.mapping import map_chunks, section_ranges

CHUNK = (
    "chunk_id int, section_id string, section_title string, chunk_summary string, source_excerpt string, kp_title string, definition string, "
    "aliases array<string>, keywords array<string>, key_points array<string>"
)


def compact(text):
    return "".join(c for c in (text or "") if not c.isspace() and c not in V.MAPPING_PUNCTUATION).lower()


def model_terms(values):
    out, seen = [], set()
    for value in values:
        for term in re.findall(r"[A-Za-z][A-Za-z0-9+*.-]{1,}|[一-鿿]{2,12}", value or ""):
            key = compact(term)
            if len(key) >= 2 and term not in V.MAPPING_STOP_TERMS and key not in seen and len(out) < 18:
                seen.add(key)
                out.append(key)
    return out


def model(chunk, lines, spans):
    _, section, heading, summary, excerpt, kp_title, definition, aliases, keywords, points = chunk
    title = compact(heading or summary or kp_title or "")
    terms = model_terms([heading or summary or kp_title or "", *(aliases or []), *(keywords or []), definition, excerpt, *(points or [])[:2]])
    found = []
    for doc, (lo, hi) in spans.get(section, {}).items():
        for i in range(lo, hi):
            for size in (1, 2, 3):
                if i + size > hi:
                    continue
                text = " ".join(lines[doc][i : i + size])
                w, first = compact(text), compact(lines[doc][i])
                t = 0.0
                if title:
                    t = 1.0 if title == first else 0.88 if title in first or first in title else 0.76 if title in w else 0.6 * SequenceMatcher(None, title, first).ratio()
                d, e = (models.similarity(compact(x), w) for x in (definition, excerpt))
                hit = sum(x in w for x in terms)
                share = hit / len(terms) if terms else 0.0
                score = 0.3 * t + 0.25 * d + 0.25 * e + 0.2 * share
                score += 0.07 if t >= 0.88 and max(d, e, share) >= 0.2 else 0
                score += 0.04 if t >= 0.76 and hit >= 2 else 0
                score = round(min(1.0, score), 6) if w else 0.0
                found.append((-score, doc, i, i + size - 1, t, d, e, len(w)))
    best, seen = [], set()
    for row in sorted(found):
        if row[1:3] not in seen:
            seen.add(row[1:3])
            best.append(row)
    return best[:5]


def status(best, gap):
    score, _, _, _, t, d, e, size = best
    if -score >= 0.56 and gap >= 0.045 and size >= 24 and t >= 0.76 and max(d, e) >= 0.12:
        return "high_confidence"
    return "medium_confidence" if -score >= 0.43 and (t >= 0.76 or gap >= 0.045) else "manual_review"


@pytest.mark.parametrize("broadcast", [True, False])
def test_line_mapping(spark, broadcast, monkeypatch):
    from quillstone.operators import mapping

    if not broadcast:
        monkeypatch.setattr(mapping, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(mapping, "STRETCH", 4)
    rnd = random.Random(5)
    words = "alpha beta gamma delta road plan model 道路 设计 数据处理 GIS twin bridge 、 A1+b x.y-z".split()
    say = lambda n: " ".join(rnd.choices(words, k=n))
    lines = {d: [say(rnd.randint(1, 8)) for _ in range(14)] for d in range(3)}
    lines[0][0] = "、，"
    lines[1][3], lines[1][9], lines[2][5] = "Part One: start", "part two", "part two"
    markers = [(0, "s", None, None), (1, "s", "part one", "Part Two"), (2, "s", "Part Two", "part one"), (1, "u", "part two", "missing")]
    spans = {"s": {0: (0, 14), 1: (3, 9), 2: (5, 14)}, "u": {1: (9, 14)}}
    chunks = [
        (c, rnd.choice("su"), rnd.choice([None, "", lines[1][4], say(3)]), rnd.choice([None, say(2)]), rnd.choice([None, say(9), " ".join(lines[0][4:6])]), "kp",
         rnd.choice([None, say(6), lines[1][10]]), rnd.choice([None, [say(1), None]]), [say(1)], [say(2), say(1), "unused words"])
        for c in range(14)
    ] + [(99, "none", "t", None, None, None, None, None, None, None)]
    df = spark.createDataFrame([(d, i, t) for d, own in lines.items() for i, t in enumerate(own)], "doc_id int, ordinal int, text string")
    ranges = section_ranges(df, spark.createDataFrame(markers, "doc_id int, section_id string, start_marker string, end_marker string"))
    assert {(r.section_id, r.doc_id, r.start, r.end) for r in ranges.collect()} == {(s, d, *x) for s, own in spans.items() for d, x in own.items()}
    approvals = spark.createDataFrame([(3, 2, 1, 1, "old"), (3, 1, 4, 6, "seen")], "chunk_id int, doc_id int, line_start int, line_end int, note string").coalesce(1)
    asked = spark.createDataFrame(chunks, CHUNK)
    got = {r.chunk_id: r for r in map_chunks(asked, df, ranges, approvals).collect()}
    assert len(got) == len(chunks)
    for chunk in chunks:
        r, want = got[chunk[0]], model(chunk, lines, spans)
        if chunk[0] == 3:
            assert (r.status, r.doc_id, r.line_start, r.line_end, r.best_score, r.score_margin, r.note) == ("review_confirmed", 1, 4, 6, 1.0, 1.0, "seen")
            assert [c.text for c in r.candidates] == [" ".join(lines[1][4:7])]
            continue
        if not want:
            assert (r.status, r.best_score, r.candidates) == ("manual_review", 0.0, None)
            continue
        assert [(c.doc_id, c.line_start, c.line_end) for c in r.candidates] == [w[1:4] for w in want]
        assert [c.score for c in r.candidates] == pytest.approx([-w[0] for w in want], abs=2e-6)
        gap = want[1][0] - want[0][0] if len(want) > 1 else -want[0][0]
        assert r.score_margin == pytest.approx(gap, abs=3e-6) and r.status == status(want[0], gap)
    bad = spark.createDataFrame([(3, 1, 12, 14, "past the end")], approvals.schema)
    with pytest.raises(Exception, match="not a span of lines"):
        map_chunks(asked, df, ranges, bad).collect()


def test_semantic_boost_ranks_again(spark):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(["alpha beta gamma delta road", "bridge plan twin of the model", "other words altogether here"])], "doc_id int, ordinal int, text string")
    ranges = spark.createDataFrame([(0, "s", 0, 3)], "doc_id int, section_id string, start long, end long")
    asked = spark.createDataFrame([(1, "s", "alpha beta", None, "alpha beta gamma", None, "delta", None, None, None)], CHUNK)
    plain = map_chunks(asked, df, ranges).first()
    assert (plain.line_start, plain.line_end) == (0, 0)
    likes = spark.createDataFrame([(1, 0, 2, 2, 1.0), (1, 0, 0, 0, 0.2)], "chunk_id int, doc_id int, line_start int, line_end int, semantic double")
    again = map_chunks(asked, df, ranges, similarities=likes).first()
    scores = {(c.line_start, c.line_end): c.score for c in plain.candidates}
    after = {(c.line_start, c.line_end): c.score for c in again.candidates}
    assert after[2, 2] == pytest.approx(min(1.0, scores[2, 2] + 0.55 * 0.45), abs=1e-6) and after[0, 0] == scores[0, 0]


def test_windows_across_stretches(spark):
    lines = spark.createDataFrame([(d, i, f"{d}.{i}") for d in range(2) for i in range(23) if (d, i) != (1, 7)], "doc_id int, ordinal int, text string")
    want = {(r.doc_id, r.line_start, r.line_end, r.text) for r in align.line_windows(lines).collect()}
    assert {(r.doc_id, r.line_start, r.line_end, r.text) for r in align.line_windows(lines, stretch=5).collect()} == want
    spans = {(d, i, i + n) for d in range(2) for i in range(23) for n in range(3) if i + n < 23 and not (d == 1 and i <= 7 <= i + n)}
    assert {w[:3] for w in want} == spans and all(t == " ".join(f"{d}.{k}" for k in range(a, b + 1)) for d, a, b, t in want)

