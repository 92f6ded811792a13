"""Plain Python models of the scoring rules, written from their description."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from quillstone.functions import values as V


def normalize(text):
    return "".join(c for c in (text or "").lower() if not c.isspace() and c not in V.QUESTION_PUNCTUATION)


def tokens(text):
    found = {w for w in re.findall(r"[a-z0-9+#_.-]+", (text or "").lower()) if len(w) > 1}
    for run in re.findall("[一-鿿]+", text or ""):
        if len(run) == 1:
            found.add(run)
            continue
        found |= {run[i : i + n] for n in (2, 3, 4) for i in range(len(run) - n + 1)}
        if len(run) <= 10:
            found.add(run)
    return found


def core(text):
    for phrase in V.FILLER_PHRASES:
        text = text.replace(phrase, "")
    return text


def level(q, t):
    if q == t:
        return 3
    if q in t or t in q:
        return 2
    return 1 if core(q) == core(t) else 0


def intent(q, focused, body):
    points = sum(V.INTENT_POINTS for p in V.INTENT_PHRASES if p in q and p in focused)
    pairs = [(t, V.SCOPE_FOCUS_POINTS, V.SCOPE_BODY_POINTS) for t in V.SCOPE_TERMS]
    pairs.append((V.FUNCTION_TERM, V.FUNCTION_FOCUS_POINTS, V.FUNCTION_BODY_POINTS))
    for term, focus, aside in pairs:
        if term in q:
            points += focus if term in focused else aside if term in body else 0
    if "内容" in q and "原则" not in q and "原则" in focused:
        points += V.CONTENT_AGAINST_PRINCIPLE
    if "原则" in q and "内容" not in q and "内容" in focused:
        points += V.PRINCIPLE_AGAINST_CONTENT
    return points


def keyword_score(question, card, synonyms, rag):
    q, qt, score = normalize(question), tokens(question), 0.0
    if q:
        score += {3: 120, 2: 85, 1: 110, 0: 0}[level(q, normalize(card["canonical_question"]))]
        levels = [level(q, normalize(p)) for p in card["student_question_patterns"] if normalize(p)]
        score += {3: 180, 2: 75, 1: 140, 0: 0}[max(levels, default=0)]
        for s in synonyms:
            if normalize(s["alias_or_question"]) == q:
                score += 70 + 5 * float(s["priority"] if s["priority"] is not None else 1)
                break
    aliases = " ".join(s["alias_or_question"] for s in synonyms)
    focused = " ".join([card["canonical_question"], " ".join(card["student_question_patterns"]), aliases])
    body = " ".join([" ".join(card["answer_points"]), " ".join(card["must_include"]), (rag or {}).get("index_text") or ""])
    score += min(72, 6 * len(qt & tokens(focused))) + min(18, 1.5 * len(qt & tokens(body)))
    score += intent(q, normalize(focused), normalize(body))
    must = [normalize(m) for m in card["must_include"]]
    if q and "".join(must) and any(m in q for m in must):
        score += 20
    if rag:
        score += min(20, rag["retrieval_priority"] / 10) + (5 if rag["primary_output"] else 0)
    return score


def boundary(text):
    return "".join(c for c in str(text) if not c.isspace() and c not in V.BOUNDARY_PUNCTUATION).lower()


def grams(text, n=3):
    return ({text} if text else set()) if len(text) <= n else {text[i : i + n] for i in range(len(text) - n + 1)}


def similarity(left, right):
    if not left or not right:
        return 0.0
    if left in right:
        return 1.0
    if right in left:
        return len(right) / len(left)
    a, b = grams(left), grams(right)
    return 0.45 * SequenceMatcher(None, left, right).ratio() + 0.55 * len(a & b) / len(a | b)
