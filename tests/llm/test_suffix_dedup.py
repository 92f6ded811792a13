"""Removed bytes against a count of all 400-byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np

from quillstone.llm import suffix_dedup as sd

from .data import documents, prose


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def agree(spark, texts):
    ids = list(range(len(texts)))
    got = {r["doc_id"]: r for r in sd.remove_repeats(documents(spark, texts, ids=ids)).collect()}
    assert len(got) == len(texts)
    for i, expected in enumerate(brute(texts)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected, i
        assert hashlib.sha256(r["kept"]).hexdigest() == expected[3]


def test_against_all_strings(spark):
    r = random.Random(3)
    base = prose(1, 400)
    passage = prose(2, 65)
    near = [base[: 300 + k] + f" changed {k} " + base[320 + k :] for k in range(0, 900, 150)]
    framed = [prose(100 + k, 30) + passage + prose(200 + k, r.randrange(0, 40)) for k in range(12)]
    edges = [passage[:399], passage[:400], "x" + passage[:400], passage[:401] + "é"]
    self_repeat = [prose(7, 80) + "|" + prose(7, 80), "a" * 3000, "ab" * 700, "é" * 500 + "q" + "é" * 400]
    agree(spark, [None, "", "short", base, base, *near, *framed, *edges, *self_repeat])


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(sd, "CROWDED", 3)
    passage, short = prose(2, 75), prose(3, 45)[:260]
    texts = [prose(100 + k, 45) + passage + prose(300 + k, 45) for k in range(14)]
    texts += [prose(500 + k, 45) + short + prose(700 + k, 45) for k in range(10)]
    texts += [prose(900, 60)[:350] + short + prose(901, 60)[k:350] for k in range(8)]
    agree(spark, texts)


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["x" * 400, "x" * 400, "x" * 399], ids=[None, 5, 5])
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in sd.remove_repeats(docs).collect())
    assert got == [(0, 400, 400), (5, 399, 0), (5, 400, 400)]
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_columns_of_strings_of_many_lengths():
    r = random.Random(5)
    for _ in range(30):
        bodies, left, counts = [], [], []
        for _ in range(r.randrange(2, 40)):
            before, after = r.randrange(0, 6), r.randrange(8, 14)
            text = bytes(r.choice(b"ab") for _ in range(before)) + b"XY" + bytes(r.choice(b"ab") for _ in range(after))
            bodies.append(text)
            left.append(before)
            counts.append(min(before + 1, len(text) - 8 + 1))
        got = sd.column_sort(bodies, np.array(left), np.array(counts), 8)
        seen = Counter((i - at, b[i : i + 8]) for b, at in zip(bodies, left) for i in range(len(b) - 7))
        for b, at, c, flags in zip(bodies, left, counts, got):
            assert flags.tolist() == [seen[i - at, b[i : i + 8]] > 1 for i in range(c)]
