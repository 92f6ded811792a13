"""The inverted multi-index against brute force."""

import numpy as np
import pytest

from quillstone.llm import multi_index as mi

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, v string"


def brute(rows, k=10):
    fine = {}
    for key, v, *_ in rows:
        if key is not None and v is not None and len(v) == len(rows[0][1]) and None not in v and np.isfinite(v).all() and np.any(v):
            fine[key] = np.array(v, np.float32).astype(float)
    out = {}
    for q in fine:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((fine[q] - x) ** 2).sum())), i) for i, x in fine.items() if i != q)[:k]
    return out


def result(spark, rows):
    got = {}
    for r in mi.search(spark.createDataFrame(rows, SCHEMA), "id % 100 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_small_tables_are_exact(spark, monkeypatch):
    monkeypatch.setattr(mi, "BLOCK", 40)
    monkeypatch.setattr(mi, "CHUNK", 2)
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=7).astype(np.float32).tolist(), 0, "a", "b") for i in range(301)]
    same = rows[5][1]
    rows += [(i, same, 0, "a", "b") for i in range(301, 501)]  # a hot vector, asked for too
    rows += [(900, None, 0, "a", "b"), (1000, [0.0] * 7, 0, "a", "b"), (1100, [float("nan")] * 7, 0, "a", "b"), (1200, [1.0, None, *[0.0] * 5], 0, "a", "b"), (1300, [1.0], 0, "a", "b"), (None, same, 0, "a", "b")]
    rows += [(100, rows[100][1], 0, "a", "b")]  # a repeated row
    expected, got = brute(rows), result(spark, rows)
    assert got.keys() == expected.keys()
    for q in expected:
        assert [i for _, i in got[q]] == [i for _, i in expected[q]]
        assert [d for d, _ in got[q]] == pytest.approx([d for d, _ in expected[q]], abs=1e-12)


def test_few_or_no_candidates(spark):
    assert result(spark, [(0, [1.0, 2.0], 0, "a", "b"), (7, [1.0, 3.0], 0, "a", "b")]) == {0: [(1.0, 7)]}
    assert result(spark, [(0, [1.0, 2.0], 0, "a", "b")]) == {}
    assert mi.search(spark.createDataFrame([], SCHEMA), "id % 100 = 0").count() == 0


def test_recall(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0, "a", "b") for i, v in enumerate(x)]
    expected, got = brute(rows), result(spark, rows)
    hits = sum(len({i for _, i in expected[q]} & {i for _, i in got[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_walk_is_ordered():
    r = np.random.default_rng(2)
    a, b, sizes = r.random(9), r.random(7), r.integers(0, 3, 63)
    sums = (a[:, None] + b).ravel()
    cells = mi.walk(a, b, sizes, 10**9)
    assert cells == [c for c in np.argsort(sums).tolist() if sizes[c]]
    some = mi.walk(a, b, sizes, 20)
    assert some == cells[: len(some)] and sizes[some].sum() >= 20 > sizes[some[:-1]].sum()
