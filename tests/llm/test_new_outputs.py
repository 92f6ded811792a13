"""Importance resampling, the Merkle manifest and packing against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import importance, merkle, packing
from quillstone.llm.numbering import numbered
from quillstone.llm.queries import vocabulary

from .data import prose

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, number long, place_ string, at_ string, part_ string, tree string, digest string, block string, "
    "n string, t string, tampered string, proof string, shape string, subroot string, n_words string, weight string, score string, all_ string, length string, ids string, piece string"
)


def docs(spark, rows):
    """Documents with extra columns that carry the operators' own names."""
    return spark.createDataFrame([(*r, 1, *["x"] * 19) for r in rows], SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)


def hostile():
    texts = [None, "", "  \n", "Plain WORDS, it's 2024!", "é é {x} Äb c", prose(1, 20000), "dup dup", "dup dup", "  wide", "A" * 5000 + " b", "a\x00b\x00c d"]
    langs = ["en", None, "", "en", "de", "en", "en", "en", None, "zz", "é"]
    ids = [7, 3, None, -5, 900, 2, 11, 11, 1, 4, 12]
    rows = [(i, t, l, "s" if i else None, len(t or "") if i != 3 else None) for i, t, l in zip(ids, texts, langs)]
    return rows + [(100 + i, prose(i, 15 + i % 9).title(), "fr", "w", i) for i in range(700)]


def test_numbers_within_groups(spark):
    rows = [(i % 3 if i % 5 else 0, i // 7) for i in range(3000)]
    got = numbered(spark.createDataFrame(rows, "g long, v long"), "g", [__import__("pyspark.sql.functions", fromlist=["col"]).col("v").desc()]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["number"])
        assert [r["number"] for r in mine] == list(range(len(mine))) and [r["v"] for r in mine] == sorted((v for h, v in rows if h == g), reverse=True)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=120), max_size=8), st.integers(0, 200))
def test_features_of_a_batch(texts, size):
    texts = [t + b"w" * size for t in texts] + [b""]
    got = Counter()
    for document, buckets in importance.batch_features(texts):
        got.update(zip(document.tolist(), buckets.tolist()))
    expected = Counter()
    for i, t in enumerate(texts):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        expected.update((i, zlib.crc32(b" ".join(w[a : a + n])) % 10000) for n in (1, 2, 3) for a in range(len(w) - n + 1))
    assert got == expected


def brute_resample(rows, target):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low.encode())
        return len(w), Counter(zlib.crc32(b" ".join(w[a : a + n])) % 10000 for n in (1, 2, 3) for a in range(len(w) - n + 1))

    own, s, t = [features(r[1]) for r in rows], Counter(), Counter()
    for _, f in own:
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for (doc_id, *_), (n, f) in zip(rows, own):
        weight = sum(m * math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b, m in f.items())
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, n, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0]))
    drawn = len(fit) * 5 // 100
    return [(r[0], *r[2:], i + 1 if i < drawn else None) for i, r in enumerate(fit)] + [(r[0], *r[2:], None) for r in out if r[1] < 20]


def test_importance_resampling(spark):
    rows = hostile()
    target = [prose(5, 50), None, "", "Plain words"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, bucket string")
    got = [tuple(r) for r in importance.resample(docs(spark, rows), bench).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(brute_resample(rows, target), key=key)
    assert importance.resample(docs(spark, []), bench).count() == 0
    assert {r["rank"] for r in importance.resample(docs(spark, rows[:5]), bench.limit(0)).collect()} == {None}


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_tree(leaves):
    """Root and, for every leaf, its siblings by level as (before, after)."""
    level, proofs, place = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(place):
            lo = at // 8 * 8
            proofs[i].append((level[lo:at], level[at + 1 : lo + 8]))
        level = [H(*level[lo : lo + 8]) for lo in range(0, len(level), 8)]
        place = [p // 8 for p in place]
    return level[0], proofs


def brute_manifest(rows):
    lower = lambda t: t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, t: H(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(t))
    trees = {}
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        own = leaf(r, r[1])
        trees.setdefault(r[2], []).append((r[0], own, leaf(r, lower(r[1])) if tampered else own))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    for n in names:
        trees[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    parts = {n: brute_tree([r[1] for r in trees[n]]) for n in names}
    root, tops = brute_tree([parts[n][0] for n in names])
    out = []
    for n, top in zip(names, tops):
        for (doc_id, own, used), steps in zip(trees[n], parts[n][1]):
            steps = steps + top
            for before, after in steps:
                used = H(*before, used, *after)
            out.append((doc_id, own, parts[n][0], root, H(*[x for b, a in steps for x in (*b, *a)]), used, used == root))
    return out


@pytest.mark.parametrize("limit", [merkle.QUEUE_BYTES, 3000])
def test_merkle_manifest(spark, limit):
    rows = hostile()
    key = lambda r: tuple((x is not None, x) for x in r)
    expected = sorted(brute_manifest(rows), key=key)
    got = merkle.merkle_manifest(docs(spark, rows), queue_bytes=limit).collect()
    assert sorted((tuple(r[:7]) for r in got), key=key) == expected
    for r in got:
        assert H(r["proof"]) == r["proof_sha256"]
        assert merkle.folded(bytes.fromhex(r["leaf"]), bytes.fromhex(r["proof"]), r["shape"]).hex() == r["root"]
    assert merkle.merkle_manifest(docs(spark, [])).count() == 0
    one = merkle.merkle_manifest(docs(spark, rows[:1]), with_proof=False).collect()
    assert [tuple(r) for r in one] == brute_manifest(rows[:1])


def test_many_trees_of_many_blocks(spark):
    """Blocks of eight leaves: several rounds for leaves and for subroots."""
    rows = [(i, f"T {i}", f"l{i % 70 if i % 3 else 0}", "s", i) for i in range(400)]
    assert sorted(tuple(r) for r in merkle.merkle_manifest(docs(spark, rows), False, levels=1).collect()) == sorted(brute_manifest(rows))


def test_label_queue_spills():
    queue = merkle.LabelQueue(limit=2000)
    sent = [(i * 7919 % 101, b"%d" % i) for i in range(500)]
    for label, message in sent:
        queue.send(label, message)
    assert queue.runs
    for label in range(101):
        assert queue.take(label) == [m for k, m in sent if k == label]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1), st.sampled_from([60, 61, 100]))
def test_plans_are_packings(counts, capacity):
    plan = packing.best_plan(counts, capacity)
    length = np.concatenate([np.full(n, k) for k, n in counts.items()])
    number = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, offset = packing.places(plan.arrays(), length, number)
    check_packing(list(zip(sequence.tolist(), offset.tolist(), length.tolist())), capacity)
    assert len(set(sequence.tolist())) == plan.sequences
    assert plan.sequences <= 1.25 * -(-int(length.sum()) // capacity) + (length > capacity // 3).sum() / 2 + 2


def check_packing(pieces, capacity):
    end = {}
    for sequence, offset, length in sorted(pieces):
        assert offset == end.get(sequence, 0)
        end[sequence] = offset + length
        assert end[sequence] <= capacity


def test_programme_beats_best_fit():
    """Sizes of a third, a third and a bit less fill sequences exactly; best fit decreasing does not find that."""
    counts = {45: 300, 34: 300, 21: 300}
    assert packing.Plan(counts, 100, 10).sequences == 300
    assert packing.best_plan({2048: 5, 1: 10}, 2048).sequences == 6


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    rows = hostile()
    got = packing.pack_documents(docs(spark, rows), vocabulary(), capacity=256).collect()
    t = Tokenizer.from_file(vocabulary())
    expected = Counter()
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for number, at in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[at : at + 256], "<u4").tobytes()
            expected[r[0], number, at, len(part) // 4, zlib.crc32(part), part] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got) == expected
    check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in got], 256)
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= 1.02 * total / 256 + 2
    assert packing.pack_documents(docs(spark, []), vocabulary()).count() == 0
