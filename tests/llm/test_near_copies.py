"""SimHash components against all pairs; star components against union-find."""

import random
import re

import pytest
from xxhash import xxh64_intdigest

from quillstone.llm import simhash as sh
from quillstone.llm.components import components

from .data import documents, prose


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("crowded", [256, 3])
def test_components(spark, monkeypatch, crowded):
    monkeypatch.setattr(sh, "CROWDED", crowded)
    r = random.Random(4)
    base = prose(1, 400).split()
    texts = [None, "", " \t", "One two", "ONE TWO", "one  two three four five É", prose(9, 20000)]
    for k in range(40):  # near copies: a word or two differ
        copy = list(base)
        for _ in range(k % 3):
            copy[r.randrange(len(copy))] = "other"
        texts.append(" ".join(copy))
    texts += [prose(50 + k, 30) for k in range(20)] + ["same text here"] * 5
    ids = random.Random(1).sample(range(1000), len(texts))
    got = {r["doc_id"]: r for r in sh.near_duplicates(documents(spark, texts, ids=ids)).collect()}
    values = [plain_fingerprint(t) for t in texts]
    roots = brute_components(values)
    for i, d in enumerate(ids):
        assert got[d]["fp"] % (1 << 64) == values[i]
        assert got[d]["component_id"] == min(ids[j] for j in range(len(ids)) if roots[j] == roots[i])


def test_links_of_dense_balls(spark, monkeypatch):
    monkeypatch.setattr(sh, "CROWDED", 8)
    r = random.Random(7)
    center = r.getrandbits(64)
    values = {center} | {center ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)}
    values = sorted(values)
    frame = spark.createDataFrame([(sh.signed(v),) for v in values], "fp bigint")
    found = {(x["node"], x["root"]) for x in components(sh.links(frame), "a", "b").collect()}
    roots = dict(found)
    expected = brute_components(values)
    label = {v: roots.get(sh.signed(v), sh.signed(v)) for v in values}
    for i, v in enumerate(values):
        for j in range(i):
            assert (expected[i] == expected[j]) == (label[v] == label[values[j]])


def test_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(7, 7)]
    got = {(r["node"], r["root"]) for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {(i, 100) for i in range(100, 161)} | {(k, 5) for k in (5, *range(200, 260))}


def test_one_of_each(spark):
    texts = ["a b c d", "A B C D", "a b c d", None, None, "", prose(3, 50), prose(3, 50), "a b c d"]
    ids = [9, 4, 4, None, None, None, 8, 8, 30]
    kept = sh.one_of_each(documents(spark, texts, ids=ids))
    assert kept.columns == documents(spark, texts).columns
    rows = sorted((r["doc_id"] or -1, (r["text"] or "").lower()) for r in kept.collect())
    assert rows == [(-1, ""), (4, "a b c d"), (8, prose(3, 50))]
    assert sh.one_of_each(documents(spark, [])).count() == 0
    assert sh.near_duplicates(documents(spark, [])).count() == 0


def five_word_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_components(texts):
    sets, root = [five_word_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


@pytest.mark.parametrize("crowded, frequent", [(256, 3), (3, 3), (3, 10**9), (8, 1)])
def test_near_copies_against_all_pairs(spark, monkeypatch, crowded, frequent):
    monkeypatch.setattr(sh, "CROWDED", crowded)
    monkeypatch.setattr(sh, "FREQUENT", frequent)
    monkeypatch.setattr(sh, "CENTERS", 2)
    r = random.Random(6)
    texts = [None, "", " \t", "One two", "ONE  TWO", "one two three four five É", "same text here", "Same text\there"]
    for family in range(6):  # chains of copies, a few words more changed each time; a common line in all
        base = (prose(100, 12) + " " + prose(family, 30 + 60 * family)).split()
        for k in range(14):
            copy = list(base)
            for _ in range(r.randrange(1 + len(base) // 40 + k % 3)):
                copy[r.randrange(len(copy))] = f"other{r.randrange(1000)}"
            if k % 4 == 0:
                base = copy
            texts.append(" ".join(copy).upper() if k % 5 == 0 else " ".join(copy))
    texts += [prose(100, 12) + " " + prose(300 + k, 30) for k in range(20)]
    ids = random.Random(1).sample(range(1000), len(texts))
    got = {x["doc_id"]: x["component_id"] for x in sh.near_copies(documents(spark, texts, ids=ids)).collect()}
    roots = similar_components(texts)
    assert got == {d: min(ids[j] for j in range(len(ids)) if roots[j] == roots[i]) for i, d in enumerate(ids)}
    assert len(set(roots)) < len({sh.fingerprint((t or "").encode()) for t in texts})  # more than op7 finds
    assert sh.near_copies(documents(spark, [])).count() == 0


def test_near_copy_stage_drops_changed_copies(spark):
    import corpus_pipeline

    text = prose(1, 200).split()
    copy = list(text)
    copy[50] = copy[150] = "other"
    docs = documents(spark, [" ".join(text), " ".join(copy), prose(2, 200)])
    assert sorted(x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 2]


def test_one_large_group_takes_few_pairs(spark, monkeypatch):
    """Pairs of a group of near copies grow with its size, not with its square."""
    monkeypatch.setattr(sh, "CROWDED", 16)
    base, texts, r = prose(5, 150).split(), [], random.Random(9)
    for k in range(160):  # two words changed: most pairs are similar, some only by way of others
        copy = list(base)
        for _ in range(2):
            copy[r.randrange(len(copy))] = f"other{k}"
        texts.append(" ".join(copy))
    made, keep = [], sh.stored

    def counted(df, name, **kept):
        rows = keep(df, name, **kept)
        if name in ("pairs", "plausible", "rest"):
            made.append(rows.count())
        return rows

    monkeypatch.setattr(sh, "stored", counted)
    got = {x["doc_id"]: x["component_id"] for x in sh.near_copies(documents(spark, texts)).collect()}
    assert got == dict(enumerate(similar_components(texts)))
    assert sum(made) < 15 * len(texts)


def test_near_copies_start_from_simhash(spark, monkeypatch):
    """The named method proposes the first candidates: sets with near SimHashes of their five-word shingles, found by pivot tables."""
    proposed, plain = [], sh._print_pairs
    monkeypatch.setattr(sh, "_print_pairs", lambda sets: proposed.append(plain(sets).collect()) or plain(sets))
    base = prose(8, 900).split()
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), prose(9, 900)]
    got = {x["doc_id"]: x["component_id"] for x in sh.near_copies(documents(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 2} and len(proposed) == 1 and len(proposed[0]) == 1
