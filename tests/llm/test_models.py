"""Languages, toxic passages and benchmark leaks: held-out accuracy, plain versions, hostile rows."""

import random
import zlib

import numpy as np
import pytest

from quillstone.llm import decontaminate as de
from quillstone.llm import toxicity as tox
from quillstone.llm.language import KernelModel, accepted, fit_languages, predict_languages, presence

from .data import documents, prose

STEMS = {"xx": "ka lo mi re tu".split(), "yy": "schu wörz ßen kei ung".split(), "zz": "ción ña rro llu ez".split()}


def invented(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def test_languages(spark):
    langs = [("xx", "yy", "zz")[i % 3] for i in range(300)]
    texts = [invented(lang, i, 5 + i % 80) for i, lang in enumerate(langs)]
    extra = [None, "", "123 ---", "ÉÀ", invented("xx", 1, 30000)]
    docs = documents(spark, texts + extra, langs=langs + [None, "xx", "yy", None, "xx"])
    got = {r["doc_id"]: r for r in predict_languages(docs, fit_languages(docs)).collect()}
    assert len(got) == 305 and all(r["held_out"] == fold(i) for i, r in got.items())
    assert [got[i]["lang_pred"] for i in (300, 301, 302)] == ["und"] * 3 and got[300]["score"] == 0
    assert got[303]["lang_pred"] in STEMS and got[304]["lang_pred"] == "xx"
    tested = [i for i in range(300) if fold(i)]
    assert sum(got[i]["lang_pred"] == langs[i] for i in tested) >= 0.97 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # labels of the held-out fold are no input
    other = documents(spark, texts + extra, langs=["zz" if fold(i) else x for i, x in enumerate(langs)] + [None, "xx", "yy", None, "xx"])
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in predict_languages(other, fit_languages(other)).collect()} == {(i, r["lang_pred"], r["score"]) for i, r in got.items()}
    kept = accepted(docs, fit_languages(docs))
    assert kept.columns == docs.columns and kept.count() == 302


def test_no_language_to_learn(spark):
    docs = documents(spark, ["words", None], langs=[None, None])
    assert [(r["lang_pred"], r["score"]) for r in predict_languages(docs, fit_languages(docs)).collect()] == [("und", 0.0)] * 2
    empty = documents(spark, [])
    assert predict_languages(empty, fit_languages(empty)).count() == 0


def test_nystrom_is_the_kernel_machine():
    texts = [invented(lang, i, 20) for lang in STEMS for i in range(30)]
    labels = [lang for lang in STEMS for _ in range(30)]
    rows = presence(texts)
    model = KernelModel.fit(np.packbits(rows.astype(bool), axis=1), labels)
    unit = rows / np.sqrt(rows.sum(1, keepdims=True))
    kernel = unit @ unit.T  # all rows are landmarks here
    goal = np.where(np.array(labels)[:, None] == np.array(sorted(STEMS)), 1.0, -1.0)
    center = np.eye(90) - 1 / 90
    k = center @ kernel @ center
    dual = np.linalg.solve(k + 0.1 * np.eye(90), goal - goal.mean(0))
    assert model.outputs(rows) == pytest.approx(k @ dual + goal.mean(0), abs=2e-2)


def test_segments_against_all_pairs():
    r = random.Random(2)
    for _ in range(200):
        score = [r.choice([-0.5, -0.5, -0.5, 1.0, 2.0]) for _ in range(r.randrange(1, 40))]
        at = [i for i, s in enumerate(score) if s > 0]
        got = tox.maximal_segments(at, [score[i] for i in at], -0.5)
        # definition: the best segment, then the same left and right of it
        expected = []

        def split(lo, hi):
            best = max(((sum(score[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
            if best and best[0] > 0:
                split(lo, best[3])
                expected.append((best[3], best[4] - 1, best[0]))
                split(best[4], hi)

        split(0, len(score))
        assert sorted(round(x[2], 6) for x in got)[-1:] == sorted(round(x[2], 6) for x in expected)[-1:]
        assert sum(x[2] for x in got) == pytest.approx(sum(x[2] for x in expected))


def test_toxicity(spark):
    bad = "vile grim foul nasty".split()
    texts, marks = [], []
    r = random.Random(8)
    for i in range(400):
        toks = prose(i, 20 + i % 90).split()
        marks.append(int(i % 5 == 1))
        if marks[-1]:
            at = r.randrange(len(toks))
            toks[at:at] = [r.choice(bad) for _ in range(3)]
        texts.append(" ".join(toks))
    extra = [None, "", "grim foul nasty vile", prose(77, 40000)]
    docs = documents(spark, texts + extra)
    labels = spark.createDataFrame([(i, 1, m, "x") for i, m in enumerate(marks)] + [(3, 1, None, "x"), (None, 1, 1, "x"), (5, 1, marks[5], "x"), (9999, 1, 1, "x")], "doc_id bigint, quality int, toxic int, text string")
    got = {r["doc_id"]: r for r in tox.score_toxicity(docs, labels).collect()}
    assert len(got) == 404 and all(r["held_out"] == fold(i) for i, r in got.items())
    tested = [i for i in range(400) if fold(i)]
    assert all(got[i]["predicted"] == marks[i] for i in tested)
    assert got[402]["predicted"] == 1 and [got[i]["predicted"] for i in (400, 401, 403)] == [0, 0, 0]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    flipped = spark.createDataFrame([(i, 1, 1 - m if fold(i) else m, "x") for i, m in enumerate(marks)], labels.schema)
    again = {r["doc_id"]: r["score"] for r in tox.score_toxicity(docs, flipped).collect()}
    assert all(again[i] == pytest.approx(got[i]["score"]) for i in got)
    monkey = tox.SMALL_LABELS
    tox.SMALL_LABELS = 0
    try:
        shuffled = {r["doc_id"]: r["score"] for r in tox.score_toxicity(docs, labels).collect()}
    finally:
        tox.SMALL_LABELS = monkey
    assert all(shuffled[i] == pytest.approx(got[i]["score"]) for i in got)
    assert {r["score"] for r in tox.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert tox.score_toxicity(docs.limit(0), labels).count() == 0


def test_common_subsequence():
    r = random.Random(3)
    idf = np.ones(de.TERMS, np.float32)
    for _ in range(100):
        a, b = [r.randrange(6) for _ in range(r.randrange(5, 30))], [r.randrange(6) for _ in range(r.randrange(30))]
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0] * (len(b) + 1)
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        assert de.Item(1, np.array(a, np.int64), None, idf).common(b) == row[-1]


def test_leaks(spark, monkeypatch):
    monkeypatch.setattr(de, "PIECES", 12)  # several blocks
    items = [prose(1000 + i, 12 + 4 * i) for i in range(12)] + ["too short item", "six words stand here in order", None, ""]
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(items)] + [(None, items[3], "x", "y")], "item_id bigint, text string, doc_id string, answer string")
    r = random.Random(5)
    texts, expected = [], set()
    for d in range(60):
        body = prose(d, 150 + d).split()
        if d % 3 == 0:
            i = d // 3 % 12
            toks = items[i].split()
            if d % 2:  # a paraphrase: a few words changed
                for at in r.sample(range(len(toks)), len(toks) // 10):
                    toks[at] = "changed"
            at = r.randrange(len(body))
            body[at:at] = [t.upper() + "," for t in toks]
            expected.add((d, i))
            if i == 3:
                expected.add((d, None))
        texts.append(" ".join(body))
    texts += [None, "", "six words stand here in order", "six words stand in here order", "too short item", prose(1, 30000) + " " + items[5]]
    expected |= {(62, 13), (65, 5)}
    docs = documents(spark, texts)
    got = {(x["doc_id"], x["item_id"]) for x in de.find_leaks(docs, bench).collect()}
    assert got == expected
    kept = de.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == set(range(len(texts))) - {d for d, _ in expected}
    assert de.find_leaks(docs, bench.limit(0)).count() == 0 and de.find_leaks(docs.limit(0), bench).count() == 0


def test_items_of_all_lengths_word_for_word(spark):
    """Every item against every place of every text, where all items count."""
    vocabulary = "red blue green amber violet grey".split()
    r = random.Random(9)
    items = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (1, 1, 2, 2, 3, 4, 5, 6, 7)] + ["umbra", "umbra lux", ""]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 40))) for _ in range(25)] + ["an Umbra, lux!", "umbra nox", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {(x["doc_id"], x["item_id"]) for x in de.find_leaks(documents(spark, texts), bench, shortest=1).collect()}
    split = lambda t: de.words(t).tolist()
    held = lambda t, i: any(t[k : k + len(i)] == i for k in range(len(t) - len(i) + 1))
    assert found == {(d, k) for d, t in enumerate(texts) for k, i in enumerate(items) if split(i) and held(split(t), split(i))}
    assert {k for _, k in found} >= {0, 9, 10}
    few = {(x["doc_id"], x["item_id"]) for x in de.find_leaks(documents(spark, texts), bench).collect()}
    assert few == {(d, k) for d, k in found if len(items[k].split()) >= de.SHORTEST}


@pytest.mark.parametrize("least", [0.05, 0.35, 2.0])
def test_short_items_at_every_place(spark, monkeypatch, least):
    monkeypatch.setattr(de, "LEAST_COSINE", least)  # 0.05: the stretch that is checked decides; 2.0: no cosine reaches it
    items = {n: prose(2000 + n, n).split() for n in range(5, 14)}
    texts, expected = [], []
    for n, item in items.items():
        for size in (20, 32, 33, 47, 200):
            body = prose(10 * size + n, size - n).split()
            for at in (0, len(body) // 2, len(body)):
                expected.append([n])
                texts.append(" ".join(body[:at] + item + body[at:]))
    idf = de.weights(documents(spark, texts))
    space = de._space(spark, [de.Item(n, de.words(" ".join(t)), None, idf) for n, t in items.items()], idf)
    assert [[x[0] for x in space.leaks(t)] for t in texts] == expected  # on the driver, where the patch holds


def test_common_words_beside_rare_ones(spark):
    common = prose(1, 60).split()
    items = [" ".join(common[5 * n : 6 * n]) for n in (5, 6, 7, 8, 9)]  # five to nine words
    texts = [" ".join(common)] * 40  # which makes the words common
    rare = [f"rare{i}" for i in range(5 * 60)]
    texts += [" ".join(rare[60 * i : 60 * i + 30] + t.split() + rare[60 * i + 30 : 60 * i + 60]) for i, t in enumerate(items)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {(x["doc_id"], x["item_id"]): x for x in de.find_leaks(documents(spark, texts), bench).collect()}
    expected = {(40 + i, i) for i in range(5)}
    assert expected <= set(found)
    assert all(found[x]["item_share"] == 1 and 0 < found[x]["cosine"] < 0.35 for x in expected)


def test_latent_space_keeps_all_of_the_benchmark(spark):
    docs = documents(spark, [prose(i, 200) for i in range(20)])
    idf = de.weights(docs)
    items = [de.Item(i, de.words(prose(500 + i, 20 + i)), None, idf) for i in range(30)]
    space = de._space(spark, items, idf)
    rows = [de._distinct_terms(np.array(i.tokens, np.int64), [0], idf) for i in items]
    plain = np.zeros((len(rows), de.TERMS), np.float32)
    for row, (terms, weight) in zip(plain, rows):
        np.add.at(row, terms[0], weight[0])
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    latent = np.concatenate([space.project(*r) for r in rows])
    assert latent @ latent.T == pytest.approx(plain @ plain.T, abs=1e-4)
