"""Token files, archives, source mixing and URL filters against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import token_files as tf
from quillstone.llm.mixing import mixed_documents
from quillstone.llm.queries import URL_RULES, vocabulary
from quillstone.llm.urls import RuleTrie, filter_urls
from quillstone.llm.warc import build_record, read_archives, read_records, write_archives

from .data import documents, prose


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=400))
def test_coding_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, escapes = tf.encode_block(ids)
    assert (tf.decode_block(words, escapes, len(ids)) == ids).all()
    assert len(escapes) == (ids >= 2**60).sum()


def test_coding_is_packed():
    words, _ = tf.encode_block(np.array([1] * 120 + [40000] * 30, np.uint64))
    assert len(words) <= 2 + 10


def test_token_files(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "  ", "Plain words, it's 2024!", "é e\u0301 <|endoftext|> x<|startoftext|>y", prose(1, 30000), "dup", "dup", "\u00a0\u2003wide"]
    ids = [7, 3, None, -5, 900, 2, 11, 11, 1]
    got = tf.read_token_files(tf.write_token_files(documents(spark, texts, ids=ids), vocabulary())).collect()
    got.sort(key=lambda r: r["start"])
    t = Tokenizer.from_file(vocabulary())
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
    at = 0
    for row, i in zip(got, order):
        expected = t.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (ids[i], at, len(expected))
        assert row["ids_crc32"] == zlib.crc32(np.array(expected, "<u4").tobytes())
        at += len(expected)
    assert len(got) == len(ids)
    assert tf.read_token_files(tf.write_token_files(documents(spark, []), vocabulary())).count() == 0


def test_archives(spark, tmp_path):
    big, other = "x" * 200, "<p>é</p>" * 5000
    rows = [(5, "http://a/b c\n", big), (2, None, big), (9, "u", big), (None, "u", big), (3, "u", None), (4, "u", "short"), (6, "u", "short"), (7, "u", other), (8, "u", "")]
    pages = spark.createDataFrame([(*r, "extra", "k") for r in rows], "page_id bigint, url string, html string, digest string, key string")
    archives = write_archives(pages)
    got = {r["key"]: r for r in read_archives(archives).collect()}
    assert len(got) == len(rows) and all(r["intact"] for r in got.values())
    for key, _, html in rows:
        raw = (html or "").encode()
        r = got[key]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if html == big and key != 2 else ("response", None))
    for a in archives.collect():
        with open(a["path"].removeprefix("file:"), "rb") as f:
            assert len(list(read_records(f))) == a["n_records"]
    assert read_archives(write_archives(pages.limit(0))).count() == 0


def test_archive_with_dictionary(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "<html><body>" + prose(i, 60)) for i in range(300)], "page_id bigint, url string, html string")
    archives = write_archives(pages)
    assert {r["record_type"] for r in read_archives(archives).collect()} == {"response"}
    alone = sum(len(zstandard.compress(build_record(r["page_id"], r["url"], r["html"].encode(), "0" * 64, None, "2000-01-01T00:00:00Z"))) for r in pages.collect())
    assert archives.agg({"n_bytes": "sum"}).first()[0] < 0.8 * alone


def test_mixing(spark):
    sources = ["a"] * 400 + ["b"] * 20 + ["c"] * 90 + [None] * 40 + ["empty"]
    texts = [prose(i, 1 + i % 60) for i in range(549)] + [None, ""]
    docs = documents(spark, texts, sources=sources)
    got = mixed_documents(docs).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    total, per = sum(size), Counter()
    for s, n in zip(sources, size):
        per[s] += n
    order = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] if per[s] else 0 for i, s in enumerate(order)}
    want, free = {s: 0.0 for s in order}, {s for s in order if weight[s]}
    left = 1.5 * total
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * per[s]}
        if not over:
            want.update({s: level * weight[s] for s in free})
            break
        for s in over:
            want[s] = 2.0 * per[s]
            left -= want[s]
        free -= over
    taken = Counter()
    for r in got:
        i = r["doc_id"]
        assert r["size"] == size[i] and r["source_size"] == per[sources[i]]
        assert r["target"] == pytest.approx(want[sources[i]]) and r["taken"] <= 2 * r["size"]
        taken[sources[i]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 120 for s in order)
    again = mixed_documents(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
    assert mixed_documents(docs.limit(0)).count() == 0


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "https://WWW.Example.com/en/x?q#f", "https://m.example.com/en/", "https://m.example.com/en", "http://example.com?x=/en/",
        "http://a.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://a.net/de/", "http://com", "http://com/", "a://b://c/d", "http://example.com/en/\n/x", "http://h:80/p?",
    ]
    df = spark.createDataFrame([(i, u, "e", "f") for i, u in enumerate(urls)] + [(99, urls[4], "e", "f")], "page_id bigint, url string, host string, rule string")
    rules = [(v, *r.partition("/")[::2]) for v, r in URL_RULES]
    for r in filter_urls(df, URL_RULES, "page_id", "url").collect():
        rest = (urls + [None] * 90)[r["page_id"]] if r["page_id"] < 90 else urls[4]
        rest = rest.split("://", 1)[1] if rest and "://" in rest else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.lower()
        fits = [(len(h + p), f"{h}/{p}", v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *best[1:]), urls
    assert filter_urls(df.limit(0), URL_RULES, "page_id", "url").count() == 0


def test_trie_prefixes():
    trie = RuleTrie([("block", "a.b/x/y"), ("allow", "a.b/x/yz/"), ("block", "b"), ("allow", "b/")])
    assert trie.find("a.b", "/x/yellow") == ("a.b/x/y", "block")
    assert trie.find("q.a.b", "/x/yz/1") == ("a.b/x/yz/", "allow")
    assert trie.find("b", "") == ("b", "block") and trie.find("c.b", "/z") == ("b/", "allow")
    assert trie.find("ab", "/") is None
