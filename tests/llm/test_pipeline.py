"""The whole pipeline on a small hostile corpus against plain versions of its stages."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from quillstone.llm.mixing import mixed_documents
from quillstone.llm.queries import vocabulary

from .data import documents, prose
from .test_near_copies import brute_components, plain_fingerprint


@pytest.fixture
def folder(spark, tmp_path):
    items = [prose(900 + i, 30) for i in range(4)]
    texts = [prose(i, 40 + i) for i in range(60)] + [None, "", "12 34", prose(5, 45), prose(5, 45).upper(), prose(70, 50) + " " + items[1], items[2]]
    docs = documents(spark, texts, sources=[("a", "b", None)[i % 3] for i in range(len(texts))])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), texts


def test_pipeline(spark, folder):
    from tokenizers import Tokenizer

    path, texts = folder
    got = corpus_pipeline.run(spark, path).collect()
    known = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    roots = brute_components([plain_fingerprint(texts[i]) for i in known])
    known = [i for k, i in enumerate(known) if roots[k] == k]
    kept = [i for i in known if i not in (len(texts) - 2, len(texts) - 1)]
    source = [("a", "b", None)[i % 3] for i in kept]
    mixed = {r["doc_id"]: r["copies"] for r in mixed_documents(documents(spark, [texts[i] for i in kept], sources=source, ids=kept)).collect()}
    t = Tokenizer.from_file(vocabulary())
    expected, at = [], 0
    for i in kept:
        ids = t.encode(texts[i], add_special_tokens=False).ids + [2]
        for _ in range(mixed[i]):
            expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(expected)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder[0])
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["languages", "near copies", "benchmark", "mixing", "tokens"]


def test_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
