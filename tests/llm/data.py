"""Small hostile tables: nulls everywhere, empty and long texts, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty knoll ledge marsh north ocean prairie quarry ridge slope thorn".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, hash string, copies string, key string, toxic string, text_hash string, fp string, root string, kept_id string"


def documents(spark, texts, langs=None, sources=None, ids=None):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [
        (ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or ""), "x", "y", "z", *"abcdef") for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA)
