"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "ret_01_keyword_search",
    "ret_07_resource_search",
    "ret_10_recommend_resources",
    "ret_16_chapter_routing",
    "ret_20_trigram_similarity",
    "sql_01_card_first_search",
    "sql_03_resource_recommendation",
    "vec_02_vector_search",
    "sql_06_knn_all_vectors",
    "val_01_package_validation",
    "aud_06_alignment_status",
    "joi_22_term_matrix",
    "etl_06_scope_duplicates",
    "snk_04_upsert",
    "txt_05_tokens",
    "agg_12_frequent_terms",
    "ren_01_render_answer",
)


def main() -> None:
    from quillstone.plans.registry import load
    from quillstone.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "16g")
    queries, _ = load()
    spark.read.parquet(f"{folder}/documents.parquet").count()  # start executors before the clock
    seconds = {}
    for name in names:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
             "sf": Path(folder).name.removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
