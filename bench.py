"""Time the headline queries; prints one JSON line.

Every query is timed cold (it builds the index it needs) and warm (the index is there).
``value`` is the sum of the cold times.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from askgrid.registry.queries import QUERIES, forget_indexes  # noqa: E402
from askgrid.session import build_session  # noqa: E402

HEADLINES = (
    "chunk_hierarchical", "tokenize_terms", "term_statistics", "build_index", "bm25_topk",
    "knn_l2_exact", "auto_merge", "hybrid_union", "join_docstore", "dedup_jaccard",
    "jaccard_pairs_corpus", "rerank_topn", "top5_contexts", "keyword_subquery", "retrieve_contexts",
    "assess_questionnaire", "rag_answer", "sink_update_response", "sink_upsert_response",
    "filter_leaf_nodes", "stage_metrics", "stream_questions",
)


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINES
    spark = build_session("bench", f"local[{cpus}]", os.environ.get("BENCH_MEMORY", "12g"), cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the engine before the clock
    cold, warm = {}, {}
    for name in names:
        forget_indexes()
        cold[name] = run(spark, folder, name)
        warm[name] = run(spark, folder, name)
        print(name, cold[name], warm[name], file=sys.stderr, flush=True)
    forget_indexes()
    print(json.dumps({
        "metric": "headline queries, cold, total wall time", "value": round(sum(cold.values()), 3),
        "unit": "sec", "queries": cold, "warm": warm, "warm_total": round(sum(warm.values()), 3),
        "sf": folder.rstrip("/").split("sf")[-1], "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
