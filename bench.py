"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
cores. Each query runs in full into a sink that keeps nothing, and nothing kept
by one query is left for the next. The JVM and Python's workers are started by
a query that is not timed.
"""

import json
import os
import sys
import time

from rankforge.plans import QUERIES
from rankforge.plans.runs import forget
from rankforge.session import build_session, table

HEADLINE = [
    "dense_topk", "dense_metrics_grouping_sets", "dense_systems_top5", "restricted_topk",
    "tokenize_ws_vocab", "bm25_topk", "bm25_bigram_topk", "dense_text_topk", "rrf_hybrid", "multi_query_fusion",
    "borda_fusion", "grid_retrieval_top20", "rerank_overlap_top5", "qrels", "retrieval_runs", "metrics_by_group",
    "ox_votes", "leaderboard", "majority_consolidated", "leave_one_out_rank_change", "wilson_ci",
    "spearman_matrix", "judge_agreement", "bootstrap_gap",
    "score_extract_canonical", "context_precision", "provider_chat",
    "chunk_paragraph_pack", "chunk_character", "chunk_sentence_overlap", "chunk_recursive_300_50", "chunk_semantic",
    "html_to_text_pages", "last_write_wins", "config_grid_384", "stream_registry_latest",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "rankforge-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["usable_query_metrics"](spark, sf_dir).collect()
    took = {}
    for name in names:
        forget()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "headline queries, total",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": int(cpus),
    }
    if "dense_topk" in took:
        result["dense_queries_per_sec"] = round(table(spark, sf_dir, "embeddings").count() / took["dense_topk"], 1)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
