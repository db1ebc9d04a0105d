"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from flowspark.plans.queries import QUERIES  # noqa: E402
from flowspark.session import local_session  # noqa: E402

HEADLINES = [
    "triage_overview", "label_map", "label_distribution", "median_impute", "column_medians", "minmax_scale", "corr_pairs", "corr_pairs_wide",
    "stratified_sample", "stratified_split", "signature_hits", "describe_flow", "adjacency_top5", "clean_text", "knn_topk", "bm25_rerank",
    "context_pack", "vec_upsert", "parse_responses", "triage_outcome", "triage_metrics", "config_ranking", "run_diff", "batch_progress",
    "config_grid", "rf_train", "preprocess_unified",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["drop_identifiers"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
