"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recallflow.plans import registry
from recallflow.session import get_spark

HEADLINE = [
    "recall_lexical_top5", "recall_knn", "strength_memory_state", "jobs_sleep_cycle", "text_tokens", "text_auto_facts", "corpus_token_weights",
    "corpus_cooccurrence_window", "strength_dedup", "strength_surprise_parts", "sessions_spectrum",
    "sessions_coupling", "temporal_resolve_dates", "entities_components", "embeddings_collective",
    "metering_running_ops", "metering_window_usage", "metering_reconcile", "metering_monthly_snapshot",
    "analytics_funnel", "analytics_consumption_by_user", "analytics_ops_health", "analytics_daily_cost",
    "access_effective_scopes", "access_webhook_failures", "store_append_usage", "store_rollup_monthly",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = get_spark(
        "bench", master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.recallflow.textPartitions": cpus, "spark.driver.memory": "16g"},
    )
    queries = registry.load()[0]
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the engine
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        if only:
            print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
    }))


if __name__ == "__main__":
    main()
