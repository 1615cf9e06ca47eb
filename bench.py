"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame

from rolewise.plans import bindings as B
from rolewise.plans import catalog
from rolewise.session import local_session

HEADLINE = (
    "score_applications",
    "top_candidates_per_offer",
    "rank_all_applications",
    "weight_scenarios",
    "bias_audit",
    "filter_candidates",
    "ranking_evaluation",
    "threshold_curve",
    "rater_pairs_kappa",
    "merged_tenure",
    "coherence_findings",
    "bm25_search",
    "vector_top_k",
    "entity_resolution",
    "latency_percentiles",
    "purge_plan",
)


def run(df: DataFrame) -> None:
    """Compute every column of every row without collecting any."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "rolewise-bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    start = time.perf_counter()
    B.tables(spark, folder)
    times["stage_tables"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        run(catalog.QUERIES[name](spark, folder))
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
