"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from loomgraph.plans.catalog import QUERIES
from loomgraph.session import local_session

HEADLINE = [
    "scan_records", "classify_roles", "edge_aggregate", "edge_samples", "fan_in_out", "dependency_hubs",
    "rolled_up_links", "neighbour_context", "search_ranked", "cone_dependencies", "shortest_path",
    "resolve_generated_code", "span_relations", "hot_paths", "error_paths", "call_tree", "trace_summary", "span_ratios",
    "otlp_spans",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "loomgraph-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        begin = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
