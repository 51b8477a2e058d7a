"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line.

Each query runs once to warm up and then twice; the better time counts. Results go to Spark's noop sink, so all
rows and columns are produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "scan_label", "filter_range", "agg_group", "top_k_by_expression", "expand_1hop", "expand_3hop", "cyclic_pattern", "exists_semi", "optional_match",
    "varlen_both", "sparql_bgp", "sparql_aggregate", "gremlin_where", "triangles", "degree", "components", "pagerank", "sssp",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from weftgraph.queries import QUERIES

    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(min(runs[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline graph queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
