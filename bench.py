"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR chooses the data, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = [
    "layers_kldiv", "layers_cka", "layers_wasserstein", "layers_tvd", "layers_jsd", "layers_rsacorr",
    "layers_rsarank", "layers_jaccard", "coordinates_kldiv", "gram_sales", "sales_cka", "sales_kldiv",
    "voxel_reliability", "supplier_reliability", "noise_by_run", "noise_grid", "loglik_voxel_noise",
    "loglik_noise_grid", "log_posterior", "logpost_boxplot",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from kindred.plans.queries import all_queries

    queries = all_queries()
    # start the Python workers and compile the common code paths first
    for name in ("layers_cka", "sales_cka", "voxel_reliability"):
        queries[name](spark, sf_dir).collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
