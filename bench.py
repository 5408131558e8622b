"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
Each query is run once to warm up, then timed; the value is the sum of the times.
The rows a second are the query's input rows over its time.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from rillmark.plans.catalogue import QUERIES

#: Query: the table whose rows it reads.
HEADLINES = {
    "ysb_click_counts": "events",
    "ysb_ratio": "events",
    "ysb_multi_query": "events",
    "ysb_sliding": "events",
    "window_total_count": "events",
    "latency_sum": "events",
    "rel_group_by": "lineitem",
    "rel_smj_inner": "lineitem",
    "rel_smj_composite": "lineitem",
    "rel_join_then_group": "lineitem",
    "rel_sort_string_top25": "customer",
    "map_reduce_sum": "part",
    "stream_click_counts": "events",
    "generated_click_counts": "",
}


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    seconds, rates = {}, {}
    for name, table in HEADLINES.items():
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        if table:
            rates[name] = round(spark.read.parquet(f"{folder}/{table}.parquet").count() / seconds[name])
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rows_per_second": rates, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
