"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm the JVM and twice timed, results going to Spark's no-op sink; the better time counts."""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

HEADLINE = [
    "count_metadata", "filter_eq", "filter_in", "filter_range_float", "filter_contains", "count_where", "point_lookup", "agg_group", "agg_distinct", "agg_cube", "agg_percentile_disc", "join_fk_star", "join_count", "join_agg", "join_topk", "join_semi",
    "join_anti", "window_rank", "window_running", "topk", "union", "intersect", "subquery_correlated", "vector_topk_cosine", "vector_hamming_topk", "jaccard_topk", "sparse_topk", "hybrid_rrf", "fts_match", "fts_rank", "approx_agg", "json_extract",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    from tessera.plans.registry import queries

    made, times = queries(), {}
    for name in HEADLINE:
        best = None
        for attempt in range(3):
            start = time.perf_counter()
            made[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if attempt and (best is None or took < best) else best
        times[name] = round(best, 4)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    start = time.perf_counter()
    rows.write.format("noop").mode("overwrite").save()
    times["scan_all_columns"] = round(time.perf_counter() - start, 4)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
