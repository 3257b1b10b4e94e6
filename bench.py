"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, seconds per query (median of three warm runs)."""

import json
import os
import re
import statistics
import time

from pyspark.sql import SparkSession

from trellis import roster


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.log.level", "ERROR").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    names = ["flagship", *sorted(n for n in roster.QUERIES if n.startswith("bench_"))]
    seconds, cold = {}, {}
    for n in names:
        runs = []
        for _ in range(4):
            t = time.time()
            roster.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        cold[n], seconds[n] = round(runs[0], 3), round(statistics.median(runs[1:]), 3)
    sf = re.search(r"sf([\d.]+)$", sf_dir.rstrip("/"))
    print(json.dumps({"metric": "graph_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "cold": cold, "sf": float(sf[1]) if sf else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
