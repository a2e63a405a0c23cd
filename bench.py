"""Seconds per query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``load_star`` derives, writes and checks all tables. Every other query runs over the loaded tables,
to completion into a sink that discards rows. The better of two runs counts.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from tallyshelf import registry
from tallyshelf.plans import load_star
from tallyshelf.sources.tpch import raw_from_orders

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
RUNS = 2


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED", "file:///tmp/checkpoints"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    loads = [
        timed(lambda: load_star(spark, raw_from_orders(spark, FOLDER))),
        timed(lambda: registry.star_of(spark, FOLDER)),
    ]
    seconds = {"load_star": min(loads)}
    for name, query in registry.queries().items():
        def run():
            query(spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = min(timed(run) for _ in range(RUNS))
    scale = re.search(r"sf([\d.]+)", FOLDER)
    print(json.dumps({
        "metric": "total seconds, load plus every query",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(s, 3) for name, s in seconds.items()},
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
