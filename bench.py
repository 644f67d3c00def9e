"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the folder of parquet tables, BENCH_CPUS the number of local cores. Every query is
run once to its last row, after the same queries have run on the smallest tables to warm up the
JVM. Building the edges and writing the rounds' tables are inside the time.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workload.queries import queries  # noqa: E402

HEADLINES = (
    "cc_order_part",
    "cc_part_supplier",
    "cc_bulk_order_part",
    "cc_customer_order",
    "cc_doc_copies",
    "cc_doc_lines",
    "component_count_file",
    "multi_graph_counts",
    "cc_by_ccf_join",
    "iteration_log_order_part",
    "cc_by_contraction",
    "ccf_step_join",
    "ccf_step_array",
    "adjacency_lists",
    "neighbour_min",
)
WARM_UP = "/root/testdata/sf0.001"


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("archipelago-bench")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Hash instead of sort where the build side's partitions are known to be small.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = session(cpus)
    chosen = queries()
    if Path(WARM_UP).exists():
        for name in HEADLINES:
            run(chosen[name](spark, WARM_UP))
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        run(chosen[name](spark, folder))
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "connected components, total of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(Path(folder).name.removeprefix("sf")),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
