"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line: the median of RUNS runs after a warm-up."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from barloom.plans import catalog

HEADLINE = ("bars_weekly", "op_rank", "op_ts_corr", "alpha101_003", "alpha101_006", "alpha191_032", "alpha191_009", "alpha101_together", "study_evaluate", "bt_grid")
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found, took = catalog.queries(), {}

    def run(name: str) -> float:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - began

    run(HEADLINE[0])  # warm-up
    for name in HEADLINE:
        took[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
