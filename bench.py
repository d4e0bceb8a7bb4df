"""Times the archive's headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The records, which the queries read, are made and timed first. ``queries`` has each query's first run, ``warm`` its second;
``value`` is the sum of the records and the first runs.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from cinelake.plans.queries import QUERIES, records

HEADLINES = ["q06_comparisons", "q11_exact_duplicates", "q12_hash_cascade", "q13_same_film", "q14_best_versions", "q15_local_groups", "q23_enrichment", "q24_summary", "q26_response_cache"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()

    def timed(make) -> float:
        began = time.time()
        make(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    took, warm = {"records": timed(records)}, {}
    for name in HEADLINES:
        took[name], warm[name] = timed(QUERIES[name]), timed(QUERIES[name])
    out = {"metric": "archive records and queries, first runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "warm": warm}
    print(json.dumps(out | {"sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
