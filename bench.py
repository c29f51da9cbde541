"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + ":" + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

#: The operations that a whole run is made of, and the run itself.
HEADLINES = ("profile_lineitem", "profile_all_tables", "identifiability_customer", "fd_matrix_customer", "fd_matrix_part", "unique_test_lineitem", "composite_key_lineitem",
             "join_coverage", "orphan_counts", "join_discovery", "grain_duplicates_lineitem", "aggregation_stability_lineitem_part", "star_view_lineitem",
             "functional_groups", "run_all")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from keelson.plans.catalogue import QUERIES

    took = {}
    for name in HEADLINES:  # one run to warm up, then the median of three
        runs = []
        for _ in range(4):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(sorted(runs[1:])[1], 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
