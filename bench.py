"""Times the headline queries. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "clean_incidents", "closure_rate_by_cause", "value_profile", "duration_describe", "feature_groups",
    "feature_frame", "spatial_weights", "panel_features", "morans_i", "kde_surface", "time_split", "roc_auc",
    "average_precision", "concordance", "severity_thresholds", "recommend", "severity_weight_search", "tree_counts",
    "grid_search", "score_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from kerbline.plans import catalogue
    from kerbline.plans.fixture import Tables

    catalogue.QUERIES["clean_summary"](spark, sf_dir).collect()  # starts the session
    seconds = {}
    began = time.time()
    Tables(spark, sf_dir).clean_table.count()  # the table that most queries start from is written once
    seconds["write_clean_table"] = round(time.time() - began, 3)
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
