"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Arguments, if
any, name the queries to run; ``all`` runs every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "spq_curve", "effort_proportions", "merge_surveys", "subsample_detection", "size_stratified_expansion",
    "combined_expansion", "zero_filled_panel", "bootstrap_draws", "bootstrap_poisson", "bootstrap_quotient", "bootstrap_ci",
    "permutation_quotient_ci", "logistic_cdf_predict", "niche_width", "quantile_by_group", "left_join_station",
    "station_season_effort", "station_species_tally", "survey_points_by_season",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from habitatq.catalog import queries as catalog

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("habitatq-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.as_callables()
    wanted = sys.argv[1:] or HEADLINE
    wanted = list(known) if wanted == ["all"] else wanted
    known["effort_proportions"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the session
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
