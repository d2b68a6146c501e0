"""Prints one JSON line: seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], median of warm runs.

``planning_statistics`` and ``first_planning`` are what a query costs once, before it runs: statistics and key checks.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINE = ["scan_sum", "filter_range", "hash_join", "merge_join", "residual_filter", "star_4way", "star_filtered", "chain_4way", "chain_factorized", "many_to_many_naive", "many_to_many_factorized", "multiway_naive", "multiway_factorized", "fk_elimination", "aggregate_index"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.scheduler.mode", "FAIR").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from tallyloom import queries as engine
    from tallyloom.session import BatchSession

    found = engine.queries()
    seconds, planning = {}, {}
    begin = time.perf_counter()
    known = engine.catalog(spark, folder)
    for number in range(7):  # the relations of the queries below
        known.statistics(number)
    seconds["planning_statistics"] = round(time.perf_counter() - begin, 4)
    for name in HEADLINE:
        begin = time.perf_counter()
        found[name](spark, folder)  # plans, with the statistics and key checks that it needs
        first = time.perf_counter() - begin
        runs = []
        for _ in range(5):
            begin = time.perf_counter()
            found[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(runs), 4)
        planning[name] = round(first, 4)
    batch = [engine.TEXTS[n][0] for n in HEADLINE if n in engine.TEXTS]
    for label, parallel in (("batch_sequential", 1), ("batch_concurrent", 8)):
        session = BatchSession(spark, known, parallel=parallel)
        runs = []
        for _ in range(3):
            begin = time.perf_counter()
            session.batch(batch)
            runs.append(time.perf_counter() - begin)
        seconds[label] = round(statistics.median(runs), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "first_planning": planning, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
