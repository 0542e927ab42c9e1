"""Seconds of the headline queries over the tables in $BENCH_SF_DIR, as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from clonalis.plans import catalogue

HEADLINE = [
    "reads_derived", "molecules_consensus", "low_complexity", "kmer_index", "similar_pairs", "correction_map_global", "molecules_corrected", "correction_per_cell",
    "cells_ordered", "filter_10x", "filter_visium", "precluster_nodes", "jaccard_edges", "components", "component_density", "bridges_loose", "cut_vertices", "doublets",
    "clones", "clone_details", "clone_size_histogram", "top6_per_cell", "qc_quantiles", "jaccard_pairs", "hamming_histogram",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    catalogue.QUERIES["reads_derived"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the session
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs):
            start = time.time()
            catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        seconds[name] = round(statistics.median(took), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
