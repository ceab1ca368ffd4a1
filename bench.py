"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1); BENCH_CPUS: threads (default 8); BENCH_RUNS: warm runs of
which the median counts (default 3). Each run computes the whole result without writing it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from foliant.plans.queries import QUERIES

HEADLINE = (
    "top_keywords",
    "corpus_frequencies",
    "match_corpus",
    "page_job_text",
    "render_letter",
    "insert_markers",
    "move_fields",
    "stream_field_state",
    "stream_insert_markers",
)


def session(cpus: str) -> SparkSession:
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.files.maxPartitionBytes": "2m",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(median(took[1:]), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
