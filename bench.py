"""Headline queries on one machine: prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8) and ``BENCH_RUNS`` (default 3 timed runs after
one warm-up; the median counts). Every query writes its whole result to a sink that drops it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from queries import QUERIES  # noqa: E402

HEADLINE = ["flagship", "search", "count_by_time_grouped", "summarize", "with_section", "with_context", "burst_detect", "track_state", "state_at",
            "correlate", "carry_forward", "pair_events", "group_traces", "timeline_index", "lttb", "parse_logcat", "detect_pii", "mask_text", "dns_queries",
            "stream_track"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("linespark-bench").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({"metric": "total median seconds over headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf).name}))
    spark.stop()


if __name__ == "__main__":
    main()
