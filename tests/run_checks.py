"""Check all (or the named) registered queries on one scale: ``python tests/run_checks.py SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.compare import compare, connect  # noqa: E402


def main() -> None:
    sf, names = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(sf), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf)
            note = compare(df, con, sql[name]) if name in sql else f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            note = "ERROR " + "".join(traceback.format_exception_only(e))[:1500]
        ok = note is None or note.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name} {time.time() - start:.2f}s {note or ''}", flush=True)
    print(f"{bad} bad of {len(names or queries)}")


if __name__ == "__main__":
    main()
