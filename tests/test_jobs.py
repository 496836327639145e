from __future__ import annotations

from pyspark.sql import functions as F

from linespark.operators.project import highlight_spans
from linespark.plans.base import Job
from linespark.plans.catalog import JOBS, run_job, run_pack
from tests import folds


def lines(spark):
    texts = [("AndroidRuntime", f"Process: com.app{i % 2}, PID: {i}") for i in range(12)]
    x = folds.lines(spark, [("s", i, i * 10**9, tag, text) for i, (tag, text) in enumerate(texts)])
    return x.withColumn("level", F.lit("Error")) if "level" in x.columns else x


def test_running_a_job_starts_no_spark_job(spark):
    x = lines(spark)
    sc = spark.sparkContext
    sc.setJobGroup("declared", "jobs and packs")
    try:
        for name in ("battery-events", "dns-query-events", "radio-data-call-reporter"):
            assert isinstance(JOBS[name], Job) and JOBS[name].charts
            run_job(name, x)
        run_pack("stability-monitor", x)
        assert list(sc.statusTracker().getJobIdsForGroup("declared")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_storm_signals_come_from_bursts(spark):
    job = JOBS["crash-storm-detector"]
    got = job.insights(job.analyse(lines(spark))).select("name", "severity", "message").distinct().collect()
    assert {(r.name, r.severity) for r in got} == {("crash_storm", "critical")}
    assert "crash_storm: burst_key=com.app0, count_in_window=3, window_ms=10000" in {r.message for r in got}


def test_regex_spans(spark):
    df = spark.createDataFrame([("a1b22",), ("xyz",), (None,), ("",), ("7",)], "raw string")
    spans = lambda p: [[(s.start, s.end) for s in r.spans] for r in highlight_spans(df, p, True).collect()]
    assert spans(r"\d+") == [[(1, 2), (3, 5)], [], [], [], [(0, 1)]]
    assert spans(r"\d*") == spans(r"\d+")
    assert spans(r"(?<n>\d)") == [[(1, 2), (3, 4), (4, 5)], [], [], [], [(0, 1)]]
