"""Row types shared by every operator.

``ts_ns`` (Unix nanoseconds, BIGINT) is the authoritative time; NULL means "no
time".  ``line_num`` is 0-based and unique inside a ``source_id``: together they
are the explicit order that a log has by nature and a DataFrame has not.
"""

from __future__ import annotations

from pyspark.sql import types as T

LINE = T.StructType([
    T.StructField("source_id", T.StringType(), False),
    T.StructField("source_type", T.StringType(), True),
    T.StructField("line_num", T.LongType(), False),
    T.StructField("ts_ns", T.LongType(), True),
    T.StructField("level", T.StringType(), True),
    T.StructField("level_ord", T.ByteType(), True),
    T.StructField("tag", T.StringType(), True),
    T.StructField("pid", T.IntegerType(), True),
    T.StructField("tid", T.IntegerType(), True),
    T.StructField("message", T.StringType(), True),
    T.StructField("raw", T.StringType(), True),
])

SECTION = T.StructType([
    T.StructField("source_id", T.StringType(), False),
    T.StructField("section_idx", T.IntegerType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("start_line", T.LongType(), False),
    T.StructField("end_line", T.LongType(), False),
    T.StructField("parent_index", T.IntegerType(), True),
])

ANNOTATION = T.StructType([
    T.StructField("source_id", T.StringType(), False),
    T.StructField("annotation_id", T.StringType(), True),
    T.StructField("label", T.StringType(), True),
    T.StructField("note", T.StringType(), True),
    T.StructField("start_line", T.LongType(), False),
    T.StructField("end_line", T.LongType(), True),
])

PII_MAP = T.StructType([
    T.StructField("raw", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("n", T.LongType(), False),
    T.StructField("token", T.StringType(), False),
])

LINE_COLUMNS = LINE.fieldNames()
