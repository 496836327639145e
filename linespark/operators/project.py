"""Row rewrite and projection operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import as_col, render_template


def replace_field(df: DataFrame, field: str, regex: str, repl: str) -> DataFrame:
    return df.withColumn(field, F.regexp_replace(field, regex, repl))


def set_field(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def drop_field(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def add_field(df: DataFrame, name: str, expr: Column | str = "") -> DataFrame:
    """Fill a field where it is absent."""
    value = expr if isinstance(expr, Column) else F.lit(expr)
    return df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)


def with_fields(df: DataFrame, **exprs: Column) -> DataFrame:
    return df.withColumns(exprs)


def filter_lines(df: DataFrame, *rules: Column) -> DataFrame:
    """Keep lines passing every rule."""
    for r in rules:
        df = df.filter(r)
    return df


def emit(df: DataFrame, **exprs: Column) -> DataFrame:
    """Typed result rows: source, line number, time (unless given as ``ts_ns``), then the fields."""
    ts = exprs.pop("ts_ns", F.col("ts_ns"))
    return df.select("source_id", "line_num", ts.alias("ts_ns"), *[c.alias(n) for n, c in exprs.items()])


def emit_many(df: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """Several result rows per line; a row whose struct is NULL (via ``when``) is left out."""
    items = F.array(*[F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows])
    return df.select("source_id", "line_num", "ts_ns", F.inline(items))


def table_view(df: DataFrame, columns: list[str], sort: str | None = None, descending: bool = False) -> DataFrame:
    out = df.select(*columns)
    if sort:
        out = out.orderBy(F.desc(sort) if descending else F.asc(sort))
    return out


def rendered(df: DataFrame, template: str, name: str = "text") -> DataFrame:
    """Fill a ``{{key}}`` template from the row's own columns."""
    return df.withColumn(name, render_template(template, {c: F.col(c) for c in df.columns}))


SPAN = "array<struct<start:int,end:int>>"


def highlight_spans(df: DataFrame, text: str, is_regex: bool = False, case_sensitive: bool = False,
                    column: str = "raw", name: str = "spans") -> DataFrame:
    """Character offsets ``[start, end)`` of every non-overlapping hit of a search term.

    The text is split at the hits: the lengths of the pieces between them and of the hits add up to the
    offsets. Empty hits of a regex are left out.
    """
    c = F.col(column)
    empty = F.array().cast(SPAN)
    if not text:
        return df.withColumn(name, empty)
    if not is_regex:
        quoted = "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        pattern = quoted if case_sensitive else f"(?iu){quoted}"
        pieces = F.transform(F.split(c, pattern), F.length)
        n = len(text)
        ends = F.aggregate(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
                           F.struct(F.lit(0).alias("at"), empty.alias("out")),
                           lambda a, p: F.struct(
                               (a.at + p + n).alias("at"),
                               F.concat(a.out, F.array(F.struct((a.at + p).alias("start"), (a.at + p + n).alias("end"))))
                               .alias("out")),
                           lambda a: a.out)
        return df.withColumn(name, F.when(c.isNotNull(), ends).otherwise(empty))

    pattern = ("" if case_sensitive else "(?i)") + text
    gaps = F.transform(F.split(c, pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), F.length)
    # An empty hit at the start of the text makes no piece.
    hits = F.slice(hits, 1 + F.size(hits) - (F.size(gaps) - 1), F.size(gaps) - 1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")),
                        lambda a, s: F.struct((a.at + s.gap + s.hit).alias("at"), F.concat(a.out, F.array(F.struct(
                            (a.at + s.gap).alias("start"), (a.at + s.gap + s.hit).alias("end")))).alias("out")),
                        lambda a: F.filter(a.out, lambda s: s.end > s.start))
    return df.withColumn(name, F.when(c.rlike(pattern), found).otherwise(empty))


def row_errors(df: DataFrame, exprs: dict[str, Column], keys=("source_id",)) -> DataFrame:
    """Rows whose expression gave NULL from non-NULL input, counted, with the first such line.

    ``exprs`` maps a name to a ``try_*`` expression over columns known to be present.
    """
    parts = []
    for name, e in exprs.items():
        failed = e.isNull()
        parts += [F.count_if(failed).alias(f"{name}_errors"), F.min(F.when(failed, F.col("line_num"))).alias(f"{name}_first_line")]
    return df.groupBy(*keys).agg(F.count("*").alias("matched"), *parts)


def map_lines(df: DataFrame, fn, schema) -> DataFrame:
    """Escape hatch: ``fn`` gets and yields pandas frames, partition by partition."""
    return df.mapInPandas(fn, schema)


def fold_lines(df: DataFrame, keys: list[str], fn, schema, order=("line_num",)) -> DataFrame:
    """Escape hatch: ``fn(pandas_frame)`` per key with rows in order. Keys must be fine-grained:
    each group is held by one task."""
    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values(list(order), kind="stable"))
    return df.groupBy(*keys).applyInPandas(ordered, schema)
