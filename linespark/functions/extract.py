"""Regex field extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .scalars import as_col

CASTS = {"int": "bigint", "float": "double", "string": "string", None: "string"}


def group_count(pattern: str) -> int:
    """Number of capture groups of a Java pattern."""
    try:
        return re.compile(pattern).groups
    except re.error:
        return len(re.findall(r"(?<!\\)\((?!\?(?!<[A-Za-z]))", pattern))


def never_empty(pattern: str) -> bool:
    """Whether the returned group (1, or the whole match) always holds a character when the pattern matches."""
    try:
        tree = re._parser.parse(pattern)
    except re.error:
        return False
    if not re.compile(pattern).groups:
        return tree.getwidth()[0] > 0

    def find(node):
        for op, arg in node:
            name = str(op)
            if name == "SUBPATTERN" and arg[0] == 1:
                return arg[3].getwidth()[0] > 0
            if name == "SUBPATTERN":
                inner = find(arg[3])
                if inner is not None:
                    return inner
        return None

    # A first group inside a repeat or an alternative may take no part, so it is not looked for there.
    return bool(find(tree))


def field(pattern: str, cast: str | None = None, column: Column | str = "message") -> Column:
    """Group 1 if the pattern has groups, else the whole match; NULL when nothing matches.

    ``cast`` is ``int``, ``float`` or ``string``; text that does not convert gives NULL.
    """
    c = as_col(column)
    got = F.regexp_extract(c, pattern, 1 if group_count(pattern) else 0)
    # Where an empty text can only mean "no match" one regex pass decides.
    found = F.nullif(got, F.lit("")) if never_empty(pattern) else F.when(got != "", got).when(c.rlike(pattern), got)
    return found if CASTS[cast] == "string" else found.try_cast(CASTS[cast])


MARK, SEP = "\x02", "\x01"


def all_groups(column: Column | str, pattern: str) -> Column:
    """All groups of a whole-text pattern in one regex pass: ``[MARK, group 1, group 2, ...]``.

    Put it in a column of its own and test it with :func:`matched`; text that does not match stays one piece.
    """
    n = group_count(pattern)
    packed = F.regexp_replace(as_col(column), pattern, SEP.join([MARK] + [f"${i}" for i in range(1, n + 1)]))
    return F.split(packed, SEP, n + 1)


def matched(groups: Column | str) -> Column:
    return F.coalesce(F.get(as_col(groups), F.lit(0)) == MARK, F.lit(False))


def extract_fields(df: DataFrame, fields: dict[str, str | tuple[str, str | None]], column: str = "message",
                   keep_raw: bool = False) -> DataFrame:
    """Add one column per ``{name: pattern}`` or ``{name: (pattern, cast)}``.

    ``keep_raw`` also adds ``<name>_raw`` with the text before the cast. The columns are generated, not aliased: a
    later filter on them cannot repeat the regexes, while filters on other columns still move below.
    """
    out = {}
    for name, spec in fields.items():
        pattern, cast = (spec, None) if isinstance(spec, str) else spec
        out[name] = field(pattern, cast, column)
        if keep_raw and CASTS[cast] != "string":
            out[f"{name}_raw"] = field(pattern, None, column)
    row = F.struct(*[c.alias(n) for n, c in out.items()])
    return df.select(*[c for c in df.columns if c not in out], F.inline(F.array(row)))


def capture(df: DataFrame, tag_re: str | None = None, msg_re: str | None = None, prefix: str = "cap_") -> DataFrame:
    """Keep lines matching both patterns and number the groups: tag groups first, then message groups."""
    out, n, cond = {}, 0, F.lit(True)
    for column, pattern in (("tag", tag_re), ("message", msg_re)):
        if pattern is None:
            continue
        cond = cond & F.col(column).rlike(pattern)
        for g in range(1, group_count(pattern) + 1):
            n += 1
            out[f"{prefix}{n}"] = F.regexp_extract(column, pattern, g)
    return df.filter(cond).withColumns(out)
