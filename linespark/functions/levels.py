"""Severity levels as an ordered scale (Verbose 0 .. Fatal 5)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Level names in rank order, and the spellings accepted for each.
LEVELS = ("Verbose", "Debug", "Info", "Warn", "Error", "Fatal")
SPELLINGS = {
    "V": 0, "VERBOSE": 0,
    "D": 1, "DEBUG": 1,
    "I": 2, "INFO": 2,
    "W": 3, "WARN": 3, "WARNING": 3,
    "E": 4, "ERROR": 4,
    "F": 5, "FATAL": 5,
    "A": 5, "ASSERT": 5,
}


def level_rank(name: str, default: int | None = 0) -> int | None:
    """Rank of a level given as a plan-time argument."""
    return SPELLINGS.get(name.strip().upper(), default)


def level_ord(col: Column | str, default: int | None = 1) -> Column:
    """Rank of a level column; unknown text gets ``default`` (Debug)."""
    key = F.upper(F.trim(F.col(col) if isinstance(col, str) else col))
    table = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    rank = F.try_element_at(table, key)
    if default is not None:
        rank = F.coalesce(rank, F.lit(default))
    return rank.cast("tinyint")


def level_name(ord_col: Column | str) -> Column:
    """Long level name of a rank column."""
    c = F.col(ord_col) if isinstance(ord_col, str) else ord_col
    return F.try_element_at(F.array(*[F.lit(n) for n in LEVELS]), c.cast("int") + 1)
