"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def days(n: Column) -> Column:
    return F.make_dt_interval(days=n.cast("int"))


def months(n: Column) -> Column:
    return F.make_ym_interval(F.lit(0), n.cast("int"))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour days between two timestamps (not calendar boundaries)."""
    return F.timestamp_diff("DAY", start, end)


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Read a control table to the driver, refusing one that is not small."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it is meant to be a small control table")
    return rows
