"""Calendar projections (PRJ1, PRJ2, PRJ4, PRJ5, PRJ6) and the term / week
filters (FIL2, FIL3, FIL8) as plain column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Term


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_literal(df: DataFrame, column: str, value: datetime) -> Column:
    """A literal of the same timestamp type as ``df[column]``.

    Comparing a TIMESTAMP_NTZ column with a TIMESTAMP literal would wrap the
    column in a cast and stop the filter from reaching the Parquet scan, so
    the literal takes the column's own type.
    """
    dtype = df.schema[column].dataType
    text = value.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"TIMESTAMP_NTZ '{text}'")
    if isinstance(dtype, T.DateType):
        return F.lit(value.date())
    return F.expr(f"TIMESTAMP '{text}'")


def in_window(df: DataFrame, column: str, start: datetime, end: datetime,
              inclusive_end: bool = False) -> DataFrame:
    """Half-open ``[start, end)`` (FIL2/FIL8) or closed ``BETWEEN`` (FIL3)."""
    lo = ts_literal(df, column, start)
    hi = ts_literal(df, column, end)
    c = F.col(column)
    return df.filter((c >= lo) & ((c <= hi) if inclusive_end else (c < hi)))


def in_term(df: DataFrame, column: str, term: Term) -> DataFrame:
    """FIL2: the extract window, pushed to the scan."""
    return in_window(df, column, term.start_ts, term.end_ts)


def day_of(ts: Column | str) -> Column:
    """PRJ1: event time -> calendar day."""
    return _as_col(ts).cast("date")


def week_of(day_or_ts: Column | str, term: Term) -> Column:
    """PRJ2: week number counted from the term start (week 1), as BIGINT.

    Inside the term this equals ``floor(extract(day from ts - start) / 7) + 1``.
    """
    days = F.datediff(_as_col(day_or_ts).cast("date"), F.lit(term.start))
    return (F.floor(days / F.lit(7)) + F.lit(1)).cast("bigint")


def display_week(week: Column | str, term: Term) -> Column:
    """PRJ4: a week clamped to the selectable range 1..max_week."""
    return F.least(F.greatest(_as_col(week), F.lit(1)), F.lit(term.max_week)).cast("bigint")


def block_start(week: Column | str) -> Column:
    """PRJ5: first week of the two-week block holding ``week``."""
    w = _as_col(week)
    return (F.floor((w - F.lit(1)) / F.lit(2)) * F.lit(2) + F.lit(1)).cast("bigint")


def week_start_date(week: Column | str, term: Term) -> Column:
    """PRJ6: first day (Monday for the reference term) of a week."""
    return F.date_add(F.lit(term.start), ((_as_col(week) - F.lit(1)) * F.lit(7)).cast("int"))


def week_end_date(week: Column | str, term: Term) -> Column:
    return F.date_add(week_start_date(week, term), 6)


def term_days(term: Term) -> Column:
    """All grid days of the term as an array (used with ``explode``)."""
    return F.sequence(F.lit(term.start), F.lit(term.last_day))
