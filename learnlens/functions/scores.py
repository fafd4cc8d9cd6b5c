"""PRJ3 percent score and CLS2 score band."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: score band cut-offs (percent) ---------------------------
LOW_BELOW = 60
MIDDLE_BELOW = 80
# --- end of fixed values ---------------------------------------------------


def percent_score(score: Column | str = "score_anonymous",
                  points: Column | str = "points_possible") -> Column:
    """``score / points * 100``; a null score, null points or zero points give 0.

    ``try_divide`` returns null on a zero divisor where ANSI ``/`` would fail.
    """
    s = F.col(score) if isinstance(score, str) else score
    p = F.col(points) if isinstance(points, str) else points
    return F.coalesce(F.try_divide(s, p) * F.lit(100.0), F.lit(0.0))


def score_band(value: Column | str) -> Column:
    """CLS2: ``low`` below 60, ``middle`` below 80, else ``high``."""
    v = F.col(value) if isinstance(value, str) else value
    return (F.when(v < LOW_BELOW, "low").when(v < MIDDLE_BELOW, "middle")
            .when(v.isNotNull(), "high"))


def round_half_even(value: Column | str, digits: int) -> Column:
    """R's ``round`` rounds halves to even; Spark's ``bround`` does the same."""
    v = F.col(value) if isinstance(value, str) else value
    return F.bround(v, digits)


def bit(position: Column | str) -> Column:
    """``1 << position`` as BIGINT, for bit-mask aggregates over small domains."""
    p = F.col(position) if isinstance(position, str) else position
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), p.cast("int"))


def has_bit(mask: Column | str, position: Column | str) -> Column:
    m = F.col(mask) if isinstance(mask, str) else mask
    return m.bitwiseAND(bit(position)) != 0


def measure(value: Column | str) -> Column:
    """A DOUBLE measure (e.g. minutes) to add up; NaN counts as missing."""
    v = F.col(value) if isinstance(value, str) else value
    return F.nanvl(v, F.lit(None).cast("double"))
