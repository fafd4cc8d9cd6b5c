"""JOI3 calendar fill and the enrolment grids.

The reference left-joins a 7-day calendar to each daily metric and turns
missing days into 0. Set-based, we fill every (user, course, day) of the
term at once. Instead of building the grid and joining it to the metric
(two shuffles plus a sort-merge join), grid rows and fact rows are unioned
and aggregated together: one shuffle, map-side partial aggregation (which
also absorbs hot keys), and a HAVING that keeps exactly the grid's keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Term
from ..functions.time import term_days

_GRID = "_in_grid"


def enrolled_days(enrollments: DataFrame, term: Term) -> DataFrame:
    """(user_id, course_id, day) for every enrolled pair and grid day.

    Built by ``explode(sequence(...))`` on the enrolment rows: the grid grows
    with enrolments x days and is never a users x courses product.
    """
    return enrollments.select("user_id", "course_id", F.explode(term_days(term)).alias("day"))


def enrolled_weeks(enrollments: DataFrame, term: Term, last_week: int | None = None) -> DataFrame:
    """(user_id, course_id, week) for weeks 1..last_week (default: grid weeks)."""
    n = term.weeks if last_week is None else last_week
    return enrollments.select(
        "user_id", "course_id",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))).alias("week"))


def aggregate_onto_grid(grid: DataFrame, facts: DataFrame, keys: Sequence[str],
                        aggregations: Mapping[str, Column]) -> DataFrame:
    """Aggregate ``facts`` per ``keys`` and return exactly one row per grid key.

    Fact rows whose key is not in the grid are dropped; grid keys without
    facts get the aggregates' empty value (count 0, sum/avg/min/max null).
    Aggregations must ignore the grid rows, i.e. read only fact columns,
    which are null on grid rows.
    """
    g = grid.select(*keys).withColumn(_GRID, F.lit(True))
    f = facts.withColumn(_GRID, F.lit(None).cast("boolean"))
    both = g.unionByName(f, allowMissingColumns=True)
    aggs = [F.bool_or(_GRID).alias(_GRID)] + [c.alias(n) for n, c in aggregations.items()]
    return both.groupBy(*keys).agg(*aggs).filter(F.col(_GRID)).drop(_GRID)
