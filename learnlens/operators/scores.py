"""Daily and weekly score metrics (AGG7, AGG8, AGG15, AGG16, AGG21, CLS2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exactsum
from ..functions.scores import round_half_even, score_band
from ..functions.text import day_label
from ..functions.time import day_of, week_of
from ..sources.tables import Sources
from .calendar import aggregate_onto_grid, enrolled_weeks
from .daily import KEYS, scored_assignments, scored_quizzes

# --- Fixed values ----------------------------------------------------------
NO_SUBMISSIONS = "No submissions this week."
# --- end of fixed values ---------------------------------------------------

_TIME_COL = {"quiz": "finished_at_anonymous", "assignment": "submitted_at_anonymous"}


def _scored(src: Sources, kind: str) -> DataFrame:
    if kind == "quiz":
        return scored_quizzes(src)
    if kind == "assignment":
        return scored_assignments(src)
    raise ValueError(f"unknown submission kind {kind!r}")


def daily_scores(src: Sources, kind: str = "quiz", null_day: str = "zero_null") -> DataFrame:
    """Mean percent score per (user, course, day) with submissions.

    ``null_day="zero_null"`` (default, the extract's meaning): a missing
    score or missing/zero points counts as 0 before averaging.
    ``null_day="zero_day"`` (the live query's meaning): any such row makes
    the whole day 0.
    """
    if null_day not in ("zero_null", "zero_day"):
        raise ValueError(f"unknown null_day {null_day!r}")
    scored = _scored(src, kind).withColumn("day", day_of(_TIME_COL[kind]))
    pct = F.col("pct" if null_day == "zero_null" else "raw_pct")
    parts = exactsum.partial_sums(scored, KEYS, {"pct": pct}, {"n_submissions": F.lit(1).cast("bigint")})
    met = "collect_list(pct)"
    # A missing percent has no part, so fewer values than submissions show it.
    value = F.when(exactsum.count(met) < F.sum("n_submissions"), F.lit(0.0)).otherwise(exactsum.mean(met))
    daily = parts.groupBy(*KEYS).agg(value.alias("value"), F.sum("n_submissions").alias("n_submissions"))
    score = round_half_even("value", 1)
    return daily.select(
        "user_id", "course_id", week_of("day", src.term).alias("week"), "day",
        "value", "n_submissions", score.alias("score"), score_band(score).alias("band"),
        day_label("day").alias("day_label"))


def weekly_scores(src: Sources, kind: str = "quiz", null_day: str = "zero_null") -> DataFrame:
    """AGG15/AGG16/AGG21: per enrolled (user, course, week) the average, min
    and max of the non-zero daily means (1 dp) and their bands; weeks with no
    non-zero day carry ``has_submissions = false`` and the reference message.
    """
    daily = daily_scores(src, kind, null_day).filter(F.col("value") > 0) \
        .select("user_id", "course_id", "week", "value")
    grid = enrolled_weeks(src.enrollments, src.term)
    weekly = aggregate_onto_grid(grid, daily, ("user_id", "course_id", "week"), {
        # Seven days at most: their exact mean, so a tie at the rounding is one always.
        "avg_score": round_half_even(exactsum.mean_of("collect_list(value)"), 1),
        "min_score": round_half_even(F.min("value"), 1),
        "max_score": round_half_even(F.max("value"), 1),
        "scored_days": F.count("value"),
    })
    has = F.col("scored_days") > 0
    return weekly.select(
        "user_id", "course_id", "week", "avg_score", "min_score", "max_score",
        score_band("avg_score").alias("avg_band"),
        score_band("min_score").alias("min_band"),
        score_band("max_score").alias("max_band"),
        has.alias("has_submissions"),
        F.when(~has, F.lit(NO_SUBMISSIONS)).alias("message"))
