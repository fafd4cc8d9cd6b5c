"""Daily activity metrics (AGG2-AGG6, AGG9, AGG11) and the scored
submission facts behind AGG7/AGG8.

Every daily metric is computed for all enrolled (user, course) pairs and
all grid days in one job; the one-student, one-week chart of the reference
is a filter on the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exactsum
from ..functions.scores import measure, percent_score
from ..functions.time import day_of, week_of
from ..sources.tables import Sources
from .calendar import aggregate_onto_grid, enrolled_days, enrolled_weeks
from .joins import lookup_join

KEYS = ("user_id", "course_id", "day")


# ------------------------------------------------------------------ fact rows
def web_facts(src: Sources) -> DataFrame:
    """Web-log rows in the term: (user_id, course_id, day, attachment_id)."""
    return src.web_logs_in_term().select(
        "user_id", "course_id", day_of("timestamp").alias("day"), "attachment_id")


def scored_quizzes(src: Sources) -> DataFrame:
    """JOI1 + PRJ3: quiz submissions in the term with their points and percent."""
    subs = src.quiz_submissions_in_term()
    joined = lookup_join(subs, src.quizzes, "quiz_id", "id")
    return joined.withColumn("pct", percent_score()) \
                 .withColumn("raw_pct", F.try_divide(F.col("score_anonymous"), F.col("points_possible")) * F.lit(100.0))


def scored_assignments(src: Sources) -> DataFrame:
    """JOI2 + PRJ3: assignment submissions in the term with points and percent."""
    subs = src.submissions_in_term()
    joined = lookup_join(subs, src.assignments, "assignment_id", "id")
    return joined.withColumn("pct", percent_score()) \
                 .withColumn("raw_pct", F.try_divide(F.col("score_anonymous"), F.col("points_possible")) * F.lit(100.0))


def quiz_facts(src: Sources) -> DataFrame:
    return src.quiz_submissions_in_term().select(
        "user_id", "course_id", day_of("finished_at_anonymous").alias("day"))


def assignment_facts(src: Sources) -> DataFrame:
    return src.submissions_in_term().select(
        "user_id", "course_id", day_of("submitted_at_anonymous").alias("day"))


def quiz_parts(src: Sources) -> DataFrame:
    """Per (user, course, day) the exact partial sums of quiz percents and minutes
    and the number of submissions (a few rows a day at most)."""
    rows = scored_quizzes(src).withColumn("day", day_of("finished_at_anonymous"))
    return exactsum.partial_sums(rows, KEYS, {"quiz_pct": F.col("pct"), "minutes": measure("DurationInMinutes")},
                                 {"_quiz": F.lit(1).cast("bigint")})


def assignment_parts(src: Sources) -> DataFrame:
    """Per (user, course, day) the exact partial sums of assignment percents and the
    number of submissions."""
    rows = scored_assignments(src).withColumn("day", day_of("submitted_at_anonymous"))
    return exactsum.partial_sums(rows, KEYS, {"assignment_pct": F.col("pct")}, {"_asg": F.lit(1).cast("bigint")})


def mean_or_zero(parts: str) -> Column:
    """Mean over partial sums that meet in one group; 0 without any."""
    return F.coalesce(exactsum.mean(f"collect_list({parts})"), F.lit(0.0))


def total_or_zero(parts: str) -> Column:
    return F.coalesce(exactsum.total(f"collect_list({parts})"), F.lit(0.0))


# ------------------------------------------------------- metric definitions
@dataclass(frozen=True)
class DailyMetric:
    """One chartable daily metric: its fact rows and its aggregate."""

    name: str
    facts: Callable[[Sources], DataFrame]
    value: Callable[[Sources], Column]
    dtype: str


def _count(src: Sources) -> Column:
    return F.count(F.col("_fact"))


def _minutes(src: Sources) -> Column:
    return F.count(F.col("_fact")) * F.lit(src.term.minutes_per_interaction)


DAILY_METRICS: dict[str, DailyMetric] = {
    "daily_interactions": DailyMetric("daily_interactions", web_facts, _count, "bigint"),
    "active_study_time": DailyMetric("active_study_time", web_facts, _minutes, "bigint"),
    "file_accesses": DailyMetric(
        "file_accesses", lambda s: web_facts(s).filter(F.col("attachment_id").isNotNull()),
        _count, "bigint"),
    "unique_files": DailyMetric(
        "unique_files", lambda s: web_facts(s).filter(F.col("attachment_id").isNotNull()),
        lambda s: F.count_distinct(F.col("attachment_id")), "bigint"),
    "quiz_submissions": DailyMetric("quiz_submissions", quiz_facts, _count, "bigint"),
    "assignment_submissions": DailyMetric("assignment_submissions", assignment_facts, _count, "bigint"),
    "quiz_score": DailyMetric(
        "quiz_score", quiz_parts, lambda s: mean_or_zero("quiz_pct"), "double"),
    "assignment_score": DailyMetric(
        "assignment_score", assignment_parts, lambda s: mean_or_zero("assignment_pct"), "double"),
    "quiz_minutes": DailyMetric(
        "quiz_minutes", quiz_parts, lambda s: total_or_zero("minutes"), "double"),
}


def daily_metric(src: Sources, name: str) -> DataFrame:
    """JOI3 over one metric: (user_id, course_id, week, day, value), every
    enrolled pair x every grid day, 0 where nothing happened."""
    m = DAILY_METRICS[name]
    facts = m.facts(src).withColumn("_fact", F.lit(1))
    filled = aggregate_onto_grid(enrolled_days(src.enrollments, src.term), facts, KEYS,
                                 {"value": m.value(src).cast(m.dtype)})
    return filled.select("user_id", "course_id", week_of("day", src.term).alias("week"),
                         "day", "value")


def daily_metrics_wide(src: Sources, daily_web: DataFrame | None = None) -> DataFrame:
    """All nine daily metrics in one row per (user, course, day).

    Clicks are brought to days first, the only distinct aggregate, and submissions to
    exact partial sums; then they and the grid are unioned and aggregated once. ``daily_web``
    (a written :func:`daily_web_activity` mart) replaces the click log as input.
    """
    daily_web = daily_web_activity(src) if daily_web is None else daily_web
    web = daily_web.select("user_id", "course_id", "day", F.col("interactions").alias("_n"),
                           F.col("file_accesses").alias("_fa"), F.col("unique_files").alias("_uf"))
    facts = web.unionByName(quiz_parts(src), allowMissingColumns=True) \
               .unionByName(assignment_parts(src), allowMissingColumns=True)
    per = src.term.minutes_per_interaction
    filled = aggregate_onto_grid(enrolled_days(src.enrollments, src.term), facts, KEYS, {
        "daily_interactions": F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint"),
        "active_study_time": (F.coalesce(F.sum("_n"), F.lit(0)) * F.lit(per)).cast("bigint"),
        "file_accesses": F.coalesce(F.sum("_fa"), F.lit(0)).cast("bigint"),
        "unique_files": F.coalesce(F.sum("_uf"), F.lit(0)).cast("bigint"),
        "quiz_submissions": F.coalesce(F.sum("_quiz"), F.lit(0)).cast("bigint"),
        "quiz_score": mean_or_zero("quiz_pct"),
        "quiz_minutes": total_or_zero("minutes"),
        "assignment_submissions": F.coalesce(F.sum("_asg"), F.lit(0)).cast("bigint"),
        "assignment_score": mean_or_zero("assignment_pct"),
    })
    return filled.withColumn("week", week_of("day", src.term)) \
                 .select("user_id", "course_id", "week", "day", *DAILY_METRICS)


def daily_web_activity(src: Sources) -> DataFrame:
    """AGG2 + AGG3 in one pass: per (user, course, day) interactions, first and
    last event, file accesses and distinct files (days with activity only)."""
    logs = src.web_logs_in_term()
    daily = logs.groupBy("user_id", "course_id", day_of("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("interactions"),
        F.min("timestamp").alias("first_activity"),
        F.max("timestamp").alias("last_activity"),
        F.count("attachment_id").alias("file_accesses"),
        F.count_distinct("attachment_id").alias("unique_files"),
    )
    return daily.select("user_id", "course_id", week_of("day", src.term).alias("week"), "day",
                        "interactions", "first_activity", "last_activity",
                        "file_accesses", "unique_files")


def no_activity_weeks(src: Sources) -> DataFrame:
    """AGG17: per (user, course, week, metric) whether all seven days are 0
    ("No activity this week").

    Counts are 0 in a week exactly if it has no such row, so clicks need no
    distinct count; score means and minutes are taken by day and then tested.
    """
    yes = F.lit(True)
    web = web_facts(src).select("user_id", "course_id", week_of("day", src.term).alias("week"), yes.alias("click"),
                                F.col("attachment_id").isNotNull().alias("file"))
    quiz = quiz_parts(src).groupBy(*KEYS).agg(mean_or_zero("quiz_pct").alias("mean"), total_or_zero("minutes").alias("minutes")).select(
        "user_id", "course_id", week_of("day", src.term).alias("week"), yes.alias("quiz"),
        (F.col("mean") != 0).alias("quiz_scored"), (F.col("minutes") != 0).alias("timed"))
    done = assignment_parts(src).groupBy(*KEYS).agg(mean_or_zero("assignment_pct").alias("mean")).select(
        "user_id", "course_id", week_of("day", src.term).alias("week"), yes.alias("assignment"),
        (F.col("mean") != 0).alias("assignment_scored"))
    facts = web.unionByName(quiz, allowMissingColumns=True).unionByName(done, allowMissingColumns=True)
    seen = {"daily_interactions": "click", "active_study_time": "click", "file_accesses": "file", "unique_files": "file",
            "quiz_submissions": "quiz", "assignment_submissions": "assignment", "quiz_score": "quiz_scored",
            "assignment_score": "assignment_scored", "quiz_minutes": "timed"}
    weekly = aggregate_onto_grid(enrolled_weeks(src.enrollments, src.term), facts, ("user_id", "course_id", "week"), {
        n: ~F.coalesce(F.bool_or(c), F.lit(False)) for n, c in seen.items()})
    names = list(DAILY_METRICS)
    stack = ", ".join(f"'{n}', `{n}`" for n in names)
    return weekly.select("user_id", "course_id", "week",
                         F.expr(f"stack({len(names)}, {stack}) AS (metric, no_activity)"))
