"""Weekly summary card (AGG10, AGG14, CLS1) — the flagship query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Term
from ..functions import exactsum
from ..functions.rules import engagement
from ..functions.scores import bit, measure, round_half_even
from ..functions.time import day_of, week_of
from ..sources.tables import Sources
from .calendar import aggregate_onto_grid, enrolled_weeks
from .daily import total_or_zero

WEEK_KEYS = ("user_id", "course_id", "week")


def _weeks(ts: str, src: Sources, inclusive_end: bool) -> Column:
    """Week(s) an event counts for. With ``inclusive_end`` an event at exactly
    next Monday 00:00:00 also counts for the week before, as the reference's
    closed ``BETWEEN`` window does (semantics N1)."""
    week = week_of(ts, src.term)
    if not inclusive_end:
        return F.array(week)
    at_boundary = F.date_trunc("day", F.col(ts)) == F.col(ts)
    on_week_edge = at_boundary & (F.pmod(F.datediff(F.col(ts).cast("date"), F.lit(src.term.start)), F.lit(7)) == 0)
    return F.when(on_week_edge & (week > 1), F.array(week, week - 1)).otherwise(F.array(week))


def quiz_parts(src: Sources, inclusive_end: bool = False) -> DataFrame:
    """Exact partial sums of quiz minutes per (user, course, week)."""
    quiz = src.quiz_submissions_in_term().select(
        "user_id", "course_id",
        F.explode(_weeks("finished_at_anonymous", src, inclusive_end)).alias("week"), "DurationInMinutes")
    return exactsum.partial_sums(quiz, WEEK_KEYS, {"minutes": measure("DurationInMinutes")})


def weekly_summary(src: Sources, mean: str = "active", inclusive_end: bool = False,
                   daily_web: DataFrame | None = None) -> DataFrame:
    """Per enrolled (user, course, week): interactions, session minutes (2 per
    interaction), active days, mean daily interactions (1 dp), quiz minutes,
    study and quiz hours (1 dp) and the engagement level.

    ``mean="active"`` divides by days with activity (the live query);
    ``mean="calendar"`` divides by all seven days (the extract).
    ``daily_web`` (a :func:`learnlens.operators.daily.daily_web_activity`
    mart already written) replaces the click log as input, so a refresh job
    reads the click log once; closed weeks need event times, not day rows.
    """
    # Day of the week as one bit (0..6, or 7 for an end-inclusive Monday):
    # active days = set bits of bit_or over the week; no distinct aggregate.
    day_index = (F.datediff("day", F.lit(src.term.start)) - (F.col("week") - 1) * 7).cast("int")
    if daily_web is None:
        logs = src.web_logs_in_term().select(
            "user_id", "course_id", F.explode(_weeks("timestamp", src, inclusive_end)).alias("week"),
            day_of("timestamp").alias("day"), F.lit(1).cast("bigint").alias("_n"))
    elif inclusive_end:
        raise ValueError("inclusive_end needs event times: pass the click log, not a daily mart")
    else:
        logs = daily_web.select("user_id", "course_id", week_of("day", src.term).alias("week"),
                                "day", F.col("interactions").alias("_n"))
    web = logs.select("user_id", "course_id", "week", bit(day_index).alias("day_bit"), "_n")
    facts = web.unionByName(quiz_parts(src, inclusive_end), allowMissingColumns=True)
    weekly = aggregate_onto_grid(enrolled_weeks(src.enrollments, src.term), facts, WEEK_KEYS, {
        "total_interactions": F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint"),
        "active_days": F.coalesce(F.bit_count(F.bit_or("day_bit")), F.lit(0)),
        "quiz_minutes": total_or_zero("minutes"),
    })
    return card(weekly, src.term, mean)


def card(weekly: DataFrame, term: Term, mean: str = "active") -> DataFrame:
    """The summary card of (total_interactions, active_days, quiz_minutes) per week."""
    total = F.col("total_interactions")
    days = F.col("active_days")
    if mean == "active":
        avg = F.when(days > 0, round_half_even(total / days, 1)).otherwise(F.lit(0.0))
    elif mean == "calendar":
        avg = round_half_even(total / F.lit(7.0), 1)
    else:
        raise ValueError(f"unknown mean {mean!r}")
    minutes = total * F.lit(term.minutes_per_interaction)
    return weekly.select(
        "user_id", "course_id", "week", "total_interactions",
        minutes.cast("bigint").alias("session_minutes"),
        days.cast("bigint").alias("active_days"),
        avg.alias("avg_daily_interactions"),
        "quiz_minutes",
        round_half_even(minutes / F.lit(60.0), 1).alias("study_hours"),
        round_half_even(F.col("quiz_minutes") / F.lit(60.0), 1).alias("quiz_hours"),
        engagement(days).alias("engagement"),
    )


def weekly_quiz_minutes(src: Sources, inclusive_end: bool = False) -> DataFrame:
    """AGG10: total quiz minutes per (user, course, week) with quiz rows."""
    return quiz_parts(src, inclusive_end).groupBy(*WEEK_KEYS).agg(total_or_zero("minutes").alias("quiz_minutes"))
