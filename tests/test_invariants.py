"""
to the unfilled totals, marts agree with each other, grids have fixed shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF001
from learnlens.operators import daily, progress, reflections, scores, summary
from learnlens.plans.queries import sources


def test_calendar_sums_equal_unfilled_totals(spark):
    src = sources(spark, SF001)
    wide = daily.daily_metrics_wide(src)
    mart = daily.daily_web_activity(src)
    totals = wide.agg(*[F.sum(c).alias(c) for c in ("daily_interactions", "file_accesses",
                                                    "unique_files", "quiz_submissions",
                                                    "assignment_submissions")]).first()
    m = mart.agg(F.sum("interactions"), F.sum("file_accesses"), F.sum("unique_files")).first()
    assert totals.daily_interactions == m[0] == src.web_logs_in_term().count()
    assert totals.file_accesses == m[1] and totals.unique_files == m[2]
    assert totals.quiz_submissions == src.quiz_submissions_in_term().count()
    assert totals.assignment_submissions == src.submissions_in_term().count()
    assert wide.filter(F.col("unique_files") > F.col("file_accesses")).count() == 0


def test_weekly_summary_agrees_with_daily_mart(spark):
    src = sources(spark, SF001)
    weekly = summary.weekly_summary(src)
    from_days = daily.daily_web_activity(src).groupBy("user_id", "course_id", "week").agg(
        F.sum("interactions").alias("t"), F.count(F.lit(1)).alias("d"))
    joined = weekly.join(from_days, ["user_id", "course_id", "week"], "left")
    bad = joined.filter((F.col("total_interactions") != F.coalesce("t", F.lit(0)))
                        | (F.col("active_days") != F.coalesce("d", F.lit(0))))
    assert bad.count() == 0
    assert weekly.filter(F.col("session_minutes") != 2 * F.col("total_interactions")).count() == 0


def test_grid_shapes(spark):
    src = sources(spark, SF001)
    pairs = src.enrollments.count()
    term = src.term
    assert progress.block_progress(src).count() == pairs * len(term.block_starts)
    assert progress.activity_grid(src).count() == pairs * len(term.block_starts) * 6
    assert reflections.reflection_streaks(src).count() == pairs * term.display_weeks
    assert scores.weekly_scores(src).count() == pairs * term.weeks
    streaks = reflections.reflection_streaks(src)
    assert streaks.filter(F.col("streak") > F.col("current_week")).count() == 0


def test_scores_bounded_by_daily_means(spark):
    src = sources(spark, SF001)
    w = scores.weekly_scores(src).filter("has_submissions")
    assert w.filter((F.col("min_score") > F.col("avg_score")) | (F.col("avg_score") > F.col("max_score"))).count() == 0
