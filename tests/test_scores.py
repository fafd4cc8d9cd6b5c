"""Percent scores: null score, null / zero points, true 0 %, unmatched ids."""

from __future__ import annotations

import tempfile

from datetime import date

from conftest import make_sources, ts
from learnlens.operators import daily, scores
from learnlens.operators.joins import fits_broadcast, lookup_join

C = 28301
QUIZZES = [(1, 10.0), (2, None), (3, 0.0)]
QUIZ = [
    ("u1", C, 1, ts("2024-11-12 09:00:00"), 8.0, 10.0, "complete"),       # 80 %
    ("u1", C, 1, ts("2024-11-12 10:00:00"), None, 10.0, "complete"),      # null score
    ("u1", C, 2, ts("2024-11-13 09:00:00"), 5.0, 10.0, "complete"),       # null points
    ("u1", C, 3, ts("2024-11-13 10:00:00"), 5.0, 10.0, "untaken"),        # zero points
    ("u1", C, 1, ts("2024-11-14 09:00:00"), 0.0, 10.0, "complete"),       # true 0 %
    ("u1", C, 99, ts("2024-11-15 09:00:00"), 5.0, 10.0, "complete"),      # unmatched id
    ("u1", C, 1, ts("2024-11-16 09:00:00"), 6.0, 10.0, "pending_review"),  # 60 %
]


def src(spark):
    return make_sources(spark, quiz=QUIZ, quizzes=QUIZZES, enrollments=[("u1", C), ("u2", C)])


def test_daily_means_null_as_zero(spark):
    d = {r.day: (r.value, r.n_submissions, r.band, r.day_label) for r in scores.daily_scores(src(spark)).collect()}
    assert d[date(2024, 11, 12)] == (40.0, 2, "low", "Nov 12")
    assert d[date(2024, 11, 13)][0] == 0.0
    assert d[date(2024, 11, 14)][0] == 0.0
    assert d[date(2024, 11, 15)][0] == 0.0
    assert d[date(2024, 11, 16)][:3] == (60.0, 1, "middle")


def test_daily_means_null_day_option(spark):
    d = {r.day: r.value for r in scores.daily_scores(src(spark), null_day="zero_day").collect()}
    assert d[date(2024, 11, 12)] == 0.0          # one null score zeroes the day
    assert d[date(2024, 11, 16)] == 60.0


def test_weekly_scores_skip_zero_days(spark):
    w = {(r.user_id, r.week): r for r in scores.weekly_scores(src(spark)).collect()}
    u1 = w[("u1", 1)]
    assert (u1.avg_score, u1.min_score, u1.max_score) == (50.0, 40.0, 60.0)
    assert (u1.avg_band, u1.min_band, u1.max_band) == ("low", "low", "middle")
    assert u1.has_submissions and u1.message is None
    u2 = w[("u2", 1)]
    assert not u2.has_submissions and u2.message == scores.NO_SUBMISSIONS
    assert u2.avg_score is None
    assert len(w) == 2 * 12


def test_filled_daily_score_and_count(spark):
    s = src(spark)
    filled = {r.day: r.value for r in daily.daily_metric(s, "quiz_score").filter("user_id='u1'").collect()}
    assert filled[date(2024, 11, 12)] == 40.0 and filled[date(2024, 11, 11)] == 0.0
    counts = {r.day: r.value for r in daily.daily_metric(s, "quiz_submissions").filter("user_id='u1'").collect()}
    assert counts[date(2024, 11, 12)] == 2 and counts[date(2024, 11, 13)] == 2   # COUNT(*), all states


def test_lookup_join_both_paths(spark):
    s = src(spark)
    path = tempfile.mkdtemp(prefix="learnlens-dim-") + "/quizzes"
    s.quizzes.write.parquet(path)
    dim = spark.read.parquet(path)
    assert fits_broadcast(dim) and not fits_broadcast(s.quizzes)   # a size that isn't known doesn't fit
    small = lookup_join(s.quiz_submissions, dim, "quiz_id", "id")
    big = lookup_join(s.quiz_submissions, dim, "quiz_id", "id", max_bytes=1)
    key = lambda df: sorted((r.quiz_id, r.points_possible) for r in df.collect())
    assert key(small) == key(big)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
