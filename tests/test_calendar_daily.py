"""Week edges, calendar fill and daily metrics on the real term (2024-11-11)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from conftest import make_sources, rows, ts
from learnlens.config import REFERENCE_TERM
from learnlens.functions.time import block_start, display_week, week_of
from learnlens.operators import daily, summary

C = 28301

WEB = [
    ("u1", C, ts("2024-11-11 00:00:00"), 5),
    ("u1", C, ts("2024-11-17 23:59:59"), 5),
    ("u1", C, ts("2024-11-18 00:00:00"), None),
    ("u1", C, ts("2025-01-31 23:59:59"), 7),
    ("u1", C, ts("2024-11-10 23:00:00"), None),    # before the term
    ("u1", C, ts("2025-02-01 00:00:00"), None),    # at the (exclusive) end
    ("u1", C, ts("2024-11-11 09:30:00"), 6),
]
ENROLLED = [("u1", C), ("u2", 27886)]


def src(spark):
    return make_sources(spark, web=WEB, enrollments=ENROLLED)


def test_week_edges(spark):
    df = spark.createDataFrame([(r[2],) for r in WEB[:4]], "t timestamp_ntz")
    got = [r.w for r in df.select(week_of("t", REFERENCE_TERM).alias("w")).collect()]
    assert got == [1, 1, 2, 12]


def test_display_week_and_block(spark):
    df = spark.createDataFrame([(w,) for w in (-1, 1, 2, 3, 10, 12)], "w bigint")
    got = df.select(display_week("w", REFERENCE_TERM).alias("d"), block_start(display_week("w", REFERENCE_TERM)).alias("b")).collect()
    assert [r.d for r in got] == [1, 1, 2, 3, 10, 10]
    assert [r.b for r in got] == [1, 1, 1, 3, 9, 9]


def test_term_weeks():
    assert REFERENCE_TERM.raw_weeks == 12
    assert REFERENCE_TERM.weeks == 12 and REFERENCE_TERM.display_weeks == 10
    assert REFERENCE_TERM.block_starts == [1, 3, 5, 7, 9]
    assert REFERENCE_TERM.week_of(date(2024, 11, 18)) == 2
    assert REFERENCE_TERM.week_of(date(2025, 3, 1)) == 10


def test_calendar_fill_seven_rows_per_week_and_totals(spark):
    d = daily.daily_metric(src(spark), "daily_interactions")
    assert d.count() == 2 * 84
    per_week = d.groupBy("user_id", "course_id", "week").count().select("count").distinct().collect()
    assert [r[0] for r in per_week] == [7]
    u1 = {r.day: r.value for r in d.filter("user_id = 'u1'").collect()}
    assert u1[date(2024, 11, 11)] == 2 and u1[date(2024, 11, 17)] == 1
    assert u1[date(2024, 11, 18)] == 1
    assert sum(u1.values()) == 5          # the week-12 event counts too
    assert d.filter("user_id = 'u2'").agg(F.sum("value")).first()[0] == 0


def test_files_distinct_not_above_accesses(spark):
    s = src(spark)
    acc = {(r.day): r.value for r in daily.daily_metric(s, "file_accesses").filter("user_id='u1'").collect()}
    uni = {(r.day): r.value for r in daily.daily_metric(s, "unique_files").filter("user_id='u1'").collect()}
    assert acc[date(2024, 11, 11)] == 2 and uni[date(2024, 11, 11)] == 2
    assert acc[date(2024, 11, 17)] == 1 and uni[date(2024, 11, 17)] == 1
    assert all(uni[k] <= acc[k] for k in acc)


def test_daily_mart_keeps_raw_week(spark):
    mart = daily.daily_web_activity(src(spark))
    got = rows(mart, "day", "week", "interactions", "file_accesses", "unique_files")
    assert got == [
        (date(2024, 11, 11), 1, 2, 2, 2),
        (date(2024, 11, 17), 1, 1, 1, 1),
        (date(2024, 11, 18), 2, 1, 0, 0),
        (date(2025, 1, 31), 12, 1, 1, 1),
    ]
    first = mart.filter(F.col("day") == F.lit(date(2024, 11, 11))).first()
    assert first.first_activity == ts("2024-11-11 00:00:00")
    assert first.last_activity == ts("2024-11-11 09:30:00")


def test_wide_equals_single_metrics(spark):
    s = src(spark)
    wide = daily.daily_metrics_wide(s)
    for name in daily.DAILY_METRICS:
        one = rows(daily.daily_metric(s, name), "user_id", "course_id", "day", "value")
        assert rows(wide, "user_id", "course_id", "day", name) == one, name


def test_no_activity_weeks(spark):
    flags = daily.no_activity_weeks(src(spark))
    got = {(r.user_id, r.week): r.no_activity for r in flags.filter("metric = 'daily_interactions'").collect()}
    assert got[("u1", 1)] is False and got[("u1", 2)] is False and got[("u1", 3)] is True
    assert all(got[("u2", w)] for w in range(1, 13))


def test_weekly_summary_and_inclusive_end(spark):
    s = src(spark)
    half_open = {r.week: r for r in summary.weekly_summary(s).filter("user_id = 'u1'").collect()}
    assert half_open[1].total_interactions == 3 and half_open[1].active_days == 2
    assert half_open[1].avg_daily_interactions == 1.5
    assert half_open[1].session_minutes == 6 and half_open[1].study_hours == 0.1
    assert half_open[1].engagement == "Limited"
    assert half_open[3].engagement == "No Activity" and half_open[3].avg_daily_interactions == 0.0
    closed = {r.week: r for r in summary.weekly_summary(s, inclusive_end=True)
              .filter("user_id = 'u1'").collect()}
    # The Monday 00:00:00 event also counts for the week before (closed window).
    assert closed[1].total_interactions == 4 and closed[1].active_days == 3
    assert closed[2].total_interactions == 1
    cal = {r.week: r for r in summary.weekly_summary(s, mean="calendar").filter("user_id='u1'").collect()}
    assert cal[1].avg_daily_interactions == round(3 / 7, 1)


def test_active_days_engagement(spark):
    web = []
    for uid, n in (("a0", 0), ("a1", 1), ("a2", 2), ("a3", 3), ("a4", 4), ("a5", 5), ("a7", 7)):
        for d in range(n):
            web.append((uid, C, ts(f"2024-11-{11 + d:02d} 10:00:00"), None))
            web.append((uid, C, ts(f"2024-11-{11 + d:02d} 11:00:00"), None))
    s = make_sources(spark, web=web, enrollments=[(u, C) for u in ("a0", "a1", "a2", "a3", "a4", "a5", "a7")])
    got = {r.user_id: (r.active_days, r.engagement, r.avg_daily_interactions)
           for r in summary.weekly_summary(s).filter("week = 1").collect()}
    assert got == {"a0": (0, "No Activity", 0.0), "a1": (1, "Limited", 2.0), "a2": (2, "Limited", 2.0),
                   "a3": (3, "Good", 2.0), "a4": (4, "Good", 2.0), "a5": (5, "Excellent", 2.0),
                   "a7": (7, "Excellent", 2.0)}


def test_quiz_minutes_nulls(spark):
    quiz = [("u1", C, 1, ts("2024-11-12 10:00:00"), 5.0, None, "complete"),
            ("u1", C, 1, ts("2024-11-12 11:00:00"), 5.0, None, "complete"),
            ("u1", C, 1, ts("2024-11-13 10:00:00"), 5.0, 12.5, "complete"),
            ("u1", C, 1, ts("2024-11-13 11:00:00"), 5.0, None, "complete")]
    s = make_sources(spark, quiz=quiz, quizzes=[(1, 10.0)], enrollments=[("u1", C)])
    got = {r.day: r.value for r in daily.daily_metric(s, "quiz_minutes").collect()}
    assert got[date(2024, 11, 12)] == 0.0 and got[date(2024, 11, 13)] == 12.5
    week = summary.weekly_quiz_minutes(s).collect()
    assert [(r.week, r.quiz_minutes) for r in week] == [(1, 12.5)]


def test_events_after_the_last_week_to_pick_count(spark):
    web = [("u1", C, ts("2024-11-19 10:00:00"), None), ("u1", C, ts("2025-01-25 10:00:00"), 4)]
    s = make_sources(spark, web=web, enrollments=[("u1", C)])
    days = {r.day: r.value for r in daily.daily_metric(s, "daily_interactions").collect() if r.value}
    assert days == {date(2024, 11, 19): 1, date(2025, 1, 25): 1}
    weeks = {r.week: r.total_interactions for r in summary.weekly_summary(s).collect()}
    assert len(weeks) == 12 and weeks[2] == weeks[11] == 1 and sum(weeks.values()) == 2
    wide = daily.daily_metrics_wide(s).agg({"daily_interactions": "sum", "unique_files": "sum"}).first()
    assert sorted(wide) == [1, 2]


def test_minutes_are_summed_plainly(spark):
    quiz = [("u1", C, 1, ts(f"2024-11-12 1{i}:00:00"), 1.0, m, "complete")
            for i, m in enumerate([1e-7, 1.0, float("nan"), None, 1e13])]
    s = make_sources(spark, quiz=quiz[:4], quizzes=[(1, 10.0)], enrollments=[("u1", C)])
    assert summary.weekly_quiz_minutes(s).first().quiz_minutes == 1.0 + 1e-7
    s = make_sources(spark, quiz=quiz, quizzes=[(1, 10.0)], enrollments=[("u1", C)])
    assert summary.weekly_quiz_minutes(s).first().quiz_minutes == 1e13 + 1.0 + 1e-7
