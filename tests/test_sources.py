"""Readers: silver Parquet files and catalog tables give the same metrics as
the in-memory fixture they were written from."""

from __future__ import annotations

import tempfile

from conftest import make_sources, rows, ts
from learnlens.operators import daily, progress, summary
from learnlens.sources import schemas
from learnlens.sources.tables import Sources

C = 28301


def fixture(spark):
    web = [("u1", C, ts("2024-11-11 08:00:00"), 3), ("u1", C, ts("2024-11-12 09:00:00"), None),
           ("u2", C, ts("2024-11-19 10:00:00"), 4)]
    quiz = [("u1", C, 1, ts("2024-11-12 10:00:00"), 8.0, 12.0, "complete")]
    subs = [("u2", C, 2, ts("2024-11-20 10:00:00"), 3.0, "graded")]
    return make_sources(spark, web=web, quiz=quiz, quizzes=[(1, 10.0)], subs=subs,
                        assignments=[(2, 6.0)], enrollments=[("u1", C), ("u2", C)])


def _tables(src: Sources) -> dict:
    return {"web_logs": src.web_logs.drop("event_id"), "quiz_submissions": src.quiz_submissions,
            "quizzes": src.quizzes, "submissions": src.submissions, "assignments": src.assignments,
            "enrollments": src.enrollments}


def _same(a: Sources, b: Sources):
    assert rows(summary.weekly_summary(a)) == rows(summary.weekly_summary(b))
    assert rows(daily.daily_metrics_wide(a)) == rows(daily.daily_metrics_wide(b))
    assert rows(progress.block_progress(a)) == rows(progress.block_progress(b))


def test_from_silver_parquet(spark):
    src = fixture(spark)
    root = tempfile.mkdtemp(prefix="learnlens-silver-")
    for key, df in _tables(src).items():
        df.write.parquet(f"{root}/{schemas.SILVER_TABLES[key]}")
    read = Sources.from_silver(spark, root, reflection_log=src.reflection_log)
    assert read.web_logs.schema == schemas.web_logs()
    _same(src, read)


def test_from_catalog(spark):
    src = fixture(spark)
    for key, df in _tables(src).items():
        df.createOrReplaceGlobalTempView(schemas.SILVER_TABLES[key])
    read = Sources.from_catalog(spark, "global_temp", src.reflection_log)
    _same(src, read)


def test_known_courses_and_labels(spark):
    from learnlens.operators import courses
    src = make_sources(spark, enrollments=[("u1", 28301), ("u1", 12345)])
    got = {(r.course_id, r.course_label, r.known) for r in courses.course_labels(src).collect()}
    assert got == {(28301, "0HV60-2024", True), (12345, "Unknown Course", False)}
    assert [r.course_id for r in courses.known_courses(src).collect()] == [28301]
    title = courses.course_labels(src).filter("course_id = 28301").first().title
    assert title == "0HV60-2024 - Self-Regulated Learning Reflection Dashboard"


def test_catalogue_ordered_and_frame(spark):
    from learnlens.plans import catalogue
    src = fixture(spark)
    df = catalogue.metric(src, "Web Activities", "Daily Web Activity", user_id="u1", week=1, ordered=True)
    days = [r.day for r in df.collect()]
    assert days == sorted(days) and len(days) == 7
    assert catalogue.catalogue_frame(spark).count() == len(catalogue.CATALOGUE) == 12
    try:
        catalogue.metric(src, "Quizzes", "No Such Metric")
    except KeyError:
        pass
    else:
        raise AssertionError("unknown metric must raise")
