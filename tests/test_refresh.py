"""Refresh job: committed marts read back equal the direct plans."""

from __future__ import annotations

import os
import tempfile

from conftest import SF0001, rows
from learnlens.plans import refresh
from learnlens.plans.queries import sources
from learnlens.sources import commits


def test_refresh_round_trip(spark, capsys):
    src = sources(spark, SF0001)
    root = tempfile.mkdtemp(prefix="learnlens-marts-")
    names = ["weekly_summary", "daily_metrics", "block_progress", "badges", "reflection_streaks"]
    run = refresh.refresh_marts(src, root, names)
    assert commits.latest_run(spark, root, refresh.DATASET) == run
    assert not os.path.exists(f"{root}/daily_web_activity")   # only what was asked for
    refresh.refresh_marts(src, root, ["daily_web_activity", "weekly_summary", "daily_metrics"], run + 10)
    for name in ("weekly_summary", "daily_metrics"):
        assert refresh.read_mart(spark, root, name).count() == refresh.MARTS[name](src).count()
    assert rows(refresh.read_mart(spark, root, "weekly_summary")) == rows(refresh.MARTS["weekly_summary"](src))
    run = refresh.refresh_marts(src, root, names, run + 20)
    for name in names:
        got, want = rows(refresh.read_mart(spark, root, name)), rows(refresh.MARTS[name](src))
        if name == "daily_metrics":   # scores are averages: compare to 9 places
            got = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in got]
            want = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in want]
        assert got == want, name
    uid = src.enrollments.first().user_id
    one = refresh.read_mart(spark, root, "weekly_summary", user_id=uid)
    one.explain(mode="formatted")
    assert f"EqualTo(user_id,{uid})" in capsys.readouterr().out
    assert rows(one) == rows(refresh.MARTS["weekly_summary"](src).filter(f"user_id = {uid}"))
    # a later run that never commits stays invisible
    commits.write_run(refresh.MARTS["weekly_summary"](src).limit(1), f"{root}/weekly_summary", run + 1)
    assert refresh.read_mart(spark, root, "weekly_summary").count() == \
        refresh.MARTS["weekly_summary"](src).count()


def test_refresh_cli_on_silver_tables(spark, capsys):
    from conftest import make_sources, ts
    from learnlens.sources import schemas
    from learnlens.sources.reflections import append_to_log, save_rows
    C = 28301
    src = make_sources(spark, web=[("u1", C, ts("2024-11-11 08:00:00"), 3)],
                       quiz=[("u1", C, 1, ts("2024-11-12 10:00:00"), 8.0, 12.0, "complete")],
                       quizzes=[(1, 10.0)], enrollments=[("u1", C)])
    root = tempfile.mkdtemp(prefix="learnlens-cli-")
    tables = {"web_logs": src.web_logs.drop("event_id"), "quiz_submissions": src.quiz_submissions,
              "quizzes": src.quizzes, "submissions": src.submissions, "assignments": src.assignments,
              "enrollments": src.enrollments}
    for key, df in tables.items():
        df.write.parquet(f"{root}/silver/{schemas.SILVER_TABLES[key]}")
    ratings = spark.createDataFrame([("u1", C, 1, 7, 8)],
                                    "user_id string, course_id bigint, week bigint, satisfaction int, expectation int")
    append_to_log(save_rows(ratings, saved_at=ts("2024-11-13 09:00:00")), f"{root}/log")
    refresh.main(["--silver", f"{root}/silver", "--reflection-log", f"{root}/log",
                  "--out", f"{root}/marts", "--marts", "weekly_summary,reflection_feedback"])
    assert "committed run" in capsys.readouterr().out
    fb = refresh.read_mart(spark, f"{root}/marts", "reflection_feedback").collect()
    assert [(r.user_id, r.week, r.satisfaction, r.expectation) for r in fb] == [("u1", 1, 7, 8)]
    ws = refresh.read_mart(spark, f"{root}/marts", "weekly_summary", user_id="u1").filter("week = 1").first()
    assert (ws.total_interactions, ws.quiz_minutes) == (1, 12.0)
