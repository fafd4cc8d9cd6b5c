"""Activity tracker, reflection log, feedback, streaks, badges, completion feed."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import make_sources, rows, ts
from learnlens.functions import rules
from learnlens.operators import badges, progress, reflections
from learnlens.sources import commits, completion
from learnlens.sources.reflections import (current_reflections, delete_rows,
                                           read_reflection_documents, save_rows)

C = 28301


def _week_ts(week, hour=10):
    day = 11 + 7 * (week - 1)
    month, d = (11, day) if day <= 30 else (12, day - 30)
    return ts(f"2024-{month:02d}-{d:02d} {hour:02d}:00:00")


def _log(user, week, s=5, e=5, saved=None, seq=0, deleted=False):
    return (user, C, week, s, e, None, saved or _week_ts(week), seq, deleted)


def progress_src(spark):
    # u1: block 1 all six done; block 3 three of six; block 5 none.
    quiz = [("u1", C, 1, _week_ts(1), 5.0, 1.0, "complete"),
            ("u1", C, 1, _week_ts(2), 5.0, 1.0, "pending_review"),
            ("u1", C, 1, _week_ts(3), 5.0, 1.0, "complete"),
            ("u1", C, 1, _week_ts(4), 5.0, 1.0, "untaken")]          # not accepted
    subs = [("u1", C, 1, _week_ts(1), 5.0, "graded"),
            ("u1", C, 1, _week_ts(2), 5.0, "submitted"),
            ("u1", C, 1, _week_ts(3), 5.0, "unsubmitted"),              # not accepted
            ("u1", C, 1, _week_ts(4), 5.0, "pending_review")]
    log = [_log("u1", 1), _log("u1", 2), _log("u1", 3)]
    return make_sources(spark, quiz=quiz, quizzes=[(1, 10.0)], subs=subs, assignments=[(1, 10.0)],
                        enrollments=[("u1", C), ("u2", C)], log=log)


def test_activity_grid(spark):
    g = progress.activity_grid(progress_src(spark))
    assert g.count() == 2 * 5 * 6
    u1 = {(r.week, r.activity): (r.done, r.name) for r in g.filter("user_id = 'u1'").collect()}
    assert u1[(1, "quiz")] == (True, "Submit Week 1 Quiz")
    assert u1[(2, "assignment")] == (True, "Submit Week 2 Assignment")
    assert u1[(3, "reflection")] == (True, "Reflect on Week 3")
    assert u1[(4, "quiz")][0] is False and u1[(3, "assignment")][0] is False


def test_block_progress(spark):
    b = {(r.user_id, r.block_start): r for r in progress.block_progress(progress_src(spark)).collect()}
    one, three, five = b[("u1", 1)], b[("u1", 3)], b[("u1", 5)]
    assert (one.total, one.completed, one.percent, one.is_complete) == (6, 6, 100, True)
    assert one.message == rules.BLOCK_ALL_DONE and one.previous_message == rules.NO_PREVIOUS_BLOCK
    assert (three.completed, three.percent) == (3, 50)
    assert three.message == rules.BLOCK_SOME_DONE and three.previous_message == rules.PREVIOUS_ALL_DONE
    assert (five.completed, five.percent) == (0, 0) and five.message == rules.BLOCK_NONE_DONE
    assert five.previous_message == rules.PREVIOUS_SOME_DONE % (3, 6)
    assert b[("u2", 3)].previous_message == rules.PREVIOUS_NONE_DONE
    # previous of block b is block b - 2
    for (u, blk), r in b.items():
        if blk > 1:
            assert r.previous_completed == b[(u, blk - 2)].completed


def test_scope_user_counts_other_courses(spark):
    quiz = [("u", 27886, 1, _week_ts(1), 5.0, 1.0, "complete")]
    s = make_sources(spark, quiz=quiz, quizzes=[(1, 10.0)],
                     enrollments=[("u", 27886), ("u", C), ("w", C)])
    per_course = {(r.course_id, r.week, r.activity): r.done
                  for r in progress.activity_grid(s).filter("user_id = 'u'").collect()}
    per_user = {(r.course_id, r.week, r.activity): r.done
                for r in progress.activity_grid(s, scope="user").filter("user_id = 'u'").collect()}
    assert per_course[(27886, 1, "quiz")] and not per_course[(C, 1, "quiz")]
    assert per_user[(27886, 1, "quiz")] and per_user[(C, 1, "quiz")]
    assert sum(per_user.values()) == 2
    w = progress.block_progress(s, scope="user").filter("user_id = 'w'").collect()
    assert all(r.completed == 0 for r in w)


def test_submitted_weeks(spark):
    s = progress_src(spark)
    assert rows(progress.quiz_weeks(s), "week") == [(1,), (2,), (3,)]
    assert rows(progress.assignment_weeks(s), "week") == [(1,), (2,), (4,)]


def test_log_upsert_delete_reinsert_and_ties(spark):
    t = [ts(f"2024-11-1{i} 12:00:00") for i in range(1, 7)]
    log = [
        _log("u", 1, 5, 6, t[0], 1), _log("u", 1, 7, 7, t[1], 2),            # update
        _log("u", 2, 3, 3, t[0], 1), _log("u", 2, None, None, t[2], 2, True),  # delete
        _log("u", 3, 4, 4, t[0], 1), _log("u", 3, None, None, t[1], 2, True),
        _log("u", 3, 9, 9, t[2], 3),                                           # re-insert
        _log("u", 4, 1, 1, t[3], 5), _log("u", 4, 2, 2, t[3], 6),              # tie -> seq
    ]
    s = make_sources(spark, log=log)
    got = rows(current_reflections(s.reflection_log), "week", "satisfaction", "expectation")
    assert got == [(1, 7, 7), (3, 9, 9), (4, 2, 2)]


def test_save_and_delete_rows_shape(spark):
    keys = spark.createDataFrame([("u", C, 2)], "user_id string, course_id bigint, week bigint")
    saved = save_rows(keys.withColumn("satisfaction", F.lit(6)).withColumn("expectation", F.lit(7)),
                      saved_at=ts("2024-11-20 10:00:00"))
    gone = delete_rows(keys, saved_at=ts("2024-11-21 10:00:00"))
    assert saved.columns == gone.columns
    assert current_reflections(saved.unionByName(gone)).count() == 0
    assert current_reflections(saved).first().satisfaction == 6


def test_nested_json_import(spark):
    folder = tempfile.mkdtemp(prefix="learnlens-refl-")
    docs = {
        "u1": {"28301": {"1": {"satisfaction": 5, "expectation": 7, "feedback": "x",
                               "reflection_saved": True, "saved_at": "2024-11-12 10:00:00"},
                         "2": {"satisfaction": 8, "expectation": 8, "feedback": "y",
                               "reflection_saved": True, "saved_at": "2024-11-19 10:00:00"}}},
        "u.2": {"27886": {"3": {"satisfaction": 2, "expectation": 2, "feedback": "z",
                                "reflection_saved": True, "saved_at": "2024-11-26 10:00:00"}}},
    }
    for uid, doc in docs.items():
        with open(os.path.join(folder, f"reflections_{uid}.json"), "w") as f:
            json.dump(doc, f, indent=2)
    got = rows(read_reflection_documents(spark, folder), "user_id", "course_id", "week",
               "satisfaction", "expectation", "deleted")
    assert got == [("u.2", 27886, 3, 2, 2, False), ("u1", 28301, 1, 5, 7, False),
                   ("u1", 28301, 2, 8, 8, False)]


def test_feedback_last_week_exactly(spark):
    log = [_log("u", 1, 5, 8), _log("u", 2, 9, 9), _log("u", 4, 3, 2), _log("u", 5, 3, 3)]
    s = make_sources(spark, log=log)
    fb = {r.week: r for r in reflections.reflection_feedback(s).collect()}
    assert fb[1].last_expectation is None and fb[1].versus_last is None
    assert fb[2].last_expectation == 8 and fb[2].versus_last == "exceeded"
    assert fb[4].last_expectation is None            # week 3 missing: not the previous row
    assert fb[5].last_expectation == 2 and fb[5].versus_last == "exceeded_low"
    assert fb[2].category == "flying" and fb[1].category == "growth"
    assert fb[2].feedback.startswith(rules.CATEGORY_TEXT["flying"])


def test_streaks(spark):
    log = [_log("u", w) for w in (1, 2, 3, 5, 6)]
    s = make_sources(spark, log=log, enrollments=[("u", C), ("v", C)])
    st = {(r.user_id, r.current_week): (r.streak, r.shown) for r in reflections.reflection_streaks(s).collect()}
    assert st[("u", 1)] == (1, False)
    assert st[("u", 3)] == (3, True)
    assert st[("u", 4)] == (0, False)      # current week missing
    assert st[("u", 6)] == (2, True)       # gap at week 4
    assert st[("u", 7)] == (0, False)
    assert all(st[("v", w)] == (0, False) for w in range(1, 11))


def test_badges_thresholds(spark):
    log, enrolled = [], []
    for n in (0, 1, 3, 4, 7, 8):
        uid = f"r{n}"
        enrolled.append((uid, C))
        log += [_log(uid, w) for w in range(1, n + 1)]
    s = make_sources(spark, log=log, enrollments=enrolled)
    b = badges.badges(s)
    assert b.count() == 6 * 6
    unlocked = {(r.user_id, r.badge): r.unlocked for r in b.collect()}
    assert [unlocked[(f"r{n}", "rookie")] for n in (0, 1, 3, 4, 7, 8)] == [False, True, True, True, True, True]
    assert [unlocked[(f"r{n}", "consistent")] for n in (0, 1, 3, 4, 7, 8)] == [False, False, False, True, True, True]
    assert [unlocked[(f"r{n}", "master")] for n in (0, 1, 3, 4, 7, 8)] == [False, False, False, False, False, True]
    tips = {(r.user_id, r.badge): (r.tooltip, r.image) for r in b.collect()}
    assert tips[("r0", "rookie")] == (rules.BADGES[0][5], rules.LOCKED_IMAGE)
    assert tips[("r1", "rookie")] == (rules.BADGES[0][4], rules.BADGES[0][3])


def test_block_badges(spark):
    # u completes blocks 1, 3, 5 and 7 (quiz, assignment, reflection every week 1..8).
    weeks = range(1, 9)
    quiz = [("u", C, 1, _week_ts(w), 5.0, 1.0, "complete") for w in weeks]
    subs = [("u", C, 1, _week_ts(w), 5.0, "graded") for w in weeks]
    log = [_log("u", w) for w in weeks]
    s = make_sources(spark, quiz=quiz, quizzes=[(1, 1.0)], subs=subs, assignments=[(1, 1.0)],
                     enrollments=[("u", C)], log=log)
    b = {r.badge: (r.have, r.unlocked) for r in badges.badges(s).collect()}
    assert b["selfaware"] == (4, True) and b["insightchampion"] == (4, True)
    assert b["kingofwisdom"] == (4, True) and b["master"] == (8, True)


def test_completion_snapshots_and_changes(spark):
    root = tempfile.mkdtemp(prefix="learnlens-snap-")
    schema = "user_id string, course_id bigint, block_start bigint, completed boolean"
    first = spark.createDataFrame([("u", C, 1, True), ("u", C, 3, False), ("v", C, 1, True)], schema)
    second = spark.createDataFrame([("u", C, 1, True), ("u", C, 3, True), ("v", C, 1, False)], schema)
    completion.write_snapshot(first, root, 1)
    prev = completion.read_latest_snapshot(spark, root)
    assert prev.count() == 3
    changes = rows(completion.completion_changes(second, prev), "user_id", "block_start", "change")
    assert changes == [("u", 3, "set"), ("v", 1, "cleared")]
    completion.write_snapshot(second, root, 2)
    latest = completion.read_latest_snapshot(spark, root)
    assert rows(latest, "user_id", "block_start", "completed") == [("u", 1, True), ("u", 3, True), ("v", 1, False)]
    assert completion.completion_changes(second, latest).count() == 0
    # A run whose data landed but which never committed (it failed) stays invisible.
    commits.write_run(first, f"{root}/data", 3)
    assert rows(completion.read_latest_snapshot(spark, root), "user_id", "block_start", "completed") == \
        rows(latest, "user_id", "block_start", "completed")


def test_block_badges_at_each_count(spark):
    # user bK completes the first K blocks (weeks 1..2K fully done), K = 0..4
    quiz, subs, log, enrolled = [], [], [], []
    for k in range(5):
        uid = f"b{k}"
        enrolled.append((uid, C))
        for w in range(1, 2 * k + 1):
            quiz.append((uid, C, 1, _week_ts(w), 5.0, 1.0, "complete"))
            subs.append((uid, C, 1, _week_ts(w), 5.0, "graded"))
            log.append(_log(uid, w))
    s = make_sources(spark, quiz=quiz, quizzes=[(1, 1.0)], subs=subs, assignments=[(1, 1.0)],
                     enrollments=enrolled, log=log)
    b = {(r.user_id, r.badge): (r.have, r.unlocked) for r in badges.badges(s).collect()}
    for k in range(5):
        assert b[(f"b{k}", "selfaware")] == (k, k >= 1)
        assert b[(f"b{k}", "insightchampion")] == (k, k >= 2)
        assert b[(f"b{k}", "kingofwisdom")] == (k, k >= 4)


def test_ids_come_back_from_storage_keys(spark):
    from learnlens.sources import reflections as refl
    doc = '{"28301": {"3": {"satisfaction": 7, "expectation": 8, "feedback": "kept", "saved_at": "2024-11-25 10:00:00", "reflection_saved": true}}}'
    docs = spark.createDataFrame([(doc, f"reflections_{k}.json") for k in ("ann_uni.nl", "a_b", "plain", "gone")], "value string, file string")
    enrolled = spark.createDataFrame([("ann@uni.nl", C), ("a b", C), ("a/b", C), ("plain", C), ("plain", 2)], "user_id string, course_id long")
    got = refl.restore_user_ids(refl.parse_reflection_documents(docs), enrolled)
    assert rows(got, "user_id", "feedback") == [("a_b", "kept"), ("ann@uni.nl", "kept"), ("gone", "kept"), ("plain", "kept")]
    assert rows(refl.key_collisions(enrolled)) == [("a_b", "a b"), ("a_b", "a/b")]
    s = make_sources(spark, enrollments=[("ann@uni.nl", C)])
    from dataclasses import replace
    s = replace(s, reflection_log=got)
    streak = {r.current_week: r.streak for r in reflections.reflection_streaks(s).collect()}
    assert streak[3] == 1
    assert reflections.reflections(s).where("user_id = 'ann@uni.nl'").first().feedback == "kept"


def test_saves_keep_the_wall_clock(spark):
    from learnlens.sources import reflections as refl
    ratings = spark.createDataFrame([("u", C, 1, 7, 8)], "user_id string, course_id long, week long, satisfaction int, expectation int")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert refl.save_rows(ratings, ts("2024-11-13 10:00:00")).first().saved_at == ts("2024-11-13 10:00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_log_compaction_keeps_the_state(spark):
    from learnlens.sources import reflections as refl
    root = tempfile.mkdtemp(prefix="learnlens-log-")
    keys = "user_id string, course_id long, week long"
    rate = lambda u, w, s: spark.createDataFrame([(u, C, w, s, 5)], keys + ", satisfaction int, expectation int")
    for i, s in enumerate((3, 4, 9)):
        refl.append_to_log(refl.save_rows(rate("u", 1, s), ts(f"2024-11-1{i + 1} 10:00:00")), f"{root}/a")
    refl.append_to_log(refl.save_rows(rate("u", 2, 6), ts("2024-11-20 10:00:00")), f"{root}/a")
    refl.append_to_log(refl.delete_rows(spark.createDataFrame([("u", C, 2)], keys), ts("2024-11-21 10:00:00")), f"{root}/a")
    refl.compact_log(spark, f"{root}/a", f"{root}/b")
    a, b = refl.read_log(spark, f"{root}/a"), refl.read_log(spark, f"{root}/b")
    assert a.count() == 5 and b.count() == 2
    assert rows(refl.current_reflections(a)) == rows(refl.current_reflections(b))


def test_existing_completion_flags_are_imported(spark):
    text = '{"u1": {"28301": {"1": true, "3": false}, "x": {"1": true}}, "u2": {"28301": {"Block 5": "TRUE"}}}'
    flags = completion.import_flags(spark.createDataFrame([(text,), ("not json",)], "value string"))
    assert rows(flags, "user_id", "course_id", "block_start", "completed") == [
        ("u1", 28301, 1, True), ("u1", 28301, 3, False), ("u2", 28301, 5, True)]


def test_flips_in_one_pass_equal_the_snapshots(spark):
    from learnlens.plans.queries import COMPLETION_CUTOFF, sources
    from conftest import SF001
    s = sources(spark, SF001)
    before = completion.completion_snapshot(progress.block_progress(s.as_of(COMPLETION_CUTOFF)))
    now = completion.completion_snapshot(progress.block_progress(s))
    flips = progress.completion_flips(s, COMPLETION_CUTOFF)
    assert rows(flips, "user_id", "course_id", "block_start", "change") == rows(
        completion.completion_changes(now, before), "user_id", "course_id", "block_start", "change")
    plan = progress.completion_flips(s, COMPLETION_CUTOFF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and plan.count("Exchange hashpartitioning") <= 4


def test_weeks_beyond_the_pick_make_no_streak(spark):
    log = [_log("u", w, saved=_week_ts(1)) for w in (9, 10, 65, 66)]
    s = make_sources(spark, log=log, enrollments=[("u", C)])
    got = {r.current_week: r.streak for r in reflections.reflection_streaks(s).collect()}
    assert got == {w: 0 for w in range(1, 9)} | {9: 1, 10: 2}
