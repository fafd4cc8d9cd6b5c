"""Marts that fold in new files only: equal to a full run, late rows included, and
nothing old is read again."""

from __future__ import annotations

import os
import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from learnlens.config import REFERENCE_TERM
from learnlens.operators import progress
from learnlens.plans import incremental
from learnlens.sources import completion, extracts
from learnlens.sources.schemas import SILVER_TABLES
from tests.conftest import make_sources, rows

START = datetime(2024, 11, 11)
USERS, COURSES = ["a", "b", "c@x"], [27886, 28301]


def tables(seed: int, n: int):
    """(clicks, quizzes, submissions) at random times of the term and some beyond it."""
    rng = random.Random(seed)
    when = lambda: START + timedelta(minutes=rng.randint(-2000, 60 * 24 * 85))
    who = lambda: (rng.choice(USERS), rng.choice(COURSES))
    states = ["complete", "pending_review", "untaken", "graded", "submitted"]
    return ([(*who(), when(), rng.choice([None, 1, 2, 40_000])) for _ in range(n)],
            [(*who(), rng.randint(1, 3), when(), rng.random(), rng.random(), rng.choice(states)) for _ in range(n)],
            [(*who(), rng.randint(1, 3), when(), rng.random(), rng.choice(states)) for _ in range(n)])


def sources(spark, *lots):
    web, quiz, subs = ([r for lot in lots for r in lot[i]] for i in range(3))
    points = [(i, 10.0 * i) for i in range(3)]
    return make_sources(spark, web=web, quiz=quiz, subs=subs, quizzes=points, assignments=points,
                        enrollments=[(u, c) for u in USERS for c in COURSES],
                        log=[("a", 27886, w, 5, 5, None, START, w, False) for w in range(1, 11)])


def write(src, folder):
    for t in ("web_logs", "quiz_submissions", "submissions"):
        df = getattr(src, t)
        df.drop("event_id").coalesce(1).write.mode("append").parquet(f"{folder}/{SILVER_TABLES[t]}")


@pytest.fixture
def silver(spark, tmp_path):
    first = sources(spark, tables(1, 600))
    folder = str(tmp_path / "silver")
    write(first, folder)
    for t in ("quizzes", "assignments", "enrollments"):
        getattr(first, t).write.parquet(f"{folder}/{SILVER_TABLES[t]}")
    return folder


def marts(spark, silver, tmp_path):
    return incremental.Marts.over(spark, silver, str(tmp_path / "marts"), REFERENCE_TERM, sources(spark).reflection_log)


def check(found, src):
    full, got = extracts.Extract.live(src), found.extract()
    for m in extracts.MARTS:
        want = getattr(full, m)
        assert rows(getattr(got, m), *want.columns) == rows(want), m
    flags = completion.completion_snapshot(progress.block_progress(src))
    assert rows(found.completion()) == rows(flags)


def test_appended_files_are_folded_in(spark, silver, tmp_path):
    lots = [tables(1, 600), tables(2, 6)]   # the second: 1 %, at any time of the term
    found = marts(spark, silver, tmp_path)
    first = found.refresh()
    check(found, sources(spark, *lots[:1]))
    assert all(len(r.files) == 1 and not r.rebuilt for r in first.values())

    again = found.refresh()
    assert all(r.files == () and r.version == first[n].version for n, r in again.items())

    write(sources(spark, lots[1]), silver)
    second = found.refresh()
    check(found, sources(spark, *lots))
    for name, r in second.items():
        assert len(r.files) == 1 and not set(r.files) & set(first[name].files) and not r.rebuilt
    assert len(found.clicks.segments.state().segments) == 2
    latest = max(c[2] for lot in lots for c in lot[0])
    assert found.clicks.high_water().startswith(str(latest)[:19])


def test_only_new_files_are_opened(spark, silver, tmp_path):
    found = marts(spark, silver, tmp_path)
    old = found.refresh()["click_days"].files
    # An old file that can't be read any more does no harm, as long as it looks the same.
    path = old[0].removeprefix("file:")
    stat = os.stat(path)
    with open(path, "r+b") as f:
        f.write(b"x" * stat.st_size)
    os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    assert os.path.exists(crc)
    write(sources(spark, tables(3, 5)), silver)
    assert len(found.refresh()["click_days"].files) == 1
    want = sources(spark, tables(1, 600), tables(3, 5))
    assert rows(found.extract().web_activity_data) == rows(extracts.extract_frames(want)["web_activity_data"])


def test_a_changed_table_is_read_anew(spark, silver, tmp_path):
    found = marts(spark, silver, tmp_path)
    found.refresh()
    src = sources(spark, tables(9, 50))
    src.web_logs.drop("event_id").write.mode("overwrite").parquet(f"{silver}/{SILVER_TABLES['web_logs']}")
    did = found.refresh()
    assert did["click_days"].rebuilt and not did["quiz_data"].rebuilt
    want = replace(sources(spark, tables(1, 600)), web_logs=src.web_logs)
    check(found, want)


def test_merged_segments_answer_alike(spark, silver, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MAX_SEGMENTS", 2)
    found = marts(spark, silver, tmp_path)
    lots = [tables(1, 600)]
    found.clicks.refresh()
    for i in range(3):
        lots.append(tables(20 + i, 10))
        write(sources(spark, lots[-1]), silver)
        found.clicks.refresh()
    assert len(found.clicks.segments.state().segments) == 2 and found.clicks.refresh().files == ()
    want = extracts.extract_frames(sources(spark, *lots))["web_activity_data"]
    assert rows(found.extract().web_activity_data) == rows(want)


def test_two_refreshes_at_a_time_count_nothing_twice(spark, silver, tmp_path, monkeypatch):
    one, two = (marts(spark, silver, tmp_path).clicks for _ in range(2))
    prepared = []

    def raced(df):
        if not prepared:            # the other refresh commits while this one works
            prepared.append(two.refresh())
        return incremental.distinct.click_days(replace(sources(spark), web_logs=df))

    monkeypatch.setattr(one, "prepare", raced)
    assert one.refresh().files == () and len(prepared[0].files) == 1
    want = extracts.extract_frames(sources(spark, tables(1, 600)))["web_activity_data"]
    assert one.read().agg(F.sum("interactions")).first()[0] == want.agg(F.sum("interactions")).first()[0]


def test_no_files_yet(spark, tmp_path):
    src = sources(spark)
    folder = str(tmp_path / "silver")
    for t in SILVER_TABLES:
        getattr(src, t).limit(0).write.parquet(f"{folder}/{SILVER_TABLES[t]}")
    found = marts(spark, folder, tmp_path)
    found.refresh()
    assert found.extract().web_activity_data.count() == 0 and found.completion().count() == 0
