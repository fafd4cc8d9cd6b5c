"""Distinct files over any span from mergeable bitmaps, against sets."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest

from learnlens.operators import daily, distinct
from learnlens.sources import commits
from tests.conftest import make_sources, rows

START = datetime(2024, 11, 11)
#: Ids in several buckets of 32,768, at their edges, and negative ones.
IDS = [None, 1, 2, 32_767, 32_768, 32_769, 65_536, 10**12, 0, -1, -40_000]


def clicks(seed: int = 4) -> list[tuple]:
    rng = random.Random(seed)
    return [(rng.choice(["a", "b"]), rng.choice([1, 2]), START + timedelta(hours=rng.randint(0, 24 * 30)), rng.choice(IDS), i)
            for i in range(700)]


@pytest.fixture(scope="module")
def mart(spark):
    src = make_sources(spark, web=clicks(), enrollments=[("a", 1), ("b", 2)])
    return src, distinct.click_days(src)


def sets(key):
    found, n = defaultdict(set), defaultdict(int)
    for u, c, t, f, _ in clicks():
        if f is not None:
            k = key(u, c, (t.date() - START.date()).days // 7 + 1, t.date())
            if k is not None:
                found[k].add(f)
                n[k] += 1
    return sorted((*k, n[k], len(found[k])) for k in found)


def test_spans_against_sets(mart):
    _, days = mart
    assert rows(distinct.weekly_files(days)) == sets(lambda u, c, w, d: (u, c, w))
    assert rows(distinct.block_files(days)) == sets(lambda u, c, w, d: (u, c, (w - 1) // 2 * 2 + 1))
    assert rows(distinct.course_week_files(days)) == sets(lambda u, c, w, d: (c, w))
    lo, hi = date(2024, 11, 14), date(2024, 11, 29)
    assert rows(distinct.files_between(days, lo, hi)) == sets(lambda u, c, w, d: (u, c) if lo <= d <= hi else None)


def test_days_equal_the_pass_over_clicks(mart):
    src, days = mart
    want = daily.daily_web_activity(src)
    assert rows(distinct.daily_web_activity(days), *want.columns) == rows(want)


def test_marts_of_parts_merge_to_the_mart_of_all(spark, mart):
    src, days = mart
    parts = [distinct.click_days(make_sources(spark, web=clicks()[i::3], enrollments=[("a", 1)])) for i in range(3)]
    both = distinct.merged(parts[0].union(parts[1]).union(parts[2]))
    assert rows(both, *days.columns) == rows(days)


def test_spans_of_a_written_mart_read_no_clicks(spark, mart, tmp_path):
    _, days = mart
    schema = commits.write_run(days, str(tmp_path / "click_days"), 1)
    stored = commits.read_run(spark, str(tmp_path / "click_days"), 1, schema)
    weekly = distinct.weekly_files(stored)
    assert rows(weekly) == rows(distinct.weekly_files(days))
    assert all("click_days" in f for f in weekly.inputFiles())


def test_no_clicks(spark):
    days = distinct.click_days(make_sources(spark))
    assert days.count() == 0 and distinct.weekly_files(days).count() == 0


def test_the_mart_takes_memory_by_its_clicks(mart):
    # With a bitmap of 4 KB a row, sorted before it was merged, a task held 4 KB for every click.
    _, days = mart
    both = distinct.merged(days.union(days))
    assert dict(both.dtypes)["files"] == "bigint"
    plan = distinct.daily_web_activity(both)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert days.count() <= len(clicks())
    assert {r.files is None for r in both.where("bucket IS NULL").collect()} == {True}


def test_every_place_of_a_bucket_counts(spark):
    ids = [*range(-130, 130), 2**63 - 1, -2**63, 2**62]
    web = [("a", 1, START + timedelta(minutes=i % 50), f) for i, f in enumerate(ids + ids[::2])]
    days = distinct.click_days(make_sources(spark, web=web, enrollments=[("a", 1)]))
    assert [(r.file_accesses, r.unique_files) for r in distinct.weekly_files(days).collect()] == [(len(web), len(ids))]


def test_marts_are_not_merged_where_they_lie(mart):
    # The same partitions of all marts in one task took memory by the number of marts.
    _, days = mart
    plan = distinct.merged(days.union(days))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("Union")
