"""Bucketed marts: cards without an exchange, equal to those from the sources; and
one student's rows found by Bloom filters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from learnlens.operators import badges, daily, progress, summary
from learnlens.plans import bucketed
from learnlens.plans.queries import sources
from learnlens.sources import commits
from tests.conftest import SF0001, make_sources, rows, ts


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    src = sources(spark, SF0001)
    root = str(tmp_path_factory.mktemp("bucketed"))
    bucketed.write_marts(src, root, 5)
    return src, bucketed.Bucketed.read(spark, root, src.term)


CARDS = {
    "weekly_summary": summary.weekly_summary,
    "daily_interactions": lambda s: daily.daily_metric(s, "daily_interactions"),
    "block_masks": progress.block_masks, "block_progress": progress.block_progress, "badges": badges.badges,
}


@pytest.mark.parametrize("card", CARDS)
def test_cards_from_marts_exchange_nothing(both, card):
    src, marts = both
    got = getattr(marts, card)()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    want = CARDS[card](src)
    assert rows(got, *want.columns) == rows(want)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()   # nor as it ran


def test_calendar_mean(both):
    src, marts = both
    assert rows(marts.weekly_summary("calendar")) == rows(summary.weekly_summary(src, "calendar"))


def test_students_without_events_or_ids(spark, tmp_path):
    src = make_sources(spark, web=[("a", 1, ts("2024-11-12 10:00:00"), None), ("b", 1, ts("2024-11-12 10:00:00"), 3)],
                       enrollments=[("a", 1), ("a", 1), ("c", 2), (None, 1)],
                       log=[("c", 2, w, 5, 5, None, ts("2024-11-12 10:00:00"), w, False) for w in (1, 2)])
    bucketed.write_marts(src, str(tmp_path), 3)
    marts = bucketed.Bucketed.read(spark, str(tmp_path), src.term)
    got = rows(marts.weekly_summary().where("week = 1"), "user_id", "course_id", "total_interactions")
    assert got == [("a", 1, 1), ("c", 2, 0)]       # b is not enrolled
    assert rows(marts.badges().where("position = 1"), "user_id", "have") == [("a", 0), ("c", 2)]


def test_catalog_stays_as_it_was(spark, both):
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
    with pytest.raises(FileNotFoundError):
        bucketed.Bucketed.read(spark, "/tmp/learnlens-no-such-folder", both[0].term)


def scanned(df) -> tuple[int, int]:
    """(rows out, rows that the scan took from the files)"""
    n = len(df.collect())
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return n, sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_one_student_skips_row_groups_inside_their_range(spark, tmp_path):
    # Every file's ids run from 0 to 400,000, and id 200,001 is in one file alone. No
    # dictionary: only a Bloom filter can tell.
    many = spark.range(0, 400_001, 2).select(F.col("id").alias("user_id"), F.lit(1).alias("n"))
    one = spark.createDataFrame([(200_001, 7)], "user_id long, n int")
    df = many.repartition(4).sortWithinPartitions("user_id").union(one)
    spark.conf.set("parquet.enable.dictionary", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        schema = commits.write_run(df, str(tmp_path / "m"), 1)
        plain = str(tmp_path / "plain")
        df.write.parquet(plain)
        asked = commits.read_run(spark, str(tmp_path / "m"), 1, schema).where("user_id = 200001")
        unfiltered = spark.read.schema(schema).parquet(plain).where("user_id = 200001")
        (n, read), (n_plain, read_plain) = scanned(asked), scanned(unfiltered)
    finally:
        spark.conf.unset("parquet.enable.dictionary")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert n == n_plain == 1
    assert read == 1 < 1000 < read_plain
