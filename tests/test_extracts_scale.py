"""Extract marts (mart-form = direct-form), extract ages, the metamorphic
one-student form, the skew-safe row number and the plans' scale properties."""

from __future__ import annotations

import os
import random
import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from conftest import SF0001, rows
from learnlens.config import DRIVER_TERM
from learnlens.operators import daily, ordering, progress, summary
from learnlens.plans import catalogue
from learnlens.plans.queries import sources
from learnlens.sources.extracts import Extract, extract_ages, write_extract


@pytest.fixture(scope="module")
def extract_root(spark):
    root = tempfile.mkdtemp(prefix="learnlens-extract-")
    write_extract(sources(spark, SF0001), root)
    return root


def test_mart_form_equals_direct_form(spark, extract_root):
    src = sources(spark, SF0001)
    ex = Extract.read(spark, extract_root, DRIVER_TERM)
    for name in daily.DAILY_METRICS:
        direct = rows(daily.daily_metric(src, name), "user_id", "course_id", "day", "value")
        mart = rows(ex.daily(name), "user_id", "course_id", "day", "value")
        if daily.DAILY_METRICS[name].dtype == "double":
            direct = [(*r[:3], round(r[3], 9)) for r in direct]
            mart = [(*r[:3], round(r[3], 9)) for r in mart]
        assert mart == direct, name
    assert rows(ex.submitted_weeks("quiz")) == rows(progress.quiz_weeks(src))
    assert rows(ex.submitted_weeks("assignment")) == rows(progress.assignment_weeks(src))


def test_one_student_extract_read_is_pruned(spark, extract_root):
    ex = Extract.read(spark, extract_root, DRIVER_TERM)
    uid = ex.courses.first().user_id
    one = ex.for_user(uid).daily("daily_interactions")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id," in plan
    assert one.select("user_id").distinct().count() == 1


def test_extract_ages(spark, extract_root):
    files = [os.path.join(dp, f) for dp, _, fs in os.walk(os.path.join(extract_root, "courses"))
             for f in fs if f.endswith(".parquet")]
    newest = datetime.fromtimestamp(max(os.path.getmtime(f) for f in files), timezone.utc).replace(tzinfo=None)
    users = spark.createDataFrame([(-1,)], "user_id bigint")
    some = sources(spark, SF0001).enrollments.select("user_id").limit(1)
    requested = users.unionByName(some)
    for days, label in ((0.5, "today"), (1, "1 days ago"), (6.9, "6 days ago"), (7, "1+ week ago")):
        now = newest + timedelta(days=days, seconds=1 if days == 7 else 0)
        got = {r.user_id: (r.age, r.fresh) for r in extract_ages(spark, extract_root, now, requested).collect()}
        assert got[-1] == ("missing", False)
        ((_, (age, fresh)),) = [(k, v) for k, v in got.items() if k != -1]
        assert age == label and fresh == (days < 7), days


def test_one_student_form_equals_filter(spark):
    src = sources(spark, SF0001)
    uid, cid = src.enrollments.orderBy("user_id", "course_id").first()
    for data_type, metric_name in (("Web Activities", "Daily Web Activity"),
                                   ("Quizzes", "Avg Quiz Score"),
                                   ("Web Activities", "Weekly Time Summary")):
        one = catalogue.metric(src.for_user(uid, cid), data_type, metric_name, week=2)
        every = catalogue.metric(src, data_type, metric_name).filter(
            (F.col("user_id") == uid) & (F.col("course_id") == cid) & (F.col("week") == 2))
        assert rows(one) == rows(every), metric_name
    chart = catalogue.metric(src, "Files", "File Accesses", user_id=uid, course_id=cid, week=3)
    assert chart.count() == 7
    assert catalogue.label("Quizzes", "Max Quiz Score") == "Max Quiz Score (%)"


def test_user_filter_reaches_the_scan(spark, capsys):
    src = sources(spark, SF0001)
    uid = src.enrollments.first().user_id
    summary.weekly_summary(src.for_user(uid)).explain(mode="formatted")
    plan = capsys.readouterr().out
    scans = [line for line in plan.splitlines() if line.startswith("PushedFilters")]
    assert scans and all(f"EqualTo(user_id,{uid})" in line for line in scans)
    # the web-log scan reads only the three columns the summary needs
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,props:string>" in plan


def test_row_number_on_skewed_key_matches_brute_force(spark):
    rng = random.Random(7)
    base = datetime(2024, 11, 11)
    data = []
    for i in range(3000):
        hot = i % 3 == 0                                   # one key holds a third of all rows
        key = ("hot", 1) if hot else (f"u{rng.randrange(50)}", rng.randrange(3))
        data.append((key[0], key[1], base + timedelta(seconds=rng.randrange(5000)), i))
    df = spark.createDataFrame(data, "user_id string, course_id int, ts timestamp_ntz, event_id long")
    got = ordering.row_number_within(df, ["user_id", "course_id"], ["ts", "event_id"])
    got = {r.event_id: r.seq_num for r in got.collect()}
    expect = {}
    by_key: dict = {}
    for u, c, t, e in data:
        by_key.setdefault((u, c), []).append((t, e))
    for items in by_key.values():
        for n, (_, e) in enumerate(sorted(items), start=1):
            expect[e] = n
    assert got == expect


def test_calendar_aggregate_has_one_shuffle_for_the_grid(spark):
    src = sources(spark, SF0001)
    plan = daily.daily_metric(src, "daily_interactions")._jdf.queryExecution().executedPlan().toString()
    # enrolments distinct + the union-aggregate; no sort-merge join for the fill
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    assert plan.count("Exchange hashpartitioning") == 2


# Shuffles of rows that are not partial aggregates, allowed on purpose:
# the user-scope join moves one row per (student, block); the skew-safe row
# number moves raw rows by (key, slice) and a per-(key, slice) offsets table;
# documents are joined to one row per enrolled student to restore their ids,
# and a requested list of students to their newest entries; elements of extract
# documents are kept if their document is the student's newest.
RAW_SHUFFLE_ALLOWED = {"block_progress_user_scope", "daily_row_number", "daily_row_number_files",
                       "ordered_interactions", "reflection_documents", "extract_ages",
                       "documents_courses", "documents_quiz_data", "documents_assignment_data",
                       "documents_web_activity", "documents_file_access"}


def test_every_shuffle_is_pre_aggregated(spark):
    import re

    from learnlens.plans import queries
    offenders = {}
    for name, query in queries.registered().items():
        lines = query(spark, SF0001)._jdf.queryExecution().executedPlan().treeString().splitlines()
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning" in line:
                child = lines[i + 1] if i + 1 < len(lines) else ""
                if not (re.search(r"Aggregate\(.*partial_", child) or "functions=[]" in child):
                    offenders.setdefault(name, []).append(child.strip()[:80])
    assert set(offenders) <= RAW_SHUFFLE_ALLOWED, offenders


def test_json_extract_has_the_same_rows(spark, extract_root):
    root = tempfile.mkdtemp(prefix="learnlens-extract-json-")
    write_extract(sources(spark, SF0001), root, fmt="json")
    json, parquet = Extract.read(spark, root, DRIVER_TERM, fmt="json"), Extract.read(spark, extract_root, DRIVER_TERM)
    live = Extract.live(sources(spark, SF0001))
    for mart in ("courses", "quiz_data", "assignment_data", "web_activity_data", "file_access_data"):
        got, want = getattr(json, mart), getattr(parquet, mart)
        cols = getattr(live, mart).columns
        assert rows(got, *cols) == rows(want, *cols), mart
        kinds = dict(getattr(live, mart).dtypes)
        assert {c: k for c, k in got.dtypes if c in kinds} == {c: k for c, k in want.dtypes if c in kinds} == kinds
    from learnlens.sources.extracts import QUERY_TYPES, query
    for kind in QUERY_TYPES:
        assert rows(query(json, kind)) == rows(query(parquet, kind)), kind


def test_a_retried_run_and_an_empty_log(spark):
    src = sources(spark, SF0001)
    root = tempfile.mkdtemp(prefix="learnlens-extract-retry-")
    for _ in range(2):
        write_extract(src, root, run_id=7)
    assert Extract.read(spark, root, DRIVER_TERM).courses.count() == src.enrollments.count()
    from dataclasses import replace
    quiet = replace(src, web_logs=src.web_logs.limit(0))
    write_extract(quiet, root, run_id=8)
    ex = Extract.read(spark, root, DRIVER_TERM)
    assert ex.web_activity_data.count() == ex.file_access_data.count() == 0 and ex.quiz_data.count() > 0


def test_one_hot_student_is_split_over_files(spark):
    from conftest import make_sources
    base = datetime(2024, 11, 11)
    quiz = [("u1", 28301, i % 50, base + timedelta(minutes=i), 1.0, 1.0, "complete") for i in range(4000)]
    src = make_sources(spark, quiz=quiz, quizzes=[(i, 2.0) for i in range(50)], enrollments=[("u1", 28301)])
    root = tempfile.mkdtemp(prefix="learnlens-extract-hot-")
    run = write_extract(src, root, partitions=8)
    files = spark.read.parquet(f"{root}/quiz_data/run_id={run}").select(F.input_file_name().alias("f")).distinct()
    assert files.count() > 4


def test_row_number_with_more_columns_and_without_exchange_reuse(spark):
    """400,000 rows over several files, one key with a third of them."""
    from pyspark.sql import Window
    path = tempfile.mkdtemp(prefix="learnlens-rows-") + "/t"
    base = "timestamp_ntz'2024-11-11 00:00:00'"
    spark.range(400_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.hash("id") % 500).alias("k"), F.col("id").alias("event_id"),
        F.expr(f"{base} + make_interval(0, 0, 0, 0, 0, 0, abs(hash(id, 1)) % 600000)").alias("ts"),
        F.concat(F.lit("payload "), "id").alias("payload")).repartition(6).write.parquet(path)
    df = spark.read.parquet(path)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("ts", "event_id")))
    reuse = spark.conf.get("spark.sql.exchange.reuse", "true")
    try:
        for on in ("true", "false"):
            spark.conf.set("spark.sql.exchange.reuse", on)
            for cols in (["k", "ts", "event_id"], ["k", "ts", "event_id", "payload"]):
                got = ordering.row_number_within(df.select(*cols), ["k"], ["ts", "event_id"], "n")
                both = got.select("event_id", F.col("n").alias("a")).join(want.select("event_id", F.col("n").alias("b")), "event_id")
                assert both.where("a = b").count() == 400_000 == got.count()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)


def test_catalogue_user_filter_reaches_every_event_scan(spark):
    """The chart request filters the all-students plan; Catalyst must push the
    student equality through the HAVING, the aggregates, the union and the
    grid's explode into every scan of the events table."""
    src = sources(spark, SF0001)
    uid = src.enrollments.first().user_id
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for spec in catalogue.CATALOGUE:
        df = catalogue.metric(src, spec.data_type, spec.metric, user_id=uid, week=2)
        lines = df._jdf.queryExecution().explainString(mode).splitlines()
        event_scans = [lines[i + 1] for i, line in enumerate(lines)
                       if line.startswith("Location") and "events.parquet" in line]
        assert event_scans, spec.metric
        assert all(f"EqualTo(user_id,{uid})" in s for s in event_scans), spec.metric


def test_extract_query_types(spark, extract_root):
    from datetime import date

    from learnlens.sources.extracts import QUERY_TYPES, query
    ex = Extract.read(spark, extract_root, DRIVER_TERM)
    uid, cid = ex.courses.orderBy("user_id", "course_id").first()
    start, end = date(2024, 1, 8), date(2024, 1, 14)
    for qt in QUERY_TYPES:
        df = query(ex, qt, user_id=uid, course_id=cid, start=start if "weeks" not in qt else 1,
                   end=end if "weeks" not in qt else 2)
        if qt in ("courses",):
            assert df.count() == 1
        elif "weeks" in qt:
            assert all(1 <= r.week <= 2 for r in df.collect())
        else:
            got = sorted(r.day for r in df.collect())
            assert got == [date(2024, 1, d) for d in range(8, 15)], qt   # seven filled days
    uniq = query(ex, "file_access", metric="unique_files").agg(F.sum("value")).first()[0]
    acc = query(ex, "file_access").agg(F.sum("value")).first()[0]
    assert 0 < uniq <= acc
