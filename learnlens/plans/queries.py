"""Registered queries: name -> (spark, sf_dir) -> DataFrame over the driver's
tables, and the DuckDB twin of each.

Sources are plans over the files as they are when a query is built; nothing is
kept between queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DRIVER_TERM, LONG_TERM, SHORT_PICK_TERM, Term
from ..functions.scores import round_half_even
from ..functions.text import is_blank, storage_key
from ..functions.time import day_of, display_week, week_end_date, week_of, week_start_date
from ..operators import badges, calendar, courses, daily, distinct, ordering, progress, reflections, scores, summary
from ..session import shared_folder
from ..sources import documents, extracts
from ..sources import reflections as reflection_log
from ..sources.schemas import SILVER_TABLES
from ..sources.tables import Sources
from . import bucketed, catalogue, incremental
from . import oracle_sql as sql

Query = Callable[[SparkSession, str], DataFrame]

# The completion change feed compares the state after week 2 with now.
COMPLETION_CUTOFF = datetime.combine(DRIVER_TERM.week_start(3), datetime.min.time())
# The clock of the extract's ages, the days and weeks of ranged requests, and
# the student of the one-student form.
AGE_CLOCK = datetime(2024, 1, 31, 12)
DAYS = (date(2024, 1, 5), date(2024, 1, 19))
WEEKS = (2, 3)
STUDENT = 8
# Weeks of the long term, as minutes of the driver's month.
LONG_WEEK_MINUTES = 90


def sources(spark: SparkSession, sf_dir: str, term: Term = DRIVER_TERM) -> Sources:
    """The driver's tables mapped to the source tables."""
    return Sources.from_driver_tables(spark, sf_dir, term)


def _on(fn: Callable[[Sources], DataFrame], term: Term = DRIVER_TERM) -> Query:
    return lambda spark, d: fn(sources(spark, d, term))


def _daily_name(metric: str) -> str:
    return metric if metric.startswith("daily_") else f"daily_{metric}"


def _row_numbers(*more: str) -> Callable[[Sources], DataFrame]:
    def run(src: Sources) -> DataFrame:
        logs = src.web_logs_in_term().select(
            "user_id", "course_id", day_of("timestamp").alias("day"), "timestamp", "event_id", *more)
        return ordering.row_number_within(logs, ["user_id", "course_id", "day"], ["timestamp", "event_id"])
    return run


def _sentence(src: Sources) -> DataFrame:
    """The card's sentence: engagement, interactions, mean a day without decimals."""
    w = summary.weekly_summary(src)
    mean = round_half_even("avg_daily_interactions", 0).cast("int")
    return w.select("user_id", "course_id", "week", F.format_string(
        "%s Engagement • %d interactions • Avg: %d/day", "engagement", "total_interactions", mean).alias("sentence"))


def _known(src: Sources) -> Sources:
    """Three of the four courses under ids that the dashboard knows."""
    c = F.col("course_id")
    to = F.when(c == 27000, 27886).when(c == 27001, 28301).when(c == 27002, 27893).otherwise(c).cast("bigint")
    return replace(src, enrollments=src.enrollments.withColumn("course_id", to))


def _display_weeks(src: Sources) -> DataFrame:
    """Interactions by the week they are shown under."""
    raw = week_of("timestamp", src.term)
    return src.web_logs_in_term().groupBy(display_week(raw, src.term).alias("display_week")).agg(
        F.count(F.lit(1)).alias("interactions"), F.min(raw).alias("first_week"), F.max(raw).alias("last_week"))


def _week_dates(src: Sources) -> DataFrame:
    grid = calendar.enrolled_weeks(src.enrollments, src.term)
    return grid.withColumns({"week_start": week_start_date("week", src.term), "week_end": week_end_date("week", src.term)})


def _after_deletes(src: Sources) -> DataFrame:
    """Current reflections where every fifth log entry is a deletion."""
    log = src.reflection_log.withColumn("deleted", F.col("seq") % 5 == 0)
    return reflections.reflections(replace(src, reflection_log=log)).drop("feedback")


def _documents(src: Sources) -> DataFrame:
    """Log entries as JSON documents under storage keys, parsed back, with the
    ids that the keys stand for restored from the enrolments."""
    user = F.concat(F.col("user_id").cast("string"), F.lit("@uni.nl"))
    record = F.struct("satisfaction", "expectation", F.concat(F.lit("note "), "seq").alias("feedback"),
                      F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss").alias("saved_at"),
                      (F.col("seq") % 5 != 0).alias("reflection_saved"))
    weeks = F.create_map(F.col("week").cast("string"), record)
    docs = src.reflection_log.select(
        F.to_json(F.create_map(F.col("course_id").cast("string"), weeks)).alias("value"),
        F.concat(F.lit("reflections_"), storage_key(user), F.lit(".json")).alias("file"))
    enrolled = src.enrollments.select(user.alias("user_id"), "course_id")
    return reflection_log.restore_user_ids(reflection_log.parse_reflection_documents(docs), enrolled).drop("seq")


def _ages(spark: SparkSession, d: str) -> DataFrame:
    """Ages of the students' data on a fixed clock, for all customers."""
    wanted = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    cached = sources(spark, d).web_logs.select("user_id", F.col("timestamp").alias("cached_at"))
    return extracts.ages(cached, AGE_CLOCK, wanted)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    text = F.when(F.col("c_custkey") % 3 == 0, F.lit("   ")).when(F.col("c_custkey") % 3 == 1, F.lit("")).otherwise(
        F.concat(F.lit("  "), "c_name"))
    return c.select("c_custkey", storage_key(F.concat("c_name", F.lit(" / é@"), "c_mktsegment")).alias("file_label"),
                    is_blank(text).alias("blank"), F.trim(text).alias("trimmed"))


def _ordered(src: Sources) -> DataFrame:
    """The chart order with each row's place in its student's and course's series."""
    rows = catalogue.metric(src, "Web Activities", "Daily Web Activity")
    return ordering.in_order(rows, ["user_id", "course_id"], ["week", "day"])


def _stored_ages(spark: SparkSession, d: str) -> DataFrame:
    """Ages of a written extract, by its files, three days from now, for all customers."""
    src = sources(spark, d)
    root = f"{shared_folder(spark)}/extract-{uuid.uuid4().hex}"
    extracts.write_extract(src, root)
    wanted = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    later = datetime.now(timezone.utc).replace(tzinfo=None) + timedelta(days=3, hours=1)
    return extracts.extract_ages(spark, root, later, wanted).select("user_id", "age", "fresh", "file_label")


def _stored_answer(query_type: str, span: tuple | None) -> Query:
    """An answer from a written extract, read back."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        src = sources(spark, d)
        root = f"{shared_folder(spark)}/extract-{uuid.uuid4().hex}"
        extracts.write_extract(src, root)
        start, end = span or (None, None)
        return extracts.query(extracts.Extract.read(spark, root, src.term), query_type, start=start, end=end)
    return run


def _answer(query_type: str, span: tuple | None) -> Callable[[Sources], DataFrame]:
    def run(src: Sources) -> DataFrame:
        start, end = span or (None, None)
        return extracts.query(extracts.Extract.live(src), query_type, start=start, end=end)
    return run


def _extract(name: str) -> Callable[[Sources], DataFrame]:
    return lambda src: extracts.extract_frames(src)[name]


def _long_log(src: Sources) -> Sources:
    """The click log as reflections of 20 students over a term of 200 weeks, an hour
    and a half each: long runs with gaps."""
    user = (F.col("user_id") % 20).alias("user_id")
    start = F.lit(src.term.start).cast("timestamp_ntz")
    week = F.floor(F.timestamp_diff("MINUTE", start, F.col("timestamp")) / F.lit(LONG_WEEK_MINUTES)) + 1
    log = src.web_logs.select(user, "course_id", week.cast("bigint").alias("week"), F.lit(5).alias("satisfaction"),
                              F.lit(5).alias("expectation"), F.lit(None).cast("string").alias("feedback"),
                              F.col("timestamp").alias("saved_at"), F.col("event_id").alias("seq"), F.lit(False).alias("deleted"))
    return replace(src, reflection_log=log, enrollments=src.enrollments.select(user, "course_id").distinct())


def _merged_days(src: Sources) -> DataFrame:
    """The daily mart from the merged day marts of four parts of the click log."""
    logs = src.web_logs
    part = F.pmod(F.col("event_id"), F.lit(4))
    marts = [distinct.click_days(replace(src, web_logs=logs.where(part == i))) for i in range(4)]
    return distinct.daily_web_activity(distinct.merged(marts[0].union(marts[1]).union(marts[2]).union(marts[3])))


def _bucketed(answer: Callable[[bucketed.Bucketed], DataFrame]) -> Query:
    """``answer`` from bucketed marts, written and read back."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        src = sources(spark, d)
        root = f"{shared_folder(spark)}/bucketed-{uuid.uuid4().hex}"
        bucketed.write_marts(src, root, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return answer(bucketed.Bucketed.read(spark, root, src.term))
    return run


def _folded(answer: Callable[[incremental.Marts], DataFrame]) -> Query:
    """``answer`` from marts that were refreshed twice: the events, written as silver
    tables, come in two lots, and the second holds rows of every day of the term."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        src = sources(spark, d)
        root = f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
        user = src.enrollments.schema["user_id"].dataType

        def write(table: str, df: DataFrame) -> None:
            df.write.mode("append").parquet(f"{root}/silver/{SILVER_TABLES[table]}")

        for table in ("quizzes", "assignments", "enrollments"):
            write(table, getattr(src, table))
        for second in (False, True):
            for table, time in (("web_logs", "timestamp"), ("quiz_submissions", "finished_at_anonymous"),
                                ("submissions", "submitted_at_anonymous")):
                late = F.pmod(F.xxhash64("user_id", time), F.lit(100)) == 0
                write(table, getattr(src, table).where(late == F.lit(second)))
            marts = incremental.Marts.over(spark, f"{root}/silver", f"{root}/marts", src.term, src.reflection_log, user)
            marts.refresh()
        return answer(marts)
    return run


def _extract_texts(src: Sources) -> DataFrame:
    """The extract as (file, value) documents: one per row of it, as parts of one
    extract. Courses are a single value or an array, ids are numbers or texts, missing
    values are left out or ``NA``. An older document of every fourth course and
    two unreadable ones a course are added."""
    frames = extracts.extract_frames(src)
    odd = F.pmod(F.xxhash64(F.col("user_id"), F.col("course_id")), F.lit(2)) == 1
    user = F.col("user_id").cast("string")

    def text(df: DataFrame, kind: str, cached_at: str, **datasets: Column) -> DataFrame:
        def doc(*ids: Column) -> Column:
            return F.to_json(F.struct(*ids, F.lit(cached_at).alias("cached_at"), *[
                datasets.get(m, F.array().cast("array<string>")).alias(m) for m in documents.FIELDS]))
        value = F.when(odd, doc(F.col("user_id"), F.col("course_id").alias("courses"))).otherwise(
            doc(user.alias("user_id"), F.array(F.col("course_id").cast("string")).alias("courses")))
        return df.select(F.concat(F.lit(f"cached_data_{kind}_"), user, F.lit(".json")).alias("file"), value.alias("value"))

    def record(m: str) -> Column:
        cols = []
        for name, dtype in documents.FIELDS[m].items():
            c = F.col(name)
            if dtype == "timestamp_ntz":
                c = F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
            elif name == "score_anonymous":  # a text where it is missing, and for odd courses
                c = F.coalesce(c.cast("string"), F.lit("NA")) if m == "quiz_data" else c
            cols.append(c.alias(name))
        return F.array(F.struct(*cols))

    now = "2024-02-01 08:00:00"
    out = text(frames["courses"], "courses", now)
    for m in documents.FIELDS:
        out = out.union(text(frames[m], m, now, **{m: record(m)}))
    courses_ = frames["courses"]
    stale = F.array(F.struct("course_id", F.lit("2024-01-02 00:00:00").alias("finished_at_anonymous")))
    out = out.union(text(courses_.where("course_id % 4 = 0"), "old", "2024-01-31 08:00:00", quiz_data=stale))
    file = F.concat(F.lit("cached_data_"), user, F.lit(".json"))
    return out.union(courses_.select(file, F.concat(F.lit('{"user_id": "'), user, F.lit('", "courses": [')))) \
        .union(courses_.select(file, F.concat(F.lit('{"user_id": '), user, F.lit(', "courses": 1, "quiz_data": 7}'))))


def _documents_mart(name: str) -> Callable[[Sources], DataFrame]:
    def run(src: Sources) -> DataFrame:
        rows = documents.staged(_extract_texts(src), src.enrollments.schema["user_id"].dataType)
        return documents.marts(rows, src.term)[name].drop("cached_at")
    return run


def _documents_rejects(src: Sources) -> DataFrame:
    rows = documents.staged(_extract_texts(src), src.enrollments.schema["user_id"].dataType)
    return documents.rejects(rows).groupBy("part", "reason").agg(F.count("*").alias("documents"))


# name -> (plan over Sources, DuckDB SQL or None)
def _catalogue() -> dict[str, tuple[Callable[[Sources], DataFrame], str | None]]:
    c: dict[str, tuple[Callable[[Sources], DataFrame], str | None]] = {
        "weekly_summary": (summary.weekly_summary, sql.weekly_summary_sql()),
        "daily_web_activity": (daily.daily_web_activity, sql.daily_web_activity_sql()),
        "daily_metrics": (daily.daily_metrics_wide, sql.daily_metrics_sql()),
        "no_activity_weeks": (daily.no_activity_weeks, sql.no_activity_weeks_sql(list(daily.DAILY_METRICS))),
        "weekly_quiz_minutes": (summary.weekly_quiz_minutes, sql.weekly_quiz_minutes_sql()),
        "daily_quiz_scores": (lambda s: scores.daily_scores(s, "quiz"), sql.daily_scores_sql("quiz")),
        "daily_assignment_scores": (lambda s: scores.daily_scores(s, "assignment"),
                                    sql.daily_scores_sql("assignment")),
        "weekly_quiz_scores": (lambda s: scores.weekly_scores(s, "quiz"), sql.weekly_scores_sql("quiz")),
        "weekly_assignment_scores": (lambda s: scores.weekly_scores(s, "assignment"),
                                     sql.weekly_scores_sql("assignment")),
        "enrollments": (courses.enrollments, sql.enrollments_sql()),
        "course_labels": (courses.course_labels, sql.course_labels_sql()),
        "quiz_weeks": (progress.quiz_weeks, sql.quiz_weeks_sql()),
        "assignment_weeks": (progress.assignment_weeks, sql.assignment_weeks_sql()),
        "activity_grid": (progress.activity_grid, sql.activity_grid_sql()),
        "block_progress": (progress.block_progress, sql.block_progress_sql()),
        "weekly_summary_calendar_mean": (lambda s: summary.weekly_summary(s, mean="calendar"),
                                         sql.weekly_summary_sql(mean="calendar")),
        "weekly_summary_closed_weeks": (lambda s: summary.weekly_summary(s, inclusive_end=True),
                                        sql.weekly_summary_sql(inclusive_end=True)),
        "daily_quiz_scores_null_zeroes_day": (lambda s: scores.daily_scores(s, "quiz", null_day="zero_day"),
                                              sql.daily_scores_sql("quiz", null_day="zero_day")),
        "block_progress_user_scope": (lambda s: progress.block_progress(s, scope="user"),
                                      sql.block_progress_sql(scope="user")),
        "completion_changes": (lambda s: progress.completion_flips(s, COMPLETION_CUTOFF),
                               sql.completion_changes_sql(COMPLETION_CUTOFF.isoformat(sep=" "))),
        "reflections": (lambda s: reflections.reflections(s).drop("feedback"), sql.reflections_sql()),
        "reflection_feedback": (reflections.reflection_feedback, sql.reflection_feedback_sql()),
        "reflection_categories": (reflections.reflection_categories, sql.reflection_categories_sql()),
        "reflections_per_week": (reflections.reflections_per_week, sql.reflections_per_week_sql()),
        "reflection_counts": (reflections.reflection_counts, sql.reflection_counts_sql()),
        "reflection_streaks": (reflections.reflection_streaks, sql.reflection_streaks_sql()),
        "badges": (badges.badges, sql.badges_sql()),
        "daily_row_number": (_row_numbers(), sql.daily_row_number_sql()),
        "daily_row_number_files": (_row_numbers("attachment_id"), sql.daily_row_number_sql(", attachment_id")),
        "weekly_distinct_files": (lambda s: distinct.weekly_files(distinct.click_days(s)),
                                  sql.distinct_files_sql("user_id, course_id, week")),
        "block_distinct_files": (lambda s: distinct.block_files(distinct.click_days(s)),
                                 sql.distinct_files_sql("user_id, course_id, (week - 1) // 2 * 2 + 1 AS block_start")),
        "course_week_distinct_files": (lambda s: distinct.course_week_files(distinct.click_days(s)),
                                       sql.distinct_files_sql("course_id, week")),
        "distinct_files_between": (lambda s: distinct.files_between(distinct.click_days(s), *DAYS),
                                   sql.distinct_files_sql("user_id, course_id", DAYS)),
        "daily_web_activity_merged": (_merged_days, sql.daily_web_activity_sql()),
        "documents_courses": (_documents_mart("courses"), sql.enrollments_sql()),
        "documents_quiz_data": (_documents_mart("quiz_data"), sql.extract_quiz_data_sql()),
        "documents_assignment_data": (_documents_mart("assignment_data"), sql.extract_assignment_data_sql()),
        "documents_web_activity": (_documents_mart("web_activity_data"), sql.extract_web_activity_sql()),
        "documents_file_access": (_documents_mart("file_access_data"), sql.extract_file_access_sql()),
        "documents_rejects": (_documents_rejects, sql.documents_rejects_sql()),
        "extract_quiz_data": (_extract("quiz_data"), sql.extract_quiz_data_sql()),
        "extract_assignment_data": (_extract("assignment_data"), sql.extract_assignment_data_sql()),
        "extract_web_activity": (_extract("web_activity_data"), sql.extract_web_activity_sql()),
        "extract_file_access": (_extract("file_access_data"), sql.extract_file_access_sql()),
    }
    for metric in daily.DAILY_METRICS:
        c[_daily_name(metric)] = (lambda s, m=metric: daily.daily_metric(s, m),
                                  sql.daily_metric_sql(metric))
    c |= {
        "weekly_sentence": (_sentence, sql.weekly_sentence_sql()),
        "week_dates": (_week_dates, sql.week_dates_sql()),
        "reflections_after_deletes": (_after_deletes, sql.reflections_after_deletes_sql()),
        "reflection_documents": (_documents, sql.reflection_documents_sql()),
        "ordered_interactions": (_ordered, sql.ordered_interactions_sql()),
        "catalogue_weeks": (catalogue.weekly_values, sql.catalogue_weeks_sql()),
        "known_courses": (lambda s: courses.known_courses(_known(s)), sql.known_courses_sql()),
        "known_course_labels": (lambda s: courses.course_labels(_known(s)), sql.known_course_labels_sql()),
        "student_interactions": (lambda s: catalogue.metric(s, "Web Activities", "Daily Web Activity", user_id=STUDENT),
                                 sql.student_interactions_sql(STUDENT)),
    }
    for kind in extracts.QUERY_TYPES:
        span = None if kind == "courses" else WEEKS if kind.endswith("_weeks") else DAYS
        c[f"answer_{kind}"] = (_answer(kind, span), sql.answer_sql(kind, span))
    return c


#: Terms in which more weeks lie than can be picked: grids go on, the pick stops.
_SHORT_PICK = {
    "weekly_summary_long_term": (summary.weekly_summary, sql.weekly_summary_sql(term=SHORT_PICK_TERM)),
    "daily_metrics_long_term": (daily.daily_metrics_wide, sql.daily_metrics_sql(SHORT_PICK_TERM)),
    "reflection_streaks_long_term": (reflections.reflection_streaks, sql.reflection_streaks_sql(SHORT_PICK_TERM)),
    "display_weeks": (_display_weeks, sql.display_weeks_sql(SHORT_PICK_TERM)),
}
_LONG = {
    "reflection_streaks_200_weeks": (lambda s: reflections.reflection_streaks(_long_log(s)),
                                     sql.long_streaks_sql(LONG_WEEK_MINUTES, LONG_TERM)),
}
_ON_TABLES = {
    "bucketed_weekly_summary": (_bucketed(lambda b: b.weekly_summary()), sql.weekly_summary_sql()),
    "bucketed_daily_interactions": (_bucketed(lambda b: b.daily_interactions()), sql.daily_metric_sql("daily_interactions")),
    "bucketed_block_progress": (_bucketed(lambda b: b.block_progress()), sql.block_progress_sql()),
    "bucketed_badges": (_bucketed(lambda b: b.badges()), sql.badges_sql()),
    "incremental_web_activity": (_folded(lambda m: distinct.daily_web_activity(m.clicks.read())),
                                 sql.daily_web_activity_sql()),
    "incremental_quiz_data": (_folded(lambda m: m.extract().quiz_data), sql.extract_quiz_data_sql()),
    "incremental_completion": (_folded(lambda m: m.completion()), sql.completion_sql()),
    "extract_ages_stored": (_stored_ages, sql.stored_ages_sql()),
    "stored_quiz_scores": (_stored_answer("quiz_scores", DAYS), sql.answer_sql("quiz_scores", DAYS)),
    "stored_file_access": (_stored_answer("file_access", DAYS), sql.answer_sql("file_access", DAYS)),
    "extract_ages": (_ages, sql.extract_ages_sql(AGE_CLOCK)),
    "storage_labels": (_labels, sql.storage_labels_sql()),
}


def registered() -> dict[str, Query]:
    return ({name: _on(fn) for name, (fn, _) in _catalogue().items()}
            | {name: _on(fn, SHORT_PICK_TERM) for name, (fn, _) in _SHORT_PICK.items()}
            | {name: _on(fn, LONG_TERM) for name, (fn, _) in _LONG.items()}
            | {name: fn for name, (fn, _) in _ON_TABLES.items()})


def oracle() -> dict[str, str]:
    return {name: q for name, (_, q) in (_catalogue() | _SHORT_PICK | _LONG | _ON_TABLES).items() if q is not None}
