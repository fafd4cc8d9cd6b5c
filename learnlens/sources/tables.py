"""SRC1: the source tables as one bundle of DataFrames.

``Sources`` holds lazily-defined DataFrames; nothing is read until an action
runs, so Catalyst prunes columns and pushes the term / user filters into the
Parquet scans of whatever a query touches.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DRIVER_TERM, REFERENCE_TERM, Term
from ..functions.time import display_week, in_term, in_window, ts_literal, week_of
from . import schemas


@dataclass(frozen=True)
class Sources:
    """The six warehouse tables plus the reflection log, for one term."""

    web_logs: DataFrame          # user_id, course_id, timestamp, attachment_id [, event_id]
    quiz_submissions: DataFrame  # user_id, course_id, quiz_id, finished_at_anonymous, ...
    quizzes: DataFrame           # id, points_possible
    submissions: DataFrame       # user_id, course_id, assignment_id, submitted_at_anonymous, ...
    assignments: DataFrame       # id, points_possible
    enrollments: DataFrame       # user_id, course_id
    reflection_log: DataFrame    # user_id, course_id, week, satisfaction, expectation, ...
    term: Term = REFERENCE_TERM

    # ---------------------------------------------------------------- readers
    @classmethod
    def from_silver(cls, spark: SparkSession, root: str, reflection_log: DataFrame | None = None,
                    term: Term = REFERENCE_TERM, user_type: T.DataType = T.StringType(),
                    fmt: str = "parquet") -> "Sources":
        """Read the silver tables stored as ``<root>/<table name>`` files."""
        def read(key, schema):
            return spark.read.schema(schema).format(fmt).load(f"{root}/{schemas.SILVER_TABLES[key]}")

        log = reflection_log if reflection_log is not None else \
            spark.createDataFrame([], schemas.reflection_log(user_type))
        return cls(
            web_logs=read("web_logs", schemas.web_logs(user_type)),
            quiz_submissions=read("quiz_submissions", schemas.quiz_submissions(user_type)),
            quizzes=read("quizzes", schemas.points_dimension()),
            submissions=read("submissions", schemas.submissions(user_type)),
            assignments=read("assignments", schemas.points_dimension()),
            enrollments=read("enrollments", schemas.enrollments(user_type)),
            reflection_log=log,
            term=term,
        )

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str, reflection_log: DataFrame,
                     term: Term = REFERENCE_TERM) -> "Sources":
        """Read the silver tables from a metastore database."""
        def table(key, cols):
            return spark.table(f"{database}.{schemas.SILVER_TABLES[key]}").select(*cols)

        return cls(
            web_logs=table("web_logs", ["user_id", "course_id", "timestamp", "attachment_id"]),
            quiz_submissions=table("quiz_submissions", schemas.quiz_submissions().fieldNames()),
            quizzes=table("quizzes", ["id", "points_possible"]),
            submissions=table("submissions", schemas.submissions().fieldNames()),
            assignments=table("assignments", ["id", "points_possible"]),
            enrollments=table("enrollments", ["user_id", "course_id"]),
            reflection_log=reflection_log,
            term=term,
        )

    @classmethod
    def from_driver_tables(cls, spark: SparkSession, sf_dir: str, term: Term = DRIVER_TERM) -> "Sources":
        """Map the driver's synthetic ``events`` / ``part`` tables onto the
        source tables (the mapping is fixed in FIXTURES.md §2)."""
        events = spark.read.schema(schemas.DRIVER_EVENTS).parquet(f"{sf_dir}/events.parquet")
        part = spark.read.schema(schemas.DRIVER_PART).parquet(f"{sf_dir}/part.parquet")
        k = F.regexp_extract("props", r"([0-9]+)", 1).try_cast("bigint")
        ev = events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
        course = (F.lit(27000) + F.col("k") % F.lit(4)).cast("bigint").alias("course_id")
        score = F.when(F.col("event_id") % F.lit(11) == 0, F.lit(None).cast("double")) \
            .otherwise(F.least(F.col("value"), F.lit(50.0))).alias("score_anonymous")
        state_mod = F.col("event_id") % F.lit(4)

        web_logs = ev.select(
            "user_id", course, F.col("ts").alias("timestamp"),
            F.when(F.col("event_type") == "view", F.col("k")).alias("attachment_id"),
            "event_id",
        )
        quiz_submissions = ev.filter(F.col("event_type") == "purchase").select(
            "user_id", course, F.col("k").alias("quiz_id"),
            F.col("ts").alias("finished_at_anonymous"), score,
            F.col("value").alias("DurationInMinutes"),
            F.when(state_mod == 0, "untaken").when(state_mod == 1, "pending_review")
             .otherwise("complete").alias("workflow_state"),
        )
        submissions = ev.filter(F.col("event_type") == "signup").select(
            "user_id", course, F.col("k").alias("assignment_id"),
            F.col("ts").alias("submitted_at_anonymous"), score,
            F.when(state_mod == 0, "unsubmitted").when(state_mod == 1, "pending_review")
             .when(state_mod == 2, "graded").otherwise("submitted").alias("workflow_state"),
        )
        points = part.select(
            F.col("p_partkey").alias("id"),
            F.when(F.col("p_partkey") % F.lit(20) == 0, F.lit(None).cast("double"))
             .otherwise(F.col("p_size").cast("double")).alias("points_possible"),
        )
        enrollments = web_logs.select("user_id", "course_id").distinct()
        reflection_log = ev.filter(F.col("event_type") == "error").select(
            "user_id", course,
            display_week(week_of("ts", term), term).alias("week"),
            (F.lit(1) + F.col("event_id") % F.lit(10)).cast("int").alias("satisfaction"),
            (F.lit(1) + F.col("k") % F.lit(10)).cast("int").alias("expectation"),
            F.lit(None).cast("string").alias("feedback"),
            F.col("ts").alias("saved_at"),
            F.col("event_id").alias("seq"),
            F.lit(False).alias("deleted"),
        )
        reflection_log = in_term(reflection_log, "saved_at", term)
        return cls(web_logs, quiz_submissions, points, submissions, points, enrollments,
                   reflection_log, term)

    # ------------------------------------------------------------ restriction
    def for_user(self, user_id, course_id=None) -> "Sources":
        """FIL1: the one-student (and optionally one-course) form.

        The filter sits on top of every fact table, so Catalyst pushes the
        ``user_id`` equality into each Parquet scan.
        """
        def keep(df: DataFrame) -> DataFrame:
            cond: Column = F.col("user_id") == F.lit(user_id)
            if course_id is not None:
                cond = cond & (F.col("course_id") == F.lit(course_id))
            return df.filter(cond)

        return replace(
            self,
            web_logs=keep(self.web_logs),
            quiz_submissions=keep(self.quiz_submissions),
            submissions=keep(self.submissions),
            enrollments=keep(self.enrollments),
            reflection_log=keep(self.reflection_log),
        )

    def as_of(self, cutoff: datetime) -> "Sources":
        """Every table as it stood just before ``cutoff`` (event time)."""
        def before(df: DataFrame, col: str) -> DataFrame:
            return df.filter(F.col(col) < ts_literal(df, col, cutoff))

        return replace(
            self,
            web_logs=before(self.web_logs, "timestamp"),
            quiz_submissions=before(self.quiz_submissions, "finished_at_anonymous"),
            submissions=before(self.submissions, "submitted_at_anonymous"),
            reflection_log=before(self.reflection_log, "saved_at"),
        )

    # ------------------------------------------------------- term-bound facts
    def web_logs_in_term(self) -> DataFrame:
        return in_term(self.web_logs, "timestamp", self.term)

    def quiz_submissions_in_term(self) -> DataFrame:
        return in_term(self.quiz_submissions, "finished_at_anonymous", self.term)

    def submissions_in_term(self) -> DataFrame:
        return in_term(self.submissions, "submitted_at_anonymous", self.term)

    def web_logs_between(self, start: datetime, end: datetime, inclusive_end=False) -> DataFrame:
        return in_window(self.web_logs, "timestamp", start, end, inclusive_end)
