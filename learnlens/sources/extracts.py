"""User extracts: SNK1 (write), SRC2 (answer metrics from them), SRC3 (age).

The reference downloads one student at a time into a JSON file. Here one
job writes the five datasets for every student as Parquet marts (or JSON
lines), range partitioned on (course_id, user_id, time) and sorted likewise,
so a one-student read skips row groups by their user_id statistics. No
per-student document is ever assembled, and the time in the range keys splits
a student with a huge history over several tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ASSIGNMENT_ACCEPTED_STATES, QUIZ_ACCEPTED_STATES, Term
from ..functions import exactsum
from ..functions.scores import measure, percent_score
from ..functions.text import storage_key
from ..functions.time import day_of, week_of
from . import commits
from .tables import Sources

MARTS = ("courses", "quiz_data", "assignment_data", "web_activity_data", "file_access_data")


def extract_frames(src: Sources) -> dict[str, DataFrame]:
    """The five extract datasets for all students (keys first)."""
    term = src.term
    quiz = with_points(src.quiz_submissions_in_term(), src, "quiz")
    asg = with_points(src.submissions_in_term(), src, "assignment")
    logs = src.web_logs_in_term()
    web = logs.groupBy("user_id", "course_id", day_of("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("interactions"),
        F.min("timestamp").alias("first_activity"),
        F.max("timestamp").alias("last_activity"),
    ).withColumn("week", week_of("day", term))
    files = logs.filter(F.col("attachment_id").isNotNull()) \
        .groupBy("user_id", "course_id", day_of("timestamp").alias("day")).agg(
            F.count(F.lit(1)).alias("file_accesses"),
            F.count_distinct("attachment_id").alias("unique_files"),
        ).withColumn("week", week_of("day", term))
    courses = src.enrollments.select("user_id", "course_id").distinct()
    return {"courses": courses, "quiz_data": quiz, "assignment_data": asg,
            "web_activity_data": web, "file_access_data": files}


def with_points(submissions: DataFrame, src: Sources, kind: str) -> DataFrame:
    """JOI1/JOI2: the extract's quiz or assignment rows from the term's submissions."""
    from ..operators.joins import lookup_join  # avoid import cycle
    if kind == "quiz":
        key, time, points, more = "quiz_id", "finished_at_anonymous", src.quizzes, ("DurationInMinutes",)
    else:
        key, time, points, more = "assignment_id", "submitted_at_anonymous", src.assignments, ()
    return lookup_join(submissions, points, key, "id").select(
        "user_id", "course_id", key, time, "score_anonymous", *more, "workflow_state", "points_possible",
        week_of(time, src.term).alias("week"))


def write_extract(src: Sources, root: str, partitions: int | None = None,
                  fmt: str = "parquet", run_id: int | None = None) -> int:
    """SNK1 for everyone: one mart per dataset under ``root``; returns the run id.

    Each run appends its own ``run_id`` partition and is committed only after
    all five marts are written (:mod:`learnlens.sources.commits`), so readers
    never see a half-written extract and nothing is overwritten in place.
    The click log is read once: the web-activity mart also carries the
    file columns, and the file-access mart is derived from the written rows.
    ``fmt="json"`` writes the same rows as JSON lines (the reference's
    interchange format), one flat record per row; a student's rows are found
    by ``user_id``, never gathered into one document.
    """
    run = run_id if run_id is not None else commits.new_run_id()
    spark = src.enrollments.sparkSession
    frames = extract_frames(src)

    schemas: dict[str, T.StructType] = {}

    def write(name: str, df: DataFrame) -> None:
        schemas[name] = write_mart(df, name, root, run, partitions, fmt)

    for name in ("courses", "quiz_data", "assignment_data"):
        write(name, frames[name])
    # One pass over the click log: the web mart carries the file columns too,
    # and the file mart is the written days with file accesses.
    from ..operators.daily import daily_web_activity
    write("web_activity_data", daily_web_activity(src))
    written = commits.read_run(spark, f"{root}/web_activity_data", run, schemas["web_activity_data"], fmt)
    write("file_access_data", written.filter(F.col("file_accesses") > 0).select(
        "user_id", "course_id", "day", "file_accesses", "unique_files", "week"))
    commits.commit(spark, root, "extract", run, schemas)
    return run


def write_mart(df: DataFrame, name: str, root: str, run: int, partitions: int | None = None,
               fmt: str = "parquet") -> T.StructType:
    """One dataset of run ``run``, range partitioned and sorted; returns its schema."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["course_id", "user_id", *ROW_ORDER.get(name, ())]
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return commits.write_run(ordered, f"{root}/{name}", run, ("course_id",), fmt)


#: What orders (and splits) the rows of one student and course.
ROW_ORDER = {
    "quiz_data": ("finished_at_anonymous", "quiz_id"),
    "assignment_data": ("submitted_at_anonymous", "assignment_id"),
    "web_activity_data": ("day",),
    "file_access_data": ("day",),
}


@dataclass(frozen=True)
class Extract:
    """The marts read back (SRC2); metrics are answered from them with the
    same operators as the live form."""

    courses: DataFrame
    quiz_data: DataFrame
    assignment_data: DataFrame
    web_activity_data: DataFrame
    file_access_data: DataFrame
    term: Term

    @classmethod
    def read(cls, spark: SparkSession, root: str, term: Term, run_id: int | None = None,
             fmt: str = "parquet") -> "Extract":
        """The latest committed extract (or the given run), in the format and
        with the types it was written in."""
        found = commits.committed(spark, root, "extract", run_id)
        if found is None:
            raise FileNotFoundError(f"no committed extract under {root}")
        run, schemas = found
        return cls(*[commits.read_run(spark, f"{root}/{m}", run, schemas[m], fmt) for m in MARTS], term=term)

    @classmethod
    def live(cls, src: Sources) -> "Extract":
        """The marts as plans over the sources, not written anywhere."""
        return cls(**extract_frames(src), term=src.term)

    def for_user(self, user_id) -> "Extract":
        keep = lambda df: df.filter(F.col("user_id") == F.lit(user_id))
        return Extract(*[keep(getattr(self, m)) for m in MARTS], term=self.term)

    # ----------------------------------------------------------- query types
    def submitted_weeks(self, kind: str) -> DataFrame:
        """``quiz_weeks`` / ``assignment_weeks``: accepted submissions' weeks."""
        data, states = ((self.quiz_data, QUIZ_ACCEPTED_STATES) if kind == "quiz"
                        else (self.assignment_data, ASSIGNMENT_ACCEPTED_STATES))
        return data.filter(F.col("workflow_state").isin(*states)) \
                   .select("user_id", "course_id", "week").distinct()

    def daily(self, name: str) -> DataFrame:
        """``quiz_scores``, ``assignment_scores``, ``web_activity``,
        ``file_access`` and ``quiz_duration`` as filled daily series named as
        in :data:`learnlens.operators.daily.DAILY_METRICS`."""
        from ..operators.calendar import aggregate_onto_grid, enrolled_days
        from ..operators.daily import mean_or_zero, total_or_zero
        keys = ("user_id", "course_id", "day")
        per = self.term.minutes_per_interaction
        one = {"_n": F.lit(1).cast("bigint")}
        quiz = exactsum.partial_sums(
            self.quiz_data.withColumn("day", day_of("finished_at_anonymous")), keys,
            {"pct": percent_score(), "minutes": measure("DurationInMinutes")}, one)
        asg = exactsum.partial_sums(
            self.assignment_data.withColumn("day", day_of("submitted_at_anonymous")), keys, {"pct": percent_score()}, one)
        submissions = F.coalesce(F.sum("_n"), F.lit(0))
        web = self.web_activity_data.select(*keys, "interactions")
        files = self.file_access_data.select(*keys, "file_accesses", "unique_files")
        spec = {
            "daily_interactions": (web, F.coalesce(F.sum("interactions"), F.lit(0)), "bigint"),
            "active_study_time": (web, F.coalesce(F.sum("interactions"), F.lit(0)) * per, "bigint"),
            "file_accesses": (files, F.coalesce(F.sum("file_accesses"), F.lit(0)), "bigint"),
            "unique_files": (files, F.coalesce(F.sum("unique_files"), F.lit(0)), "bigint"),
            "quiz_submissions": (quiz, submissions, "bigint"),
            "assignment_submissions": (asg, submissions, "bigint"),
            "quiz_score": (quiz, mean_or_zero("pct"), "double"),
            "assignment_score": (asg, mean_or_zero("pct"), "double"),
            "quiz_minutes": (quiz, total_or_zero("minutes"), "double"),
        }
        facts, value, dtype = spec[name]
        filled = aggregate_onto_grid(enrolled_days(self.courses, self.term), facts, keys,
                                     {"value": value.cast(dtype)})
        return filled.select("user_id", "course_id", week_of("day", self.term).alias("week"),
                             "day", "value")


# --- Fixed values: the reference's extract query types -> our daily series -
DAILY_QUERY_TYPES = {
    "quiz_scores": "quiz_score",
    "assignment_scores": "assignment_score",
    "web_activity": "daily_interactions",
    "file_access": "file_accesses",
    "quiz_duration": "quiz_minutes",
}
QUERY_TYPES = ("courses", "quiz_weeks", "assignment_weeks", *DAILY_QUERY_TYPES)
# --- end of fixed values ---------------------------------------------------


def query(extract: Extract, query_type: str, user_id=None, course_id=None, start=None, end=None,
          metric: str = "file_accesses") -> DataFrame:
    """SRC2 by the reference's query-type names, for all students or one.

    ``quiz_weeks`` / ``assignment_weeks`` take a week range, the daily series
    a day range (FIL4, both ends inclusive); ``file_access`` takes
    ``metric="file_accesses"`` or ``"unique_files"``.
    """
    if query_type == "courses":
        df = extract.courses
    elif query_type in ("quiz_weeks", "assignment_weeks"):
        df = extract.submitted_weeks(query_type.split("_")[0])
        if start is not None and end is not None:
            df = df.filter(F.col("week").between(start, end))
    elif query_type in DAILY_QUERY_TYPES:
        name = metric if query_type == "file_access" else DAILY_QUERY_TYPES[query_type]
        df = extract.daily(name)
        if start is not None and end is not None:
            df = df.filter(F.col("day").between(F.lit(start), F.lit(end)))
    else:
        raise ValueError(f"unknown query type {query_type!r}; one of {QUERY_TYPES}")
    if user_id is not None:
        df = df.filter(F.col("user_id") == F.lit(user_id))
    if course_id is not None:
        df = df.filter(F.col("course_id") == F.lit(course_id))
    return df


def extract_ages(spark: SparkSession, root: str, now: datetime,
                 requested_users: DataFrame | None = None, fmt: str = "parquet") -> DataFrame:
    """SRC3: the ages of the students in the latest committed extract: from the time
    that imported documents state, else from the newest file that holds each."""
    found = commits.committed(spark, root, "extract")
    if found is None:
        raise FileNotFoundError(f"no committed extract under {root}")
    run, schemas = found
    files = spark.read.schema(schemas["courses"]).format(fmt).load(commits.run_path(f"{root}/courses", run))
    if "cached_at" in files.columns:
        return ages(files.select("user_id", "cached_at"), now, requested_users)
    return ages(files.select("user_id", F.col("_metadata.file_modification_time").alias("cached_at")), now, requested_users)


def ages(cached: DataFrame, now: datetime, requested_users: DataFrame | None = None) -> DataFrame:
    """Per student of ``cached`` (user_id, cached_at) the age of the newest
    entry and its label (``today``, ``N days ago``, ``1+ week ago``), plus
    ``fresh`` (< 7 days). Requested students absent from it are ``missing``.
    """
    newest = cached.groupBy("user_id").agg(F.max("cached_at").alias("cached_at"))
    kind = newest.schema["cached_at"].dataType.typeName().upper()  # a clock of the same type
    clock = F.lit(now) if kind == "TIMESTAMP" else F.expr(f"TIMESTAMP_NTZ '{now}'")
    age_days = F.timestamp_diff("SECOND", F.col("cached_at"), clock) / F.lit(86400.0)
    if requested_users is not None:
        newest = requested_users.select("user_id").distinct().join(newest, "user_id", "left")
    label = (F.when(F.col("cached_at").isNull(), "missing")
             .when(age_days < 1, "today")
             .when(age_days < 7, F.concat(F.floor(age_days).cast("string"), F.lit(" days ago")))
             .otherwise("1+ week ago"))
    return newest.select("user_id", "cached_at", age_days.alias("age_days"), label.alias("age"),
                         (F.col("cached_at").isNotNull() & (age_days < 7)).alias("fresh"),
                         storage_key("user_id").alias("file_label"))
