"""The reflection store: SRC4 (nested JSON import), SNK2 (upsert) and SNK3
(delete) over an append-only log.

The reference rewrites one JSON document per student on every save. Here
each save or delete is a row appended to a Parquet log; the current state is
the latest row per (user, course, week), chosen with a ``max(struct(...))``
aggregate with map-side partials, so a student with many rewrites never
lands whole in one task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import storage_key
from . import schemas
from .segments import Segments

KEYS = ("user_id", "course_id", "week")


def current_reflections(log: DataFrame) -> DataFrame:
    """Latest surviving reflection per (user, course, week).

    Order: ``saved_at``, then ``seq`` for equal save times. A key whose latest
    row is a tombstone (``deleted``) has no current reflection. The feedback
    text is the one that was stored with it.

    ``max(struct(saved_at, seq, ...))`` runs as a sort-based aggregate with
    map-side partials. Measured against a hash aggregate with ``max_by`` on a
    packed DECIMAL(38,0) key, it was faster (0.75 s vs 0.91 s on ~120k rows),
    because 38-digit decimals are not fixed-width.
    """
    latest = log.groupBy(*KEYS).agg(F.max(F.struct(
        F.col("saved_at"), F.col("seq"), F.coalesce(F.col("deleted"), F.lit(False)).alias("deleted"),
        F.col("satisfaction"), F.col("expectation"), F.col("feedback"))).alias("r"))
    return latest.filter(~F.col("r.deleted")).select(
        *KEYS, "r.satisfaction", "r.expectation", "r.feedback", "r.saved_at")


def wall_clock(time: datetime) -> Column:
    """A time as written, whatever zones driver and session are in: imported
    documents keep their wall-clock text, so saves do too."""
    return F.expr(f"TIMESTAMP_NTZ '{time.strftime('%Y-%m-%d %H:%M:%S.%f')}'")


def save_rows(rows: DataFrame, saved_at: datetime | None = None, seq_base: int = 0) -> DataFrame:
    """SNK2 rows: (user_id, course_id, week, satisfaction, expectation[, feedback])
    shaped as log entries. ``seq`` orders saves that share a timestamp."""
    ts = wall_clock(saved_at or datetime.now())
    out = rows
    if "feedback" not in rows.columns:
        out = out.withColumn("feedback", F.lit(None).cast("string"))
    if "saved_at" not in rows.columns:
        out = out.withColumn("saved_at", ts)
    if "seq" not in rows.columns:
        out = out.withColumn("seq", F.lit(seq_base) + F.monotonically_increasing_id())
    return out.select(
        "user_id", F.col("course_id").cast("bigint"), F.col("week").cast("bigint"),
        F.col("satisfaction").cast("int"), F.col("expectation").cast("int"), "feedback",
        F.col("saved_at").cast("timestamp_ntz"), F.col("seq").cast("bigint"),
        F.lit(False).alias("deleted"))


def delete_rows(keys: DataFrame, saved_at: datetime | None = None, seq_base: int = 0) -> DataFrame:
    """SNK3 tombstones for (user_id, course_id, week) keys."""
    ts = wall_clock(saved_at or datetime.now())
    out = keys if "saved_at" in keys.columns else keys.withColumn("saved_at", ts)
    if "seq" not in out.columns:
        out = out.withColumn("seq", F.lit(seq_base) + F.monotonically_increasing_id())
    return out.select(
        "user_id", F.col("course_id").cast("bigint"), F.col("week").cast("bigint"),
        F.lit(None).cast("int").alias("satisfaction"), F.lit(None).cast("int").alias("expectation"),
        F.lit(None).cast("string").alias("feedback"),
        F.col("saved_at").cast("timestamp_ntz"), F.col("seq").cast("bigint"),
        F.lit(True).alias("deleted"))


def append_to_log(entries: DataFrame, path: str) -> None:
    """Append log entries; readers never see a half-rewritten document."""
    entries.write.mode("append").parquet(path)


def latest_entries(log: DataFrame) -> DataFrame:
    """One entry per (user, course, week): the latest, tombstones included, so that
    entries appended later still order after it."""
    rest = [c for c in log.columns if c not in (*KEYS, "saved_at", "seq")]
    last = log.groupBy(*KEYS).agg(F.max(F.struct("saved_at", "seq", *rest)).alias("r"))
    return last.select(*KEYS, "r.*").select(*log.columns)


def compact_log(spark: SparkSession, path: str, into: str, user_type=None) -> None:
    """Write the latest entries of the log at ``path`` to the new folder ``into``.
    Nothing may be appended to ``path`` meanwhile; a :class:`ReflectionStore` needs
    no such rule."""
    latest_entries(read_log(spark, path, user_type)).write.parquet(into)


class ReflectionStore:
    """The log for several writers at a time: saves, deletions and compactions are
    commits of one :class:`learnlens.sources.segments.Segments` dataset."""

    def __init__(self, spark: SparkSession, root: str, user_type=None) -> None:
        self.segments = Segments(spark, root)
        self.schema = schemas.reflection_log(user_type) if user_type is not None else schemas.reflection_log()

    def append(self, entries: DataFrame, run: str | None = None) -> int:
        """Commit entries (of :func:`save_rows` or :func:`delete_rows`); a ``run`` only once."""
        return self.segments.append(entries, run)

    def log(self) -> DataFrame:
        return self.segments.read(schema=self.schema)

    def compact(self) -> int:
        """Put the latest entries in the place of those read. What others append
        meanwhile stays; of two compactions at a time one fails."""
        now = self.segments.state()
        return self.segments.replace(now, latest_entries(self.segments.read(now, self.schema)))


def read_log(spark: SparkSession, path: str, user_type=None) -> DataFrame:
    schema = schemas.reflection_log(user_type) if user_type is not None else schemas.reflection_log()
    return spark.read.schema(schema).parquet(path)


def read_reflection_documents(spark: SparkSession, path: str,
                              enrollments: DataFrame | None = None) -> DataFrame:
    """SRC4: per-student JSON documents ``{course: {week: record}}`` -> log rows.

    One file per student (``reflections_<id>.json``). ``wholetext`` keeps each
    (multi-line) document in one row. The file name holds the student id as a
    storage key; give ``enrollments`` to restore the ids (see
    :func:`restore_user_ids`).
    """
    docs = spark.read.text(path, wholetext=True) \
        .select(F.col("value"), F.col("_metadata.file_name").alias("file"))
    rows = parse_reflection_documents(docs)
    return rows if enrollments is None else restore_user_ids(rows, enrollments)


def restore_user_ids(rows: DataFrame, enrollments: DataFrame) -> DataFrame:
    """``rows`` with the enrolled student's id where the key names exactly one;
    a key that names none or several (see :func:`key_collisions`) is kept."""
    ids = enrollments.select("user_id").distinct().groupBy(storage_key("user_id").alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("user_id").alias("_id")).where("_n = 1")
    back = F.coalesce(F.col("_id").cast("string"), F.col("user_id")).cast(enrollments.schema["user_id"].dataType)
    return rows.join(ids, F.col("user_id") == F.col("_key"), "left").withColumn("user_id", back).select(*rows.columns)


def key_collisions(enrollments: DataFrame) -> DataFrame:
    """(file_label, user_id): students whose ids share a storage key."""
    ids = enrollments.select("user_id").distinct().withColumn("file_label", storage_key("user_id"))
    many = ids.groupBy("file_label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("file_label")
    return ids.join(many, "file_label", "left_semi").select("file_label", "user_id")


def parse_reflection_documents(docs: DataFrame) -> DataFrame:
    """(file, value) rows of documents to log rows; the key of the file name
    is the user id."""
    parsed = docs.select(
        F.regexp_extract("file", r"^reflections_(.*)\.json$", 1).alias("user_id"),
        F.explode(F.from_json("value", schemas.REFLECTION_DOCUMENT)).alias("course", "weeks"))
    rows = parsed.select("user_id", "course", F.explode("weeks").alias("week", "r"))
    return rows.select(
        "user_id",
        F.col("course").try_cast("bigint").alias("course_id"),
        F.col("week").try_cast("bigint").alias("week"),
        F.col("r.satisfaction").alias("satisfaction"),
        F.col("r.expectation").alias("expectation"),
        F.col("r.feedback").alias("feedback"),
        F.coalesce(F.to_timestamp_ntz(F.col("r.saved_at")),
                   F.to_timestamp_ntz(F.substring(F.col("r.saved_at"), 1, 19))).alias("saved_at"),
        F.lit(0).cast("bigint").alias("seq"),
        (~F.coalesce(F.col("r.reflection_saved"), F.lit(True))).alias("deleted"),
    )
