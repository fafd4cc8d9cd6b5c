"""Explicit schemas of the source tables (SRC1) and of our own stores.

Types are declared, never inferred. ``user_id`` is a string in the
warehouse the reference reads and a bigint in other feeds, so every schema
is built for a chosen user-id type; the operators never cast it.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: warehouse table names of the silver layer ---------------
SILVER_TABLES = {
    "enrollments": "silver_canvas_enrollments",
    "quiz_submissions": "silver_canvas_quiz_submissions",
    "quizzes": "silver_canvas_quizzes",
    "submissions": "silver_canvas_submissions",
    "assignments": "silver_canvas_assignments",
    "web_logs": "silver_canvas_web_logs",
}
# --- end of fixed values ---------------------------------------------------


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


def enrollments(user_type: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([_f("user_id", user_type), _f("course_id", T.LongType())])


def web_logs(user_type: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([
        _f("user_id", user_type),
        _f("course_id", T.LongType()),
        _f("timestamp", T.TimestampNTZType()),
        _f("attachment_id", T.LongType()),
    ])


def quiz_submissions(user_type: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([
        _f("user_id", user_type),
        _f("course_id", T.LongType()),
        _f("quiz_id", T.LongType()),
        _f("finished_at_anonymous", T.TimestampNTZType()),
        _f("score_anonymous", T.DoubleType()),
        _f("DurationInMinutes", T.DoubleType()),
        _f("workflow_state", T.StringType()),
    ])


def submissions(user_type: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([
        _f("user_id", user_type),
        _f("course_id", T.LongType()),
        _f("assignment_id", T.LongType()),
        _f("submitted_at_anonymous", T.TimestampNTZType()),
        _f("score_anonymous", T.DoubleType()),
        _f("workflow_state", T.StringType()),
    ])


def points_dimension() -> T.StructType:
    """``silver_canvas_quizzes`` / ``silver_canvas_assignments`` columns used."""
    return T.StructType([_f("id", T.LongType()), _f("points_possible", T.DoubleType())])


def reflection_log(user_type: T.DataType = T.StringType()) -> T.StructType:
    """Append-only reflection log (SNK2/SNK3); the latest row per key wins."""
    return T.StructType([
        _f("user_id", user_type),
        _f("course_id", T.LongType()),
        _f("week", T.LongType()),
        _f("satisfaction", T.IntegerType()),
        _f("expectation", T.IntegerType()),
        _f("feedback", T.StringType()),
        _f("saved_at", T.TimestampNTZType()),
        _f("seq", T.LongType()),
        _f("deleted", T.BooleanType()),
    ])


# The driver's tables, as far as they are mapped to source tables.
DRIVER_EVENTS = T.StructType([
    _f("event_id", T.LongType()), _f("ts", T.TimestampNTZType()), _f("user_id", T.LongType()),
    _f("event_type", T.StringType()), _f("value", T.DoubleType()), _f("props", T.StringType())])
DRIVER_PART = T.StructType([_f("p_partkey", T.LongType()), _f("p_size", T.IntegerType())])


def completion_snapshot(user_type: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([
        _f("user_id", user_type),
        _f("course_id", T.LongType()),
        _f("block_start", T.LongType()),
        _f("completed", T.BooleanType()),
    ])


# Nested per-user reflection document: course -> week -> record.
REFLECTION_RECORD = T.StructType([
    _f("satisfaction", T.IntegerType()),
    _f("expectation", T.IntegerType()),
    _f("feedback", T.StringType()),
    _f("reflection_saved", T.BooleanType()),
    _f("saved_at", T.StringType()),
])
REFLECTION_DOCUMENT = T.MapType(T.StringType(), T.MapType(T.StringType(), REFLECTION_RECORD))
