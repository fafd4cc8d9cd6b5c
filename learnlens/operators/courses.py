"""Courses: enrolments (AGG1), course labels (JOI6) and the known-course
intersection (SET1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COURSE_LABELS, DASHBOARD_TITLE_SUFFIX, UNKNOWN_COURSE
from ..sources.tables import Sources


def enrollments(src: Sources) -> DataFrame:
    """AGG1: distinct (user, course) pairs."""
    return src.enrollments.select("user_id", "course_id").distinct()


def course_label(course_id: Column | str) -> Column:
    """JOI6 as an expression: the four labels are a literal map, so the
    "join" to them never shuffles or broadcasts anything."""
    c = F.col(course_id) if isinstance(course_id, str) else course_id
    pairs = []
    for cid, label in COURSE_LABELS:
        pairs += [F.lit(cid), F.lit(label)]
    return F.element_at(F.create_map(*pairs), c.cast("string"))


def course_labels(src: Sources) -> DataFrame:
    """Every enrolment with its label (``Unknown Course`` otherwise), whether
    the course is one the dashboard knows (SET1) and the dashboard title."""
    label = course_label("course_id")
    shown = F.coalesce(label, F.lit(UNKNOWN_COURSE))
    return enrollments(src).select(
        "user_id", "course_id", shown.alias("course_label"), label.isNotNull().alias("known"),
        F.concat_ws(" ", shown, F.lit(DASHBOARD_TITLE_SUFFIX)).alias("title"))


def known_courses(src: Sources) -> DataFrame:
    """SET1: a student's courses that the dashboard knows."""
    return course_labels(src).filter("known").select("user_id", "course_id", "course_label")
