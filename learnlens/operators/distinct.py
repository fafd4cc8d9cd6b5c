"""AGG3 over any span: exact distinct files from mergeable bitmaps.

A count of distinct files of a day can't be added up to that of a week, so each
longer span would need its own pass over the click log. Here the log is brought
once to days and buckets of file ids, with the ids seen as a bitmap. Bitmaps
merge by OR, so days become weeks, blocks, any range of days, or whole courses
over all students, and the counts stay exact.

A bucket is 64 ids, its bitmap one number: most students open a few files a day,
so a wider bitmap would be almost all zeros, and 4 KB for every row of the mart.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import block_start, day_of, week_of
from ..sources.tables import Sources

KEYS = ("user_id", "course_id", "week", "day")
#: Bits of a file id that give its place in the bucket; the others are the bucket's number.
PLACE_BITS = 6


def click_days(src: Sources) -> DataFrame:
    """The day mart: per (user, course, day, bucket) interactions, first and last
    event, file accesses and ``files``, the bitmap of the bucket's file ids.

    Clicks without a file share the null bucket, which has no bitmap. All columns
    merge (sum, min, max, OR), so marts of parts of the log merge to the mart of
    all of it (:func:`merged`). There are at most as many rows as clicks.
    """
    logs = src.web_logs_in_term()
    file = F.col("attachment_id").cast("bigint")
    place = file.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    # Grouped by the day's number: a union of marts that were known to be laid out alike
    # would be merged where they lie, the same partitions of all of them in one task.
    days = logs.groupBy("user_id", "course_id", F.unix_date(day_of("timestamp")).alias("_day"),
                        F.shiftright(file, PLACE_BITS).alias("bucket")).agg(
        F.count(F.lit(1)).alias("interactions"),
        F.min("timestamp").alias("first_activity"), F.max("timestamp").alias("last_activity"),
        F.count(file).alias("file_accesses"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place)).alias("files"))
    days = days.withColumn("day", F.date_from_unix_date("_day"))
    return days.select("user_id", "course_id", week_of("day", src.term).alias("week"), "day", "bucket",
                       "interactions", "first_activity", "last_activity", "file_accesses", "files")


def merged(marts: DataFrame) -> DataFrame:
    """Rows of several day marts, made of different parts of the log, as one mart."""
    return marts.groupBy(*KEYS, "bucket").agg(
        F.sum("interactions").alias("interactions"),
        F.min("first_activity").alias("first_activity"), F.max("last_activity").alias("last_activity"),
        F.sum("file_accesses").alias("file_accesses"), F.bit_or("files").alias("files"))


def daily_web_activity(mart: DataFrame) -> DataFrame:
    """AGG2 + AGG3 from the mart, as :func:`learnlens.operators.daily.daily_web_activity`
    has them from the click log."""
    return mart.groupBy(*KEYS).agg(
        F.sum("interactions").alias("interactions"),
        F.min("first_activity").alias("first_activity"), F.max("last_activity").alias("last_activity"),
        F.sum("file_accesses").alias("file_accesses"),
        F.coalesce(F.sum(F.bit_count("files")), F.lit(0)).alias("unique_files"))


def distinct_files(mart: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """File accesses and distinct files per ``by`` (columns of the mart or of its
    days), for the groups that have any."""
    cols = [F.col(c) if isinstance(c, str) else c for c in by]
    spans = mart.where("bucket IS NOT NULL").groupBy(*cols, "bucket").agg(
        F.sum("file_accesses").alias("file_accesses"), F.bit_or("files").alias("files"))
    names = spans.columns[:len(cols)]
    return spans.groupBy(*names).agg(
        F.sum("file_accesses").alias("file_accesses"), F.sum(F.bit_count("files")).alias("unique_files"))


def weekly_files(mart: DataFrame) -> DataFrame:
    return distinct_files(mart, ["user_id", "course_id", "week"])


def block_files(mart: DataFrame) -> DataFrame:
    return distinct_files(mart, ["user_id", "course_id", block_start("week").alias("block_start")])


def course_week_files(mart: DataFrame) -> DataFrame:
    """Distinct files of a course's week over all its students."""
    return distinct_files(mart, ["course_id", "week"])


def files_between(mart: DataFrame, start: date, end: date) -> DataFrame:
    """Per student and course over the days from ``start`` to ``end`` (FIL4, inclusive)."""
    return distinct_files(mart.where(F.col("day").between(F.lit(start), F.lit(end))), ["user_id", "course_id"])
