"""Reflection metrics: feedback (JOI5, CLS3-CLS6), streaks (WIN2) and
counts (AGG19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scores import bit
from ..sources.reflections import current_reflections
from ..sources.tables import Sources
from .calendar import aggregate_onto_grid

KEYS = ("user_id", "course_id", "week")


def reflections(src: Sources) -> DataFrame:
    """Current reflections: (user_id, course_id, week, satisfaction, expectation,
    feedback as it was stored, saved_at)."""
    return current_reflections(src.reflection_log).select(
        *KEYS, "satisfaction", "expectation", "feedback", "saved_at")


def reflection_feedback(src: Sources) -> DataFrame:
    """Per current reflection: last week's expectation (exactly week - 1),
    category, comparison, outlook and the feedback text.

    Each reflection is emitted for its own week and, as "last week", for the
    week after; one aggregation pairs them, so no self-join is needed.
    """
    cur = reflections(src)
    both = cur.select(
        "user_id", "course_id", F.explode(F.array(
            F.struct(F.col("week").alias("week"), F.lit(True).alias("own"),
                     F.col("satisfaction"), F.col("expectation")),
            F.struct((F.col("week") + 1).alias("week"), F.lit(False).alias("own"),
                     F.col("satisfaction"), F.col("expectation")))).alias("r"))
    paired = both.groupBy("user_id", "course_id", F.col("r.week").alias("week")).agg(
        F.max(F.when(F.col("r.own"), F.col("r.satisfaction"))).alias("satisfaction"),
        F.max(F.when(F.col("r.own"), F.col("r.expectation"))).alias("expectation"),
        F.max(F.when(~F.col("r.own"), F.col("r.expectation"))).alias("last_expectation"),
        F.bool_or(F.col("r.own")).alias("_own"))
    out = paired.filter("_own").select(
        *KEYS, "satisfaction", "expectation", "last_expectation",
        rules.reflection_category("satisfaction", "expectation").alias("category"),
        rules.versus_last("satisfaction", "last_expectation").alias("versus_last"),
        rules.outlook("satisfaction", "expectation").alias("outlook"))
    return out.withColumn("feedback", rules.feedback_text("category", "versus_last", "outlook"))


#: Weeks that one mask word holds.
WORD = 62


def reflection_streaks(src: Sources) -> DataFrame:
    """WIN2: for every enrolled (user, course) and current week W of the grid,
    the run of consecutive reflected weeks ending at W (0 if W has none),
    whether the streak badge shows (>= 2) and its text.

    The weeks to pick, 1..display_weeks, are an array of BIGINT bit masks per
    (user, course), 62 weeks a word: one fixed-width ``bit_or`` aggregate a word,
    combined map-side, for a term of any length. The streak is W minus the latest
    week up to W without a reflection, found by bit arithmetic in W's word and, if
    that has none, as the latest gap of the words before. Reflections filed under
    other weeks belong to no streak.
    """
    last = src.term.display_weeks
    words = -(-last // WORD)
    cur = reflections(src).select("user_id", "course_id", "week").where(F.col("week").between(1, last))
    word, place = F.floor((F.col("week") - 1) / WORD), F.pmod(F.col("week") - 1, F.lit(WORD))
    masks = aggregate_onto_grid(
        src.enrollments.select("user_id", "course_id"),
        cur.select("user_id", "course_id", word.alias("word"), bit(place).alias("b")), ("user_id", "course_id"),
        {f"_w{i}": F.coalesce(F.bit_or(F.when(F.col("word") == i, F.col("b"))), F.lit(0).cast("bigint"))
         for i in range(words)})

    def last_gap(mask: Column, upto: Column) -> Column:
        """1 + the highest place up to ``upto`` that the mask lacks, null if none."""
        missing = F.bitwise_not(mask).bitwiseAND(bit(upto + 1) - F.lit(1))
        return F.when(missing != 0, F.length(F.bin(missing)))

    # The latest week without a reflection before each word.
    masks = masks.withColumn("_gap0", F.lit(0))
    for i in range(1, words):
        masks = masks.withColumn(f"_gap{i}", F.coalesce(
            last_gap(F.col(f"_w{i - 1}"), F.lit(WORD - 1)) + WORD * (i - 1), F.col(f"_gap{i - 1}")))
    per_week = masks.select(
        "user_id", "course_id", F.array(*[f"_w{i}" for i in range(words)]).alias("_words"),
        F.array(*[f"_gap{i}" for i in range(words)]).alias("_gaps"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(last).cast("bigint"))).alias("current_week"))
    w = F.col("current_week")
    at = F.floor((w - 1) / WORD).cast("int")
    own = last_gap(F.get("_words", at), F.pmod(w - 1, F.lit(WORD)))
    streak = (w - F.coalesce(own + at * WORD, F.get("_gaps", at))).cast("bigint")
    return per_week.select(
        "user_id", "course_id", "current_week", streak.alias("streak"),
        (streak >= rules.STREAK_MIN_SHOWN).alias("shown"),
        rules.streak_text(streak).alias("message"))


def reflection_counts(src: Sources) -> DataFrame:
    """AGG19: current reflections per enrolled (user, course)."""
    cur = reflections(src).select("user_id", "course_id", "week")
    return aggregate_onto_grid(src.enrollments.select("user_id", "course_id"), cur,
                               ("user_id", "course_id"), {"reflections": F.count("week")})


def reflections_per_week(src: Sources) -> DataFrame:
    return reflections(src).groupBy("week").agg(F.count(F.lit(1)).alias("reflections"))


def reflection_categories(src: Sources) -> DataFrame:
    return reflection_feedback(src).groupBy("category").agg(F.count(F.lit(1)).alias("reflections"))
