"""Activity tracker: submitted weeks (FIL5, AGG12, AGG13), the activity grid
(JOI4), block progress and messages (AGG18, CLS7, CLS8, PRJ5)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ASSIGNMENT_ACCEPTED_STATES, QUIZ_ACCEPTED_STATES
from ..functions import rules
from ..functions.scores import bit, has_bit, round_half_even
from ..functions.time import block_start, ts_literal, week_of
from ..sources.tables import Sources
from .calendar import aggregate_onto_grid
from .reflections import reflections


def _quiz_done(src: Sources) -> DataFrame:
    subs = src.quiz_submissions_in_term().filter(F.col("workflow_state").isin(*QUIZ_ACCEPTED_STATES))
    return subs.select("user_id", "course_id",
                       week_of("finished_at_anonymous", src.term).alias("week"))


def _assignment_done(src: Sources) -> DataFrame:
    subs = src.submissions_in_term().filter(F.col("workflow_state").isin(*ASSIGNMENT_ACCEPTED_STATES))
    return subs.select("user_id", "course_id",
                       week_of("submitted_at_anonymous", src.term).alias("week"))


def quiz_weeks(src: Sources) -> DataFrame:
    """AGG12: (user, course, week) with an accepted quiz submission."""
    return _quiz_done(src).distinct()


def assignment_weeks(src: Sources) -> DataFrame:
    """AGG13: (user, course, week) with an accepted assignment submission."""
    return _assignment_done(src).distinct()


ITEMS_PER_BLOCK = 2 * len(rules.ACTIVITY_ORDER)


_IDX = {a: i for i, a in enumerate(rules.ACTIVITY_ORDER)}


def _submission_items(src: Sources, submitted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Accepted quiz and assignment submissions as (user_id, course_id, week,
    activity index); raw rows, duplicates are harmless."""
    quiz, assignment = submitted or (_quiz_done(src), _assignment_done(src))
    return (quiz.withColumn("activity", F.lit(_IDX["quiz"]))
            .unionByName(assignment.withColumn("activity", F.lit(_IDX["assignment"]))))


def _reflection_items(src: Sources) -> DataFrame:
    return reflections(src).select("user_id", "course_id", "week") \
        .withColumn("activity", F.lit(_IDX["reflection"]))


def done_items(src: Sources) -> DataFrame:
    """Every done item once: (user_id, course_id, week, activity index)."""
    return _submission_items(src).unionByName(_reflection_items(src)).distinct()


def _item_bits(done: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each done item as its bit in its own block and, as "previous", in the
    block two weeks later: (keys..., block_start, own, prev)."""
    block = block_start("week")
    item_bit = bit((F.col("week") - block) * len(rules.ACTIVITY_ORDER) + F.col("activity"))
    none = F.lit(None).cast("bigint")
    return done.select(*keys, F.explode(F.array(
        F.struct(block.alias("block_start"), item_bit.alias("own"), none.alias("prev")),
        F.struct((block + 2).alias("block_start"), none.alias("own"), item_bit.alias("prev")),
    )).alias("f")).select(*keys, "f.*")


def block_masks(src: Sources, scope: str = "course",
                submitted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Per enrolled (user, course) and term block: which of the block's six
    items are done, as a bit mask, for the block itself and for the block
    before it.

    Item bit = (week - block_start) * 3 + activity index. Each done item sets
    its bit in its own block and, as "previous", in the block two weeks
    later, so one aggregation gives both; ``bit_or`` is a fixed-width,
    map-side combinable aggregate, so hot students cost nothing extra.

    ``scope="course"`` (default) counts a submission only for its course;
    ``scope="user"`` counts it for every course of the student, as the
    reference's live queries do. The user-scope masks are first reduced to
    one row per (user, block) and only then spread over the student's
    enrolments, so that join is bounded by users x blocks.

    ``submitted`` (marts of :func:`quiz_weeks` and :func:`assignment_weeks`) replaces
    the submissions as input.
    """
    term = src.term
    keys = ("user_id", "course_id", "block_start")
    grid = src.enrollments.select(
        "user_id", "course_id",
        F.explode(F.array(*[F.lit(b).cast("bigint") for b in term.block_starts])).alias("block_start"))
    if scope == "course":
        facts = _item_bits(_submission_items(src, submitted).unionByName(_reflection_items(src)),
                           ("user_id", "course_id"))
    elif scope == "user":
        per_user = _item_bits(_submission_items(src, submitted).drop("course_id"), ("user_id",)) \
            .groupBy("user_id", "block_start").agg(F.bit_or("own").alias("own"),
                                                   F.bit_or("prev").alias("prev"))
        spread = per_user.join(src.enrollments.select("user_id", "course_id").distinct(), "user_id")
        facts = spread.unionByName(_item_bits(_reflection_items(src), ("user_id", "course_id")))
    else:
        raise ValueError(f"unknown scope {scope!r}")
    return aggregate_onto_grid(grid, facts, keys, {
        "own_mask": F.coalesce(F.bit_or("own"), F.lit(0).cast("bigint")),
        "previous_mask": F.coalesce(F.bit_or("prev"), F.lit(0).cast("bigint")),
    })


def activity_grid(src: Sources, scope: str = "course", masks: DataFrame | None = None) -> DataFrame:
    """JOI4: every enrolled (user, course) x block week x {quiz, assignment,
    reflection} with its name and whether it is done (six items per block;
    weeks come from the term's blocks, not from the data)."""
    items = F.array(*[
        F.struct(F.lit(w).alias("offset"), F.lit(a).alias("activity"),
                 F.lit(w * len(rules.ACTIVITY_ORDER) + i).alias("bit"))
        for w in range(2) for i, a in enumerate(rules.ACTIVITY_ORDER)])
    masks = block_masks(src, scope) if masks is None else masks
    rows = masks.select("user_id", "course_id", "block_start", "own_mask", F.explode(items).alias("item"))
    week = (F.col("block_start") + F.col("item.offset")).cast("bigint")
    done = has_bit("own_mask", F.col("item.bit"))
    return rows.select(
        "user_id", "course_id", "block_start", week.alias("week"),
        F.col("item.activity").alias("activity"),
        rules.activity_name(F.col("item.activity"), week).alias("name"),
        done.alias("done"))


def block_progress(src: Sources | None, scope: str = "course", masks: DataFrame | None = None) -> DataFrame:
    """AGG18 + CLS7/CLS8: per (user, course, block) total, completed, percent
    and messages, with the previous block's counts (block_start - 2). With ``masks``
    no source is read."""
    m = block_masks(src, scope) if masks is None else masks
    total = F.lit(ITEMS_PER_BLOCK).cast("bigint")
    completed = F.bit_count("own_mask").cast("bigint")
    has_prev = F.col("block_start") - 2 >= 1
    prev_total = F.when(has_prev, total).otherwise(F.lit(0).cast("bigint"))
    prev_completed = F.bit_count("previous_mask").cast("bigint")
    counted = m.select("user_id", "course_id", "block_start", total.alias("total"),
                       completed.alias("completed"), prev_total.alias("previous_total"),
                       prev_completed.alias("previous_completed"))
    pct = round_half_even(F.col("completed") * F.lit(100.0) / F.col("total"), 0).cast("int")
    return counted.select(
        "user_id", "course_id", "block_start",
        (F.col("block_start") + 1).alias("block_end"),
        "total", "completed", pct.alias("percent"),
        (F.col("completed") == F.col("total")).alias("is_complete"),
        rules.block_message("completed", "total").alias("message"),
        "previous_total", "previous_completed",
        rules.previous_block_message("block_start", "previous_completed", "previous_total")
             .alias("previous_message"))


def completion_flips(src: Sources, cutoff: datetime) -> DataFrame:
    """SNK4 in one pass: the blocks whose completion differs between just
    before ``cutoff`` (event time) and now, as (keys, change: set or cleared).

    Each item carries whether it was done by then and is done now; one
    aggregation makes both masks, so the facts are read once.
    """
    def by_then(df: DataFrame, time: str) -> DataFrame:
        return df.withColumn("then", F.col(time) < ts_literal(df, time, cutoff)).withColumn("now", F.lit(True))

    term = src.term
    quiz = by_then(src.quiz_submissions_in_term(), "finished_at_anonymous").filter(
        F.col("workflow_state").isin(*QUIZ_ACCEPTED_STATES)).select(
        "user_id", "course_id", week_of("finished_at_anonymous", term).alias("week"),
        F.lit(_IDX["quiz"]).alias("activity"), "then", "now")
    done = by_then(src.submissions_in_term(), "submitted_at_anonymous").filter(
        F.col("workflow_state").isin(*ASSIGNMENT_ACCEPTED_STATES)).select(
        "user_id", "course_id", week_of("submitted_at_anonymous", term).alias("week"),
        F.lit(_IDX["assignment"]).alias("activity"), "then", "now")
    log = by_then(src.reflection_log, "saved_at")
    state = F.struct("saved_at", "seq", F.coalesce("deleted", F.lit(False)).alias("deleted"))
    refl = log.groupBy("user_id", "course_id", "week").agg(
        F.max(state).alias("l"), F.max(F.when(F.col("then"), state)).alias("t")).select(
        "user_id", "course_id", "week", F.lit(_IDX["reflection"]).alias("activity"),
        F.coalesce(~F.col("t.deleted"), F.lit(False)).alias("then"), (~F.col("l.deleted")).alias("now"))
    items = quiz.unionByName(done).unionByName(refl)
    block = block_start("week")
    one = bit((F.col("week") - block) * len(rules.ACTIVITY_ORDER) + F.col("activity"))
    facts = items.select("user_id", "course_id", block.alias("block_start"),
                         F.when(F.col("then"), one).alias("t"), F.when(F.col("now"), one).alias("n"))
    grid = src.enrollments.select("user_id", "course_id", F.explode(
        F.array(*[F.lit(b).cast("bigint") for b in term.block_starts])).alias("block_start"))
    whole = (1 << ITEMS_PER_BLOCK) - 1
    flags = aggregate_onto_grid(grid, facts, ("user_id", "course_id", "block_start"), {
        "was": F.coalesce(F.bit_or("t"), F.lit(0)) == whole, "is": F.coalesce(F.bit_or("n"), F.lit(0)) == whole})
    return flags.where("was <> `is`").select(
        "user_id", "course_id", "block_start", F.when(F.col("is"), "set").otherwise("cleared").alias("change"))
