"""Badges (CLS9) from reflection counts (AGG19) and completed blocks (AGG20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.tables import Sources
from .calendar import aggregate_onto_grid
from .progress import block_progress
from .reflections import reflections

PAIR = ("user_id", "course_id")


def badge_counts(src: Sources, masks: DataFrame | None = None) -> DataFrame:
    """Per enrolled (user, course): current reflections and completed blocks
    (from block masks already written, if given)."""
    refl = reflections(src).select(*PAIR, F.lit(1).alias("_refl"))
    blocks = block_progress(src, masks=masks).filter("is_complete").select(*PAIR, F.lit(1).alias("_block"))
    facts = refl.unionByName(blocks, allowMissingColumns=True)
    return aggregate_onto_grid(src.enrollments.select(*PAIR), facts, PAIR, {
        "reflections": F.count("_refl"),
        "completed_blocks": F.count("_block"),
    })


def badges(src: Sources, masks: DataFrame | None = None) -> DataFrame:
    """One row per enrolled (user, course) and badge: the count it uses, the
    threshold, whether it is unlocked, its tooltip and image."""
    return badge_rows(badge_counts(src, masks))


def badge_rows(counts: DataFrame) -> DataFrame:
    """The badges of (reflections, completed_blocks) per (user, course).

    The six badges are a fixed literal array exploded per row (no join).
    """
    table = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(b).alias("badge"), F.lit(kind).alias("counts"),
                 F.lit(t).cast("bigint").alias("threshold"), F.lit(img).alias("unlocked_image"),
                 F.lit(on).alias("unlocked_tooltip"), F.lit(off).alias("locked_tooltip"))
        for i, (b, kind, t, img, on, off) in enumerate(rules.BADGES, start=1)])
    rows = counts.select(*PAIR, "reflections", "completed_blocks", F.explode(table).alias("b"))
    have = F.when(F.col("b.counts") == "reflections", F.col("reflections")) \
            .otherwise(F.col("completed_blocks"))
    unlocked = have >= F.col("b.threshold")
    return rows.select(
        *PAIR, F.col("b.position").alias("position"), F.col("b.badge").alias("badge"),
        F.col("b.counts").alias("counts"), F.col("b.threshold").alias("threshold"),
        have.alias("have"), unlocked.alias("unlocked"),
        F.when(unlocked, F.col("b.unlocked_tooltip")).otherwise(F.col("b.locked_tooltip")).alias("tooltip"),
        F.when(unlocked, F.col("b.unlocked_image")).otherwise(F.lit(rules.LOCKED_IMAGE)).alias("image"))
