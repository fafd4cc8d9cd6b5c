"""JOI3, AGG14, AGG18, CLS9 from bucketed marts, without a shuffle.

The refresh writes what the cards need as small marts, bucketed by (user_id,
course_id). Reading, each mart is brought to one row per student and course, with a
map or array of a term's few weeks, days or items; these rows meet the enrolments
in joins on the bucket keys, and the weeks, days and blocks are laid out from there.
Nothing is exchanged between tasks, however many cards are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Term
from ..functions import exactsum, rules
from ..functions.scores import bit
from ..functions.time import block_start, term_days, week_of
from ..operators import badges, daily, progress, summary
from ..sources import buckets, commits
from ..sources.tables import Sources

DATASET = "bucketed"
PAIR = buckets.KEYS
_REFLECTION = rules.ACTIVITY_ORDER.index("reflection")


def write_marts(src: Sources, root: str, n: int, run_id: int | None = None) -> int:
    """Write and commit the four marts in ``n`` buckets each; returns the run.

    Days (clicks by day), minutes (exact partial sums by week), items (submitted and
    reflected weeks) and enrolments; students without an id are left out.
    """
    run = run_id if run_id is not None else commits.new_run_id()
    marts = {
        "enrollments": (src.enrollments.select(*PAIR).distinct(), ()),
        "days": (daily.daily_web_activity(src), ("day",)),
        "minutes": (summary.quiz_parts(src), ("week",)),
        "items": (progress.done_items(src), ("week", "activity")),
    }
    schemas = {name: buckets.write(df.where("user_id IS NOT NULL AND course_id IS NOT NULL"), f"{root}/{name}", run, n, order)
               for name, (df, order) in marts.items()}
    commits.commit(src.enrollments.sparkSession, root, DATASET, run, schemas)
    return run


@dataclass(frozen=True)
class Bucketed:
    """The marts of one run, read back."""

    enrollments: DataFrame
    days: DataFrame
    minutes: DataFrame
    items: DataFrame
    term: Term

    @classmethod
    def read(cls, spark: SparkSession, root: str, term: Term, run_id: int | None = None) -> "Bucketed":
        found = commits.committed(spark, root, DATASET, run_id)
        if found is None:
            raise FileNotFoundError(f"no committed run under {root}")
        run, schemas = found
        return cls(*[buckets.read(spark, f"{root}/{m}", run, schemas[m]) for m in ("enrollments", "days", "minutes", "items")],
                   term=term)

    def _beside(self, pairs: DataFrame) -> DataFrame:
        """The enrolments with the columns of ``pairs``, one row per pair each."""
        return self.enrollments.join(pairs, list(PAIR), "left")

    def weekly_summary(self, mean: str = "active") -> DataFrame:
        """As :func:`learnlens.operators.summary.weekly_summary`."""
        place = (F.datediff("day", F.lit(self.term.start)) - (F.col("week") - 1) * 7).cast("int")
        weeks = self.days.groupBy(*PAIR, "week").agg(
            F.sum("interactions").alias("n"), F.bit_count(F.bit_or(bit(place))).alias("days"))
        web = _by_key(weeks, "week", "web", F.struct("n", "days"))
        spent = self.minutes.groupBy(*PAIR, "week").agg(exactsum.total("collect_list(minutes)").alias("minutes"))
        quiz = _by_key(spent, "week", "quiz", F.col("minutes"))
        every = self.enrollments.join(web, list(PAIR), "left").join(quiz, list(PAIR), "left")
        weekly = every.select(*PAIR, "web", "quiz", F.explode(F.sequence(
            F.lit(1).cast("bigint"), F.lit(self.term.weeks).cast("bigint"))).alias("week")).select(
            *PAIR, "week",
            F.coalesce(F.col("web")[F.col("week")]["n"], F.lit(0)).cast("bigint").alias("total_interactions"),
            F.coalesce(F.col("web")[F.col("week")]["days"], F.lit(0)).alias("active_days"),
            F.coalesce(F.col("quiz")[F.col("week")], F.lit(0.0)).alias("quiz_minutes"))
        return summary.card(weekly, self.term, mean)

    def daily_interactions(self) -> DataFrame:
        """As ``daily_metric(src, "daily_interactions")``: every day of the term."""
        web = _by_key(self.days.groupBy(*PAIR, "day").agg(F.sum("interactions").alias("n")), "day", "web", F.col("n"))
        every = self._beside(web).select(*PAIR, "web", F.explode(term_days(self.term)).alias("day"))
        return every.select(*PAIR, week_of("day", self.term).alias("week"), "day",
                            F.coalesce(F.col("web")[F.col("day")], F.lit(0)).cast("bigint").alias("value"))

    def block_masks(self) -> DataFrame:
        """As :func:`learnlens.operators.progress.block_masks`, scope ``course``."""
        done = self.items.groupBy(*PAIR).agg(F.collect_set(F.struct("week", "activity")).alias("done"))
        blocks = self._beside(done).select(*PAIR, "done", F.explode(F.array(*[
            F.lit(b).cast("bigint") for b in self.term.block_starts])).alias("block_start"))

        def mask(block: Column) -> Column:
            item = lambda x: bit((x["week"] - block) * len(rules.ACTIVITY_ORDER) + x["activity"])
            return F.coalesce(F.aggregate(
                F.filter("done", lambda x: block_start(x["week"]) == block), F.lit(0).cast("bigint"),
                lambda a, x: a.bitwiseOR(item(x))), F.lit(0).cast("bigint"))

        return blocks.select(*PAIR, "block_start", mask(F.col("block_start")).alias("own_mask"),
                             mask(F.col("block_start") - 2).alias("previous_mask"))

    def block_progress(self) -> DataFrame:
        return progress.block_progress(None, masks=self.block_masks())

    def badges(self) -> DataFrame:
        """As :func:`learnlens.operators.badges.badges`."""
        masks = self.block_masks().groupBy(*PAIR).agg(
            F.count_if(F.bit_count("own_mask") == progress.ITEMS_PER_BLOCK).alias("completed_blocks"))
        reflected = self.items.groupBy(*PAIR).agg(F.count_if(F.col("activity") == _REFLECTION).alias("reflections"))
        counts = masks.join(reflected, list(PAIR), "left").withColumn("reflections", F.coalesce("reflections", F.lit(0)))
        return badges.badge_rows(counts)


def _by_key(rows: DataFrame, key: str, name: str, value: Column) -> DataFrame:
    """One row per pair with the map ``name`` from ``key`` to ``value``: a term's
    weeks or days at most."""
    return rows.groupBy(*PAIR).agg(F.map_from_entries(F.collect_list(F.struct(key, value.alias("v")))).alias(name))
