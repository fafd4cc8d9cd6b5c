"""Refresh job: every metric for every student, written as committed marts.

The reference computes one student's chart when it is opened. At scale the
same answers come from marts refreshed in one batch job: each mart is a
plan from :mod:`learnlens.operators`, written as a new ``run_id`` partition
(sorted by student inside each file, so a one-student read skips row groups
by their statistics) and committed once every mart of the run is written.

    python -m learnlens.plans.refresh --driver-dir /root/testdata/sf0.1 --out /shared/marts
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import badges, daily, progress, reflections, scores, summary
from ..sources import commits
from ..sources.tables import Sources

DATASET = "marts"

MARTS: dict[str, Callable[[Sources], DataFrame]] = {
    "daily_web_activity": daily.daily_web_activity,
    "daily_metrics": daily.daily_metrics_wide,
    "weekly_summary": summary.weekly_summary,
    "weekly_quiz_scores": lambda s: scores.weekly_scores(s, "quiz"),
    "weekly_assignment_scores": lambda s: scores.weekly_scores(s, "assignment"),
    "daily_quiz_scores": lambda s: scores.daily_scores(s, "quiz"),
    "daily_assignment_scores": lambda s: scores.daily_scores(s, "assignment"),
    "activity_grid": progress.activity_grid,
    "block_progress": progress.block_progress,
    "reflection_feedback": reflections.reflection_feedback,
    "reflection_streaks": reflections.reflection_streaks,
    "badges": badges.badges,
}


def refresh_marts(src: Sources, root: str, names: Sequence[str] | None = None,
                  run_id: int | None = None) -> int:
    """Write the chosen marts (default: all) as one committed run; returns its id.

    Sorting inside each write task keeps the aggregation's partitioning (no
    extra shuffle); files come out ordered by student.
    """
    spark = src.enrollments.sparkSession
    run = run_id if run_id is not None else commits.new_run_id()
    wanted = list(names or MARTS)
    # Where the daily web mart is asked for, it is written first, and the weekly
    # summary and the wide daily metrics are computed from it: one read of the
    # click log.
    done: dict[str, T.StructType] = {}
    daily_web = None
    if "daily_web_activity" in wanted:
        done["daily_web_activity"] = _write(MARTS["daily_web_activity"](src), root, "daily_web_activity", run)
        daily_web = commits.read_run(spark, f"{root}/daily_web_activity", run, done["daily_web_activity"])
    # Blocks, grid and badges share the block masks: written once, read back.
    masks = None
    if sum(n in wanted for n in _FROM_MASKS) > 1:
        schema = _write(progress.block_masks(src), root, "_block_masks", run)
        masks = commits.read_run(spark, f"{root}/_block_masks", run, schema)
    for name in wanted:
        if name in done:
            continue
        if name in _FROM_DAILY_WEB and daily_web is not None:
            df = _FROM_DAILY_WEB[name](src, daily_web)
        elif name in _FROM_MASKS and masks is not None:
            df = _FROM_MASKS[name](src, masks)
        else:
            df = MARTS[name](src)
        done[name] = _write(df, root, name, run)
    commits.commit(spark, root, DATASET, run, done)
    return run


_FROM_MASKS = {
    "activity_grid": lambda s, m: progress.activity_grid(s, masks=m),
    "block_progress": lambda s, m: progress.block_progress(s, masks=m),
    "badges": lambda s, m: badges.badges(s, masks=m),
}
_FROM_DAILY_WEB = {
    "daily_metrics": lambda s, d: daily.daily_metrics_wide(s, daily_web=d),
    "weekly_summary": lambda s, d: summary.weekly_summary(s, daily_web=d),
}


def _write(df: DataFrame, root: str, name: str, run: int) -> T.StructType:
    order = [c for c in ("user_id", "course_id", "week", "block_start", "day") if c in df.columns]
    return commits.write_run(df.sortWithinPartitions(*order), f"{root}/{name}", run)


def read_mart(spark: SparkSession, root: str, name: str, run_id: int | None = None,
              user_id=None) -> DataFrame:
    """One mart from the latest committed refresh (optionally one student;
    the equality reaches the Parquet scan)."""
    found = commits.committed(spark, root, DATASET, run_id)
    if found is None:
        raise FileNotFoundError(f"no committed refresh under {root}")
    run, schemas = found
    df = commits.read_run(spark, f"{root}/{name}", run, schemas[name])
    return df if user_id is None else df.filter(F.col("user_id") == F.lit(user_id))


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--driver-dir", help="folder with the driver's events/part Parquet tables")
    parser.add_argument("--silver", help="folder with the silver tables (reference layout)")
    parser.add_argument("--reflection-log", help="Parquet reflection log (with --silver)")
    parser.add_argument("--out", required=True, help="shared folder for the marts")
    parser.add_argument("--marts", default="", help="comma list (default: all)")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.getOrCreate()
    if args.driver_dir:
        from ..config import DRIVER_TERM
        src = Sources.from_driver_tables(spark, args.driver_dir, DRIVER_TERM)
    elif args.silver:
        from ..sources.reflections import read_log
        log = read_log(spark, args.reflection_log) if args.reflection_log else None
        src = Sources.from_silver(spark, args.silver, reflection_log=log)
    else:
        parser.error("give --driver-dir or --silver")
    names = [n for n in args.marts.split(",") if n] or None
    run = refresh_marts(src, args.out, names)
    print(f"committed run {run} under {args.out}")


if __name__ == "__main__":
    main()
