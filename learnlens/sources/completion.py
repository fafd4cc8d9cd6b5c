"""SNK4: block-completion snapshots and the changes between two of them.

The reference flips one flag in a shared JSON file when a student views a
block. Here completion is computed for every block at once, each run writes
a new snapshot partition (never overwriting the one being read), and the
change feed compares the new snapshot with the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits

KEYS = ("user_id", "course_id", "block_start")


def completion_snapshot(block_progress: DataFrame) -> DataFrame:
    """(user_id, course_id, block_start, completed) from block progress."""
    return block_progress.select(*KEYS, F.col("is_complete").alias("completed"))


def completion_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Blocks whose flag flipped: ``set`` (now complete, was not) or
    ``cleared`` (was complete, is not any more). A block missing from a
    snapshot counts as not complete.

    Both snapshots meet in one aggregation keyed by block (no outer join).
    """
    cur = current.select(*KEYS, F.col("completed").alias("_now"))
    prev = previous.select(*KEYS, F.col("completed").alias("_was"))
    both = cur.unionByName(prev, allowMissingColumns=True)
    flags = both.groupBy(*KEYS).agg(
        F.coalesce(F.bool_or("_now"), F.lit(False)).alias("now"),
        F.coalesce(F.bool_or("_was"), F.lit(False)).alias("was"))
    change = F.when(F.col("now") & ~F.col("was"), "set").when(~F.col("now") & F.col("was"), "cleared")
    return flags.select(*KEYS, change.alias("change")).filter(F.col("change").isNotNull())


def write_snapshot(snapshot: DataFrame, root: str, snapshot_id: int | None = None) -> int:
    """Write one snapshot as run ``snapshot_id`` under ``root`` and commit it.

    A new id per run: earlier snapshots stay readable while this one is
    written, and a failed run is never committed, so readers keep using the
    last complete snapshot.
    """
    run = snapshot_id if snapshot_id is not None else commits.new_run_id()
    schema = commits.write_run(snapshot, f"{root}/data", run)
    commits.commit(snapshot.sparkSession, root, "completion", run, {"data": schema})
    return run


def read_latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest committed snapshot (reads that run's folder alone)."""
    found = commits.committed(spark, root, "completion")
    if found is None:
        raise FileNotFoundError(f"no committed completion snapshot under {root}")
    run, schemas = found
    return commits.read_run(spark, f"{root}/data", run, schemas["data"])


FLAG_DOCUMENT = "map<string,map<string,map<string,string>>>"


def import_flags(documents: DataFrame) -> DataFrame:
    """Existing completion flags as a snapshot, row by row: ``documents`` holds
    JSON texts (column ``value``) of ``{student: {course: {block: flag}}}``,
    where a block is named by its first week (other text before it is ignored).
    """
    rows = documents.select(F.explode(F.from_json("value", FLAG_DOCUMENT)).alias("user_id", "c")) \
        .select("user_id", F.explode("c").alias("course", "b")) \
        .select("user_id", "course", F.explode("b").alias("block", "flag"))
    return rows.select(
        "user_id", F.col("course").try_cast("bigint").alias("course_id"),
        F.regexp_extract("block", r"([0-9]+)", 1).try_cast("bigint").alias("block_start"),
        F.coalesce(F.lower(F.trim("flag")).isin("true", "1", "yes"), F.lit(False)).alias("completed")) \
        .where("course_id is not null and block_start is not null") \
        .groupBy(*KEYS).agg(F.bool_or("completed").alias("completed"))
