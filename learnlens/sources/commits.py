"""A commit log for datasets that are rewritten as a whole each run.

Each run writes its rows to a folder of its own, ``<path>/run_id=<id>``, and,
only after every write of the run has finished, appends one row to
``<root>/_commits``: the run and the schemas of its datasets. Readers take the
latest committed run and read that folder alone with the committed schema, so a
run that fails half-way (or is still running) is never seen, types are never
inferred, and an empty dataset reads back as empty. Writing a run again
replaces its folder.
"""

from __future__ import annotations

import json
import secrets
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Times in text formats keep their microseconds.
_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: The column by which one student's rows are asked for.
STUDENT = "user_id"
_SCHEMA = "dataset string, run_id bigint, committed_at timestamp, schemas map<string,string>"


def bloom_options(columns: list[str]) -> dict[str, str]:
    """Writer options for a Bloom filter on the student's id in every row group: a
    request for one student then skips the row groups that lack them, also where
    the id lies between the group's smallest and largest. Filters take the size that
    the group's ids need."""
    if STUDENT not in columns:
        return {}
    return {f"parquet.bloom.filter.enabled#{STUDENT}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def new_run_id() -> int:
    """Increasing across runs: milliseconds since the epoch and three random
    digits, so that two writers don't share one."""
    return int(time.time() * 1000) * 1000 + secrets.randbelow(1000)


def run_path(path: str, run_id: int) -> str:
    return f"{path}/run_id={run_id}"


def write_run(df: DataFrame, path: str, run_id: int, partition_by: tuple[str, ...] = (),
              fmt: str = "parquet") -> T.StructType:
    """Write ``df`` as run ``run_id`` of ``path`` (earlier runs stay readable; the
    same run is replaced); returns its schema for the commit."""
    options = _OPTIONS | (bloom_options(df.columns) if fmt == "parquet" else {})
    df.write.mode("overwrite").partitionBy(*partition_by).options(**options).format(fmt).save(run_path(path, run_id))
    return df.schema


def commit(spark: SparkSession, root: str, dataset: str, run_id: int,
           schemas: dict[str, T.StructType]) -> None:
    rows = [(dataset, run_id, {n: s.json() for n, s in schemas.items()})]
    spark.createDataFrame(rows, "dataset string, run_id bigint, schemas map<string,string>") \
        .withColumn("committed_at", F.current_timestamp()).select(*[c.split()[0] for c in _SCHEMA.split(", ")]) \
        .coalesce(1).write.mode("append").parquet(f"{root}/_commits")


def committed(spark: SparkSession, root: str, dataset: str, run_id: int | None = None
              ) -> tuple[int, dict[str, T.StructType]] | None:
    """The newest committed run of ``dataset`` (or the given one) and its
    schemas; None before the first commit. One row comes to the driver."""
    try:
        log = spark.read.schema(_SCHEMA).parquet(f"{root}/_commits")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    log = log.filter(F.col("dataset") == dataset)
    if run_id is not None:
        log = log.filter(F.col("run_id") == run_id)
    row = log.orderBy(F.desc("run_id")).first()
    if row is None:
        return None
    return row.run_id, {n: T.StructType.fromJson(json.loads(s)) for n, s in row.schemas.items()}


def latest_run(spark: SparkSession, root: str, dataset: str) -> int | None:
    found = committed(spark, root, dataset)
    return found[0] if found else None


def read_run(spark: SparkSession, path: str, run_id: int, schema: T.StructType,
             fmt: str = "parquet") -> DataFrame:
    """The rows of one run, by the schema it was written with."""
    return spark.read.schema(schema).options(**_OPTIONS).format(fmt).load(run_path(path, run_id)).select(*schema.fieldNames())
