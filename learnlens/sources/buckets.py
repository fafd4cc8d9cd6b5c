"""Marts that lie bucketed and sorted by student and course, so that what groups or
joins by these two moves nothing when it reads them.

A bucketed mart is a run of :mod:`learnlens.sources.commits` like any other; its
number of buckets travels with the committed schema. Spark knows buckets of
tables only, so reading names the folder as a table for a moment; nothing stays in
the catalog.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import commits

KEYS = ("user_id", "course_id")


def write(df: DataFrame, path: str, run: int, buckets: int, sort_by: tuple[str, ...] = ()) -> T.StructType:
    """Write ``df`` as run ``run`` of ``path``, one file a bucket; returns the schema
    for the commit."""
    name = f"bucketed_{uuid.uuid4().hex}"
    spark = df.sparkSession
    df.repartition(buckets, *KEYS).write.format("parquet").mode("overwrite").options(
        path=commits.run_path(path, run), **commits.bloom_options(df.columns)) \
        .bucketBy(buckets, *KEYS).sortBy(*KEYS, *sort_by).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalog; the files stay
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable,
                                       {"buckets": buckets} if f.name == KEYS[0] else f.metadata) for f in df.schema])


def read(spark: SparkSession, path: str, run: int, schema: T.StructType) -> DataFrame:
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    keys = ", ".join(KEYS)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
              f"INTO {schema[KEYS[0]].metadata['buckets']} BUCKETS LOCATION '{commits.run_path(path, run)}'")
    df = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return df
