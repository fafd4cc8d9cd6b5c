"""WIN1: ``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order)`` that stays
parallel when one key holds a large share of all rows.

A plain window sends each key to one task. Here every row also belongs to a
slice: a function of its own values that never decreases along the order, such
as the minute of its time. Rows are numbered within (key, slice), a small table
of the slices' row counts gives each slice its offset within the key, and the
offsets travel with the rows. Nothing depends on how Spark happened to place rows,
so a recomputed or differently pruned branch finds the same slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minute_of(time: Column | str) -> Column:
    """The slice of a time: at most 1,440 slices a day."""
    return F.date_trunc("minute", F.col(time) if isinstance(time, str) else time)


def row_number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                      name: str = "seq_num", slice_by: Column | None = None) -> DataFrame:
    """Add ``name`` = 1-based row number of each row within its ``keys`` group.

    ``order`` must make the order total (end it with a unique column) so the
    numbering is deterministic and recomputable after an executor loss.
    ``slice_by`` must not decrease along ``order``; by default it is the minute
    of the first order column, which then is a time. Nulls, which sort first,
    are a slice of their own.
    """
    sliced = df.withColumn("_slice", minute_of(order[0]) if slice_by is None else slice_by)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                            F.lit(False).alias("_row"))
    # The offset goes before the rows of its key and slice, through the same exchange,
    # so the rows move once and nothing is joined.
    both = sliced.withColumn("_row", F.lit(True)).unionByName(offsets, allowMissingColumns=True)
    here = Window.partitionBy(*keys, "_slice").orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.first("_offset").over(here) + F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("_row", *order)) - 1
    return both.withColumn(name, number.cast("bigint")).where("_row").select(*df.columns, name)


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """SRT1: ``df`` sorted by ``keys`` and ``order``, with each row's place ``name`` among
    the rows of its keys, for keys with a bounded number of rows (a term's days).

    One range exchange by the keys does both: it brings a key's rows to one task, as
    the numbering needs, and the tasks into the order of the keys, so sorting within
    them sorts everything.
    """
    numbered = df.repartitionByRange(*keys).withColumn(
        name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return numbered.sortWithinPartitions(*keys, *order)
