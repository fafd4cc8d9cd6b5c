"""Shared pieces of the operators: written intermediates, word splitting and
connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of letters and digits: everything but the other ASCII characters.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_own_folder: dict[str, str] = {}
_shipped: set[str] = set()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a scratch
    folder of our own only where the setting is absent (one-machine tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="learnlens-llm-")
    return _own_folder[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Cuts the lineage: what follows survives the loss of executors without
    recomputing ``df``, and sees one and the same version of it.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Like ``written``, dealt into buckets by ``key`` as it is written: later
    groupings and joins on the key take the table as it lies, without moving it."""
    spark = df.sparkSession
    name = f"llm_{label}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; the session's catalog is as before
    return table


def buckets_for(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Buckets for a table as large as ``df``: by Catalyst's size of it, and at
    least as many as shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(least, size // bytes_each), 100_000) if size < 1 << 60 else least


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit(""))), F.lit(n))


def hashed_share(key: str | Column, n: int, most: int) -> Column:
    """True for about ``most`` of ``n`` keys (all, if there are no more), chosen by
    a hash: no sort, and the same keys wherever the rows lie."""
    share = 1.0 if n <= most else most / n
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text: tells rows apart that share an id."""
    return F.xxhash64(id_col, text_col)


def keep_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str,
              once: bool = False, keep: bool = True) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, row_key) ``chosen`` has (or, without
    ``keep``, has not); with ``once``, one row of each that is repeated."""
    marked = docs.withColumn("__key", row_key(id_col, text_col))
    found = chosen.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__found"))
    if not once:
        found = found.distinct()
    same = (F.col("__key") == F.col("__found")) & F.col(id_col).eqNullSafe(F.col("__id"))
    out = marked.join(found, same, "left_semi" if keep else "left_anti")
    if once:  # combined where the rows lie, so a row repeated very often is no hot spot
        out = out.dropDuplicates(["__key", id_col])
    return out.select(*docs.columns)


def with_length(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the length column, where it has one, made to fit the text."""
    if length_col not in docs.columns:
        return docs
    return docs.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Text without other than ASCII characters
    takes ``lower``, which does the same there and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def alnum_words(text: Column) -> Column:
    """Lower-cased words of ``ALNUM_WORD``; null has no words."""
    return F.regexp_extract_all(
        ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ALNUM_WORD), F.lit(0))


def slices(batch: pa.RecordBatch, text: str, max_rows: int = 512,
           max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded rows and, but for single long texts,
    bounded bytes of ``text``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long), by alternating large and
    small stars; returns (node, root) with root the smallest node reachable.

    Nodes without an edge don't occur in the result. Self-edges, repeated and
    reversed edges are allowed. Every round is one written table; minima are
    aggregated on the map side, so a node with very many edges is no hot spot.
    """
    e = written(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("c"), F.least("a", "low").alias("low"))
        large = (both.where("b > a").join(low, F.col("a") == F.col("c"))
                 .where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "c")
        small = (large.join(low, F.col("a") == F.col("c"))
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                                           F.struct("a", F.col("low").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a <> b").distinct())
        e = written(small, "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("a")).distinct().select(
        F.col("a").alias("node"), F.col("a").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that their
    Python workers can import it wherever they start."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="learnlens-py-")) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
