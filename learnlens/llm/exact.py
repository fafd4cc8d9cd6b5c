"""Exact duplicates by composable polynomial fingerprints.

A text's bytes b0, b1, ... have the fingerprint sum(b_i * BASE^i) modulo the prime
2^61 - 1. That of a chunk, shifted by BASE to the chunk's offset, is its share in the
whole text's, so chunks of a huge text are hashed in different tasks and added
up in any order. Texts equal in length and fingerprint are then compared for
real, chunk against chunk: equal chunks collapse as they meet, and a place where
two different chunks are left over splits the group.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PRIME = (1 << 61) - 1
BASE = 0x13198A2E03707344 % PRIME
#: Bytes hashed and compared at a time.
CHUNK = 1 << 16
#: Texts beyond this many bytes are hashed by several tasks.
HUGE = 8 * CHUNK
#: Size up to which repeated fingerprints are broadcast; with more of them the
#: rows are joined by a shuffle.
MAX_BROADCAST_BYTES = 16 << 20
#: Fingerprints with over this share of all rows are joined on their own; no more
#: than 1 / HOT_SHARE can exist.
HOT_SHARE = 0.001


class Hasher:
    """Fingerprints of runs of bytes, for one base."""

    def __init__(self, base: int = BASE, chunk: int = CHUNK) -> None:
        powers = np.empty(chunk, object)
        p = 1
        for i in range(chunk):
            powers[i], p = p, p * base % PRIME
        self.base, self.chunk = base, chunk
        self.low = (powers & 0xFFFFFFFF).astype(np.uint64)
        self.high = (powers >> 32).astype(np.uint64)

    def runs(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Fingerprints of the runs of ``data`` (bytes), none longer than a chunk."""
        out = np.zeros(len(sizes), np.uint64)
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        starts, sizes = starts[full], sizes[full]
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        b = data[place + np.repeat(starts, sizes)].astype(np.uint64)
        # Sums of 2^16 products below 2^40 stay below 2^56.
        low = np.add.reduceat(b * self.low[place], first) % PRIME
        high = np.add.reduceat(b * self.high[place], first) % PRIME
        out[full] = (low + shifted(high)) % PRIME
        return out

    def at(self, fingerprint: int, offset: int) -> int:
        """The share of a run at this offset in the whole text's fingerprint."""
        return fingerprint * pow(self.base, offset, PRIME) % PRIME

    def texts(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Fingerprints of whole texts of any size, chunk by chunk."""
        short = sizes <= self.chunk
        out = np.zeros(len(sizes), np.uint64)
        out[short] = self.runs(data, starts[short], sizes[short])
        for i in np.flatnonzero(~short).tolist():
            at = np.arange(0, int(sizes[i]), self.chunk)
            parts = self.runs(data, starts[i] + at, np.minimum(sizes[i] - at, self.chunk))
            out[i] = sum(map(self.at, parts.tolist(), at.tolist())) % PRIME
        return out


def shifted(x: np.ndarray) -> np.ndarray:
    """x * 2^32 modulo 2^61 - 1 for x below it: a rotation of 61 bits."""
    return ((x << np.uint64(32)) & np.uint64(PRIME)) | (x >> np.uint64(29))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, sizes) of a string or binary column without nulls."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), off[:-1], np.diff(off)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 carry: Mapping[str, Column] | None = None, base: int = BASE,
                 chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """(row, doc_id, n_bytes, fp, the ``carry`` columns) of every row, written;
    ``row`` is a number of its own for each. Null texts count as empty."""
    carry = carry or {}
    named = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        *[c.alias(n) for n, c in carry.items()], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields[:-1])
    keep = named.columns[:-1]

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(base, chunk)
        for batch in batches:
            for b in common.slices(batch, "text", max_rows=4096, max_bytes=1_000_000):
                data, starts, sizes = _bytes(b.column("text"))
                small = sizes <= huge
                fp = hasher.texts(data, starts[small], sizes[small])
                own = pa.array(np.flatnonzero(small))
                none = pa.nulls(len(own), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).take(own) for c in keep], pa.array(sizes[small]), pa.array(np.zeros(len(own), np.int64)),
                     pa.array(fp.view(np.int64)), none], names=[*keep, "n_bytes", "at", "share", "bytes"])
                for i in np.flatnonzero(~small).tolist():
                    for at in range(0, int(sizes[i]), chunk):
                        part = data[starts[i] + at:starts[i] + min(at + chunk, int(sizes[i]))].tobytes()
                        yield pa.RecordBatch.from_arrays(
                            [*[b.column(c).slice(i, 1) for c in keep], pa.array([int(sizes[i])]), pa.array([at]),
                             pa.array([None], pa.int64()), pa.array([part], pa.binary())],
                            names=[*keep, "n_bytes", "at", "share", "bytes"])

    def chunk_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(base, chunk)
        for b in batches:
            fps = hasher.runs(*_bytes(b.column("bytes"))).tolist()
            out = [hasher.at(f, at) for f, at in zip(fps, b.column("at").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in [*keep, "n_bytes"]], pa.array(out, pa.int64())],
                names=[*keep, "n_bytes", "share"])

    parts = common.written(
        named.mapInArrow(shares, f"{kept}, n_bytes long, at long, share long, bytes binary"), "shares")
    dealt = parts.where("bytes IS NOT NULL").repartition("row", "at").mapInArrow(
        chunk_shares, f"{kept}, n_bytes long, share long")
    added = dealt.groupBy("row", "n_bytes").agg(
        *[F.first(c).alias(c) for c in keep[1:]],  # all chunks of a row have the same
        (F.sum(F.col("share").cast("decimal(38,0)")) % F.lit(PRIME)).cast("long").alias("fp"))
    own = [*keep, "n_bytes", "fp"]
    whole = parts.where("bytes IS NULL").withColumnRenamed("share", "fp").select(*own)
    return common.written(whole.unionByName(added.select(*own)), "fingerprints")


def _with_text(docs: DataFrame, text_col: str, base: int, chunk: int, carry: Mapping[str, Column]) -> DataFrame:
    """(the ``carry`` columns, n_bytes, fp, text) of every row: the fingerprints
    beside the texts, for the comparison."""
    named = docs.select(*[c.alias(n) for n, c in carry.items()],
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(base, chunk)
        for batch in batches:
            for b in common.slices(batch, "text", max_rows=4096, max_bytes=1_000_000):
                data, starts, sizes = _bytes(b.column("text"))
                fp = hasher.texts(data, starts, sizes).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(sizes), pa.array(fp)], names=[*b.schema.names, "n_bytes", "fp"])

    return named.mapInArrow(run, f"{kept}, n_bytes long, fp long")


def _lookup(rows: DataFrame, groups: DataFrame, on: list[str], n_groups: int, total: int,
            max_bytes: int) -> DataFrame:
    """``rows`` left-joined to the distinct ``groups`` (which count their rows in
    ``n``); without nulls in ``on``. Groups within ``max_bytes`` are broadcast. Beyond
    that only the hot ones are, whose number is bounded, and their rows spread
    evenly through the shuffle that joins the others."""
    if n_groups * 100 <= max_bytes:
        return rows.join(F.broadcast(groups), on, "left")
    hot = F.col("n") > HOT_SHARE * total
    few = groups.where(hot).withColumn("_hot", F.lit(True))
    own = [c for c in groups.columns if c not in on]
    marked = rows.join(F.broadcast(few.select(*on, "_hot", *[F.col(c).alias(f"_{c}") for c in own])), on, "left")
    marked = marked.withColumn("_hot", F.coalesce("_hot", F.lit(False))).withColumn(
        "_spread", F.when(F.col("_hot"), F.monotonically_increasing_id()).otherwise(0))
    rest = groups.where(~hot).withColumn("_hot", F.lit(False)).withColumn("_spread", F.lit(0).cast("long"))
    joined = marked.join(rest, [*on, "_hot", "_spread"], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_{c}", c).alias(c) for c in own])


def _chunks(members: DataFrame, chunk: int, *keep: str) -> DataFrame:
    """A row for each chunk of each text, with its place ``at``."""
    last = F.floor(F.greatest(F.col("n_bytes") - 1, F.lit(0)) / chunk)
    return members.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        *keep, "at", F.substring(F.col("text").cast("binary"), (F.col("at") * chunk + 1).cast("int"),
                                 F.lit(chunk)).alias("bytes"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            carry: Mapping[str, Column] | None = None, base: int = BASE, chunk: int = CHUNK,
            huge: int = HUGE, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, fp, keep_id (the largest doc_id
    of the rows with the same text), group_size, kept (true for one row of each
    text) and the ``carry`` columns.

    A null text counts as empty, and empty texts are equal. A null doc_id is
    smaller than any other; where the largest id is repeated or null, exactly
    one of its rows is kept. Texts of any length are compared whole; an empty
    table gives no rows; other columns of ``docs`` are ignored, whatever their names.

    Fingerprints only propose. The texts of repeated ones meet chunk by chunk in
    an aggregation that collapses equal chunks in the task that reads them, so
    many copies cost little and no task gets a whole group; if chunks at one place
    differ, the group is split by its texts' chunks.
    """
    carry = dict(carry or {})
    on = ["n_bytes", "fp"]
    prints = fingerprints(docs, id_col, text_col, carry, base, chunk, huge)
    total = prints.count()

    def grouped(rows: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
        found = common.written(rows.groupBy(*by).agg(
            F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("top")).where("n > 1"), "repeated")
        return found, found.count()

    def result(rows: DataFrame, groups: DataFrame, by: list[str], n_groups: int) -> DataFrame:
        every = _lookup(rows, groups, by, n_groups, total, max_broadcast)
        alone = F.col("n").isNull()
        return every.select(
            "doc_id", *on, F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            (alone | (F.col("row") == F.col("top.row"))).alias("kept"), *carry)

    groups, n_groups = grouped(prints, on)
    found = _lookup(_with_text(docs, text_col, base, chunk, {}), groups.select(*on, "n"), on, n_groups, total, max_broadcast)
    meeting = _chunks(found.where("n IS NOT NULL"), chunk, *on)
    split = common.written(
        meeting.distinct().groupBy(*on, "at").count().where("count > 1").select(*on).distinct(), "split")
    n_split = split.count()
    same = result(prints, groups, on, n_groups)
    if not n_split:
        return same

    # Different texts share a length and fingerprint: their rows are told apart
    # by their chunks, each named after the first row that holds it.
    mixed = split.join(groups.select(*on, "n"), on)
    again = {"row": F.monotonically_increasing_id(), "doc_id": F.col(id_col)} | carry
    members = common.written(_lookup(_with_text(docs, text_col, base, chunk, again), mixed, on, n_split, total,
                                     max_broadcast).where("n IS NOT NULL"), "members")
    pieces = common.written(_chunks(members, chunk, "row", *on), "pieces")
    names = pieces.groupBy(*on, "at", "bytes").agg(F.min("row").alias("name"))
    named = pieces.join(names, [*on, "at", "bytes"]).groupBy("row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))),
                                 lambda x: x["name"].cast("string")), ",").alias("text_no"))
    told = members.drop("text", "n").join(named, "row")
    by = [*on, "text_no"]
    apart, n_apart = grouped(told, by)
    return same.join(split, on, "left_anti").unionByName(result(told, apart, by, n_apart))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, all columns: the one with the largest
    doc_id. Rows equal in id and text are first collapsed to one of them."""
    sha, own, name = (f"_{n}_{uuid.uuid4().hex}" for n in ("sha", "kept_sha", "id"))  # clash with no column
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    kept = classes(docs, id_col, text_col, {own: digest}).where("kept").select(F.col("doc_id").alias(name), own)
    once = docs.withColumn(sha, digest).dropDuplicates([id_col, sha])
    same = F.col(id_col).eqNullSafe(F.col(name)) & (F.col(sha) == F.col(own))
    return once.join(kept, same, "left_semi").select(*docs.columns)
