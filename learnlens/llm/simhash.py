"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits are compared through 2^(r+1) - 1 structured bit masks.
Each bit position gets a non-zero vector of r+1 bits, and the mask of a vector
v holds the positions whose vectors have an odd overlap with v. The vectors of
any r differing positions span at most r dimensions, so some non-zero v is
orthogonal to all of them: its mask leaves out every differing bit, and the
pair collides in that table. Nothing within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Distinct fingerprints that one comparison task holds from a bucket; larger
#: buckets are compared block against block, all of them.
BLOCK = 2000


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of every run of ``words`` words; fewer words are one run."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    h = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [h(joined, SEED)]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    return [h(joined[a:b], SEED)
            for a, b in zip((end - size)[:1 - words].tolist(), end[words - 1:].tolist(), strict=True)]


def majority(hashes: list[int]) -> int:
    """Bits that are set in over half of the hashes; 0 without any."""
    if not hashes:
        return 0
    h = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, fp) of every row; fp is the fingerprint as a signed
    long. Null texts and texts without words have fingerprint zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.slices(batch, "text"):
                fp = np.array([majority(shingle_hashes(t or "", words))
                               for t in b.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("row_key"), pa.array(fp.view(np.int64))],
                    names=["doc_id", "row_key", "fp"])

    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        common.row_key(id_col, text_col).alias("row_key"),
    ).mapInArrow(run, f"doc_id {kind}, row_key long, fp long")


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """The masks, as signed longs. Positions are dealt evenly over the
    non-zero vectors, so every mask keeps about half of the bits."""
    n = (1 << (radius + 1)) - 1
    vector = np.random.default_rng(seed).permutation(np.arange(64) % n) + 1
    masks = []
    for v in range(1, n + 1):
        bits = sum(1 << i for i in range(64) if bin(int(vector[i]) & v).count("1") % 2)
        masks.append(bits - (1 << 64) if bits >= 1 << 63 else bits)
    return masks


def links(fps: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of ``fps`` (fp: long) that
    connect exactly what pairs within ``radius`` bits connect.

    In each bucket a task compares at most two blocks and emits a spanning
    forest of the pairs within the radius, never the pairs themselves. Buckets
    over ``block`` rows are dealt into blocks by a hash and every two blocks
    meet in a task of their own, so no task grows with the largest bucket.
    """
    tables = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(covering_masks(radius))])).alias("m")).select("fp", "m.t", "m.key")
    full = (tables.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
            .select("t", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    dealt = (tables.join(full, ["t", "key"])
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("t", "key", F.least("own", "other").alias("lo"),
                     F.greatest("own", "other").alias("hi"),
                     F.struct(F.col("own"), F.col("fp")).alias("x")))
    groups = dealt.groupBy("t", "key", "lo", "hi").agg(F.collect_list("x").alias("x")).select("lo", "hi", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            off = x.offsets.to_numpy()
            own = x.values.field("own").to_numpy()
            fp = x.values.field("fp").to_numpy().view(np.uint64)
            differ = (batch.column("lo").to_numpy() != batch.column("hi").to_numpy()).tolist()
            a, b = [], []
            for i, across in enumerate(differ):
                lo, hi = off[i], off[i + 1]
                if hi - lo == 2:
                    if int(fp[lo] ^ fp[lo + 1]).bit_count() <= radius:
                        a.append(fp[lo:lo + 1])
                        b.append(fp[lo + 1:hi])
                    continue
                u, v = forest(fp[lo:hi], own[lo:hi] if across else None, radius)
                a.append(u)
                b.append(v)
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(s).view(np.int64)) for s in (a, b)], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def forest(fp: np.ndarray, own: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the radius; of two blocks, only
    pairs across them count (each block meets itself in another task)."""
    n = len(fp)
    todo, u, v = np.ones(n, bool), [], []
    for start in range(n):
        if not todo[start]:
            continue
        todo[start] = False
        frontier = [start]
        while frontier:
            at = frontier.pop()
            rest = np.flatnonzero(todo if own is None else todo & (own != own[at]))
            found = rest[np.bitwise_count(fp[rest] ^ fp[at]) <= radius]
            if len(found):
                todo[found] = False
                u.append(np.full(len(found), fp[at]))
                v.append(fp[found])
                frontier.extend(found.tolist())
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(u), np.concatenate(v)) if u else (empty, empty)


def classes(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``prints`` (written; fp, doc_id) with component_id, the smallest doc_id
    reachable over links of at most ``radius`` differing bits, and root, a
    fingerprint that names the component even where ids don't.

    Copies collapse to one fingerprint first. Null doc_ids take part and link
    like others, but name a component only if it has no other id (then null).
    """
    by_fp = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = common.components(links(by_fp.select("fp"), radius))
    named = by_fp.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = named.join(names, "root").select("fp", "root", "component_id")
    return prints.join(of_fp, "fp")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, fp, fingerprint, component_id) for every row.

    fingerprint is 16 lowercase hex digits. Null and empty texts have
    fingerprint zero, which links like any other; repeated rows are copies;
    an empty table gives no rows; other columns of ``docs`` are ignored.
    """
    prints = common.written(fingerprints(docs, words, id_col, text_col), "simhash")
    return classes(prints, radius).select(
        "doc_id", "row_key", "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, all columns: a row with the smallest
    id, and exactly one where that id or the row is repeated. Ids may be shared by
    different components, and null; a null id stands for a component only if it
    has no other. An empty table gives no rows."""
    prints = common.written(fingerprints(docs, words, id_col, text_col), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    chosen = classes(prints, radius).groupBy("root").agg(first).select("first.doc_id", "first.row_key")
    return common.keep_rows(docs, chosen, id_col, text_col, once=True)
