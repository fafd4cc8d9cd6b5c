"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a structured random product code: after a random
rotation the dimensions fall into blocks, each block has a small random code,
and every combination of one word per block is a direction. A vector is list-
decoded to all directions whose inner product with it exceeds a threshold;
vectors that share a label and a direction are compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of a bucket that one comparison task holds; larger buckets are compared
#: block against block, all of them.
BLOCK = 512
#: Directions that a vector passes, on average. At a cosine of 0.98 a pair
#: shares more than half of them.
PASSED = 100
#: Directions that every vector has at least: where fewer exceed the threshold,
#: its own is lowered until so many do.
FEWEST = 50
#: Directions for each row: so many that unrelated vectors seldom meet.
SPARSE = 64
#: Shared directions that are broadcast, by their count; more are joined by a sort.
FEW = 50_000


class ProductCode:
    """The directions for ``n`` vectors of ``dim`` components. Below 8 components
    there is one direction, and all are compared with all, in blocks."""

    def __init__(self, dim: int, n: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.blocks = 2 if n <= 1 << 20 else 3
        self.words = 1 if dim < 8 else 1 << int(np.ceil(np.log2(max(1 << 14, SPARSE * n)) / self.blocks))
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.edges = [dim * b // self.blocks for b in range(self.blocks + 1)]
        self.codes = []
        for a, b in zip(self.edges, self.edges[1:], strict=False):
            c = rng.normal(size=(self.words, b - a))
            self.codes.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300))
        self.least = -9.0
        if self.words > 1:
            self.calibrate(rng.normal(size=(48, dim)))

    def calibrate(self, sample: np.ndarray) -> None:
        """Set the threshold so that random vectors pass PASSED on average."""
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        low, high = 0.0, np.sqrt(self.blocks)
        for _ in range(14):
            self.least = (low + high) / 2
            total = 0
            for inner in self.inner(unit):
                total += len(self.exceeding(inner, self.least, 2 * PASSED * len(unit)))
                if total > PASSED * len(unit):
                    break
            if total > PASSED * len(unit):
                low = self.least
            else:
                high = self.least
        self.least = high

    def inner(self, unit: np.ndarray) -> list[list[np.ndarray]]:
        """Each row's inner products with the words of each block."""
        x = unit @ self.rotation
        by_block = [x[:, a:b] @ c.T for (a, b), c in
                    zip(zip(self.edges, self.edges[1:], strict=False), self.codes, strict=True)]
        return [[p[r] for p in by_block] for r in range(len(x))]

    def exceeding(self, inner: list[np.ndarray], least: float, most: int | None = None) -> np.ndarray:
        """Numbers of the directions whose inner product is ``least`` or more,
        found block by block: a part is given up as soon as the best words of
        the blocks to come can't lift it. With ``most``, stops beyond so many
        parts (a count is then only known to be larger)."""
        rest = sum(p.max() for p in inner)
        sums, ids = np.zeros(1), np.zeros(1, np.int64)
        for p in inner:
            rest -= p.max()
            words = np.flatnonzero(p + sums.max(initial=-9.0) + rest >= least)
            if most is not None and len(words) * len(sums) > 64 * most:
                return np.zeros(most + 1, np.int64)
            s = sums[:, None] + p[words][None, :]
            i, j = np.nonzero(s + rest >= least)
            sums, ids = s[i, j], ids[i] * self.words + words[j]
        return np.sort(ids)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Each row's directions (sorted numbers): all that exceed the threshold."""
        out = []
        for inner in self.inner(unit):
            least = self.least
            found = self.exceeding(inner, least)
            while len(found) < min(FEWEST, self.words ** self.blocks):
                least -= 0.02 + 0.02 * abs(least)
                found = self.exceeding(inner, least)
            out.append(found)
        return out


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): v holds the components as little-endian doubles, or
    null where the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v, label in zip(b.column("v").to_pylist(), b.column("label").is_null().to_pylist(), strict=True):
                x = np.array(v, "<f8") if v and not label and None not in v else None
                ok = x is not None and np.isfinite(x).all() and x.any()
                out.append(x.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "v"])

    plain = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                        F.col(vector_col).cast("array<double>").alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    return plain.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v binary")


def unit_rows(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def listed(classes: DataFrame, code: ProductCode) -> DataFrame:
    """(cid, label, n, v, passed): each class with its list of directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                passed = code.decode(unit_rows(b.column("v").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(passed, pa.list_(pa.int64()))], names=[*b.schema.names, "passed"])

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("cid", "label", "n", "v").mapInArrow(
        run, f"cid long, label {kind}, n long, v binary, passed array<long>")


def linked(classes: DataFrame, code: ProductCode, least: float, block: int = BLOCK) -> DataFrame:
    """What the comparisons find: (cid, more, other). more: rows linked to
    class cid beside its own; other: a class that it is connected with (null:
    none). Only directions that two classes or more pass go on, and vectors
    travel for those alone. Pairs are counted in the smallest direction that
    they share, and a task emits counts and a spanning forest, never its pairs.

    The joins say themselves how they go: Spark takes a list for one direction and a
    table for the size of its files, and would broadcast what the driver can't hold.
    """
    lists = common.written(listed(classes, code), "listed")
    members = lists.select("label", "cid", F.explode("passed").alias("direction"))
    shared = common.written(
        members.groupBy("label", "direction").agg(F.count("*").alias("m")).where("m > 1")
        .select("label", "direction", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "shared")
    dealt = (members.join(shared.hint("broadcast" if shared.count() <= FEW else "merge"), ["label", "direction"])
             .withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .join(lists.select("cid", "n", "v", "passed").hint("merge"), "cid")
             .groupBy("label", "direction", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"))
             .agg(F.collect_list(F.struct("own", "cid", "n", "v", "passed")).alias("x"))
             .select("direction", (F.col("lo") != F.col("hi")).alias("across"), "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x")
            off, field = x.offsets.to_numpy(), {n: x.values.field(n) for n in ("own", "cid", "n", "v", "passed")}
            own, cid, n = (field[c].to_numpy() for c in ("own", "cid", "n"))
            parts = []
            for g, (direction, across) in enumerate(zip(b.column("direction").to_pylist(), b.column("across").to_pylist(), strict=True)):
                s = slice(off[g], off[g + 1])
                found = compare(field["v"][s].to_pylist(), field["passed"][s].to_pylist(), n[s],
                                own[s] if across else None, direction, least)
                if found is not None:
                    more, i, j = found
                    some = np.flatnonzero(more)
                    parts.append((cid[s][some], more[some], np.full(len(some), -1)))
                    parts.append((cid[s][i], np.zeros(len(i), np.int64), cid[s][j]))
            if parts:
                c, m, o = (np.concatenate(p) for p in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c), pa.array(m), pa.array(o, mask=o < 0)], names=["cid", "more", "other"])

    return dealt.mapInArrow(run, "cid long, more long, other long")


def meet_before(passed: list[list[int]], direction: int) -> np.ndarray:
    """Which rows share a direction below ``direction``, as a matrix: one product of a
    0/1 matrix of rows and directions with itself, some directions at a time."""
    lists = [np.array(p, np.int64) for p in passed]
    lists = [p[p < direction] for p in lists]
    row = np.repeat(np.arange(len(lists)), [len(p) for p in lists])
    _, place, often = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    row, place = row[often[place] > 1], place[often[place] > 1]  # others are in one row alone
    out = np.zeros((len(lists), len(lists)), bool)
    kept, place = np.unique(place, return_inverse=True)
    for at in range(0, len(kept), 4096):
        here = (place >= at) & (place < at + 4096)
        table = np.zeros((len(lists), min(4096, len(kept) - at)), np.float32)
        table[row[here], place[here] - at] = 1
        out |= table @ table.T > 0
    return out


def compare(blobs, passed, n, own, direction, least):
    """None without a link whose first common direction this one is; else (rows linked
    to each class by such links, a spanning forest i, j of them). Every link is first
    in one direction, so no link is counted twice and the forests of all directions
    connect what the links connect."""
    u = unit_rows(blobs)
    near = np.triu(u @ u.T >= least, 1)
    if own is not None:
        near &= own[:, None] != own[None, :]
    rows = np.flatnonzero(near.any(axis=0) | near.any(axis=1))
    if not len(rows):
        return None
    near = near[np.ix_(rows, rows)]
    near |= near.T
    first = near & ~meet_before([passed[r] for r in rows.tolist()], direction)
    if not first.any():
        return None
    more = np.zeros(len(blobs), np.int64)
    more[rows] = first @ n[rows]
    todo, i, j = np.ones(len(rows), bool), [], []
    for start in range(len(rows)):
        frontier = [start] if todo[start] else []
        todo[start] = False
        while frontier:
            at = frontier.pop()
            found = np.flatnonzero(first[at] & todo)
            todo[found] = False
            i.append(np.full(len(found), at))
            j.append(found)
            frontier.extend(found.tolist())
    return more, rows[np.concatenate(i)], rows[np.concatenate(j)]


def near_duplicates(rows: DataFrame, least: float = 0.98, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors are compared only within a label, by cosine in double precision.
    Null vectors or labels, zero vectors and vectors with null or non-finite
    components link with nothing: n_links 0 and themselves as component. Equal
    vectors count as one class of copies and link with each other. A null
    vec_id links, but names a component only if it has no other id. Vectors
    of other lengths than the most frequent one's label mates are compared
    with their own length only. An empty table gives no rows.
    """
    base = common.written(valid_vectors(rows, id_col, vector_col, label_col), "vectors")
    classes = common.written(
        base.where("v is not null").groupBy("label", "v")
        .agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy((F.octet_length("v") / 8).cast("int").alias("dim")).agg(F.count("*").alias("n")).collect()
    found = None
    for s in sizes:
        mine = classes.where(F.octet_length("v") == 8 * s.dim)
        part = linked(mine, ProductCode(s.dim, s.n), least)
        found = part if found is None else found.union(part)
    if found is None:
        return unlinked(base).withColumn("kept", F.col("vec_id").isNotNull())
    found = common.written(found, "links")
    more = found.groupBy("cid").agg(F.sum("more").alias("more")).withColumnRenamed("cid", "c1")
    roots = common.components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    named = classes.join(roots, F.col("cid") == F.col("node"), "left").select(
        "cid", "label", "v", "low", "n", F.coalesce("root", "cid").alias("root"))
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    per_class = (named.join(names, "root").join(more, F.col("cid") == F.col("c1"), "left")
                 .select(F.col("label").alias("l"), F.col("v").alias("w"), "component_id",
                         (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")))
    # A left join, as only its right side can be broadcast: many copies make a small file.
    valid = (base.where("v is not null").join(per_class, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
             .select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id"))
    return (valid.union(unlinked(base))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def unlinked(base: DataFrame) -> DataFrame:
    return base.where("v is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
