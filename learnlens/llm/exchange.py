"""Distributed counts of 64-bit keys, asked for in blocks.

A chunk (a run of documents) asks for the totals of its distinct keys: the keys
go, sorted and delta coded, to the bucket of their hash range, the bucket adds
up what all chunks counted, and every chunk gets its totals back in the order
it asked. A key comes once from each chunk, so a very common one is no hot
spot, and all buckets are about equally full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a bucket gets, about; it holds some 60 bytes for each.
KEYS_A_BUCKET = 500_000


def mix(h: np.ndarray) -> np.ndarray:
    """Splitmix64's finisher."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bucket_count(df: DataFrame, keys: int) -> int:
    """Buckets for so many keys, and enough of them for every task."""
    return max(-(-keys // KEYS_A_BUCKET), 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pack(x: np.ndarray, code: zstandard.ZstdCompressor) -> bytes:
    """Non-negative numbers in the fewest whole bytes each, compressed."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    raw = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    body = raw.tobytes()
    # Delta coded hashes are noise; small counts compress well.
    return bytes([width]) + (body if width > 4 else code.compress(body))


def unpack(blob: bytes, code: zstandard.ZstdDecompressor) -> np.ndarray:
    width, body = blob[0], blob[1:]
    raw = np.frombuffer(body if width > 4 else code.decompress(body), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


REQUEST = "bucket int, chunk long, keys binary, counts array<binary>"


def requests(chunk: int, keys: np.ndarray, counts: list[np.ndarray], buckets: int, first: int) -> Iterator[tuple]:
    """Rows of REQUEST for sorted distinct keys; buckets are numbered from
    ``first``."""
    if not len(keys):
        return
    code = zstandard.ZstdCompressor(level=1)
    own = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    for a, b in zip(at, [*at[1:], len(own)], strict=True):
        k = keys[a:b]
        yield (first + int(own[a]), chunk, pack(np.r_[k[:1], k[1:] - k[:-1]], code),
               [pack(c[a:b], code) for c in counts])


def request_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary())), strict=True)],
        names=["bucket", "chunk", "keys", "counts"])


def totals(asked: DataFrame) -> DataFrame:
    """(chunk, bucket, totals, types): for each request the totals of its keys,
    one blob per count; and with chunk null, once per bucket, the number of
    keys whose total is not zero, by count."""

    def run(group: pa.Table) -> pa.Table:
        unzip, zipped = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        keys = [np.cumsum(unpack(k, unzip), dtype=np.uint64) for k in group.column("keys").to_pylist()]
        own = group.column("counts").to_pylist()
        ends = np.cumsum([len(k) for k in keys])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = []
        for j in range(len(own[0])):
            c = np.concatenate([unpack(row[j], unzip) for row in own]).astype(np.int64)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, place, c)
            sums.append(total)
        back = [[pack(s[place[b - len(k):b]], zipped) for s in sums] for k, b in zip(keys, ends, strict=True)]
        bucket = group.column("bucket")[0].as_py()
        n = len(keys)
        return pa.Table.from_arrays(
            [pa.array([*group.column("chunk").to_pylist(), None], pa.int64()), pa.array([bucket] * (n + 1), pa.int32()),
             pa.array([*back, None], pa.list_(pa.binary())),
             pa.array([None] * n + [[int((s > 0).sum()) for s in sums]], pa.list_(pa.int64()))],
            names=["chunk", "bucket", "totals", "types"])

    return asked.groupBy("bucket").applyInArrow(
        run, "chunk long, bucket int, totals array<binary>, types array<long>")


def answers(replies: pa.Table, buckets: int, first: int, n_counts: int) -> list[np.ndarray]:
    """A chunk's totals for the keys it asked of the buckets from ``first``, in
    the order of its keys."""
    unzip = zstandard.ZstdDecompressor()
    rows = sorted((b, t) for b, t in zip(replies.column("bucket").to_pylist(), replies.column("totals").to_pylist(), strict=True)
                  if first <= b < first + buckets)
    return [np.concatenate([unpack(t[j], unzip) for _, t in rows] or [np.zeros(0, np.uint64)]).astype(np.int64)
            for j in range(n_counts)]


def type_totals(replied: DataFrame, buckets: int, first: int, n_counts: int) -> list[int]:
    row = replied.where(F.col("chunk").isNull() & F.col("bucket").between(first, first + buckets - 1)).agg(
        *[F.sum(F.col("types")[j]).alias(f"t{j}") for j in range(n_counts)]).first()
    return [int(v or 0) for v in row]
