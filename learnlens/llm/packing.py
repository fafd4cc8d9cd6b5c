"""Packing by concatenate and cut.

One pass tokenises every document and notes, in each partition, how many ids
precede it there. A prefix sum over the partitions' totals then gives every
document its place in one long stream, and fixed windows cut the stream.
A document that crosses a window's edge leaves a boundary record: one piece
on either side. Only the last window can be short.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

END_ID = 1


@functools.lru_cache(maxsize=4)
def encoder(path: str | None):
    """(ids of a text, the vocabulary's size) for a byte-level BPE file.

    The ids are those of ``tokenizers`` with add_special_tokens=False. The
    merges of such a file are numbered in the order of their ids, so tiktoken
    finds the same ids several times faster; a text that holds the spelling of
    a special token goes through ``tokenizers`` itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    # GPT-2's printable stand-ins for bytes: printable Latin-1 stands for itself.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items()
             if t not in special}
    fast = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})
    slow = Tokenizer.from_file(path)

    def ids(text: str) -> list[int]:
        if any(s in text for s in special):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids, max(max(ranks.values()), *spec_ids(spec)) + 1


def spec_ids(spec: dict) -> list[int]:
    return [t["id"] for t in spec["added_tokens"]] or [0]


ENCODED = "doc_id {id_type}, ids binary, n long, part long, before long"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           tokenizer: str | None = None) -> DataFrame:
    """Every row's ids with the end id (little-endian unsigned 32 bits),
    written to the shared folder once. Null text counts as empty."""
    schema = ENCODED.format(id_type=docs.schema[id_col].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, _ = encoder(tokenizer)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in common.slices(batch, "text"):
                blobs, ns, at = [], [], []
                for text in b.column("text").to_pylist():
                    ids = np.array([*ids_of(text or ""), END_ID], dtype="<u4")
                    blobs.append(ids.tobytes())
                    ns.append(len(ids))
                    at.append(before)
                    before += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(blobs, pa.binary()), pa.array(ns, pa.int64()),
                     pa.array([part] * len(ns), pa.int64()), pa.array(at, pa.int64())],
                    names=["doc_id", "ids", "n", "part", "before"])

    return common.written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .mapInArrow(run, schema), "ids")


def pieces(docs: DataFrame, window: int = 2048, id_col: str = "doc_id", text_col: str = "text",
           tokenizer: str | None = None) -> DataFrame:
    """Cut the stream of all documents into windows of ``window`` ids.

    Returns one row per piece: doc_id, start (ids of its document before it),
    length, doc_tokens, sequence_id, offset (place in the sequence), ids
    (binary, little-endian unsigned 32 bits) and ids_crc32 of them. Null and
    empty texts are documents of the end id alone; null and repeated doc_ids
    are documents like any other; an empty table gives no rows. Columns of
    ``docs`` beside the two named ones are ignored.

    The driver sees one number per input partition, never one per document.
    """
    enc = encode(docs, id_col, text_col, tokenizer)
    totals = {r.part: r.t for r in enc.groupBy("part").agg(F.sum("n").alias("t")).collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part] = at
        at += totals[part]
    id_type = enc.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long, ids binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            at = np.array([base[p] for p in batch.column("part").to_pylist()], np.int64)
            at += batch.column("before").to_numpy()
            first, last = at // window, (at + n - 1) // window
            many = last - first + 1
            row = np.repeat(np.arange(len(n)), many)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
            lo = np.maximum(seq * window, at[row])
            hi = np.minimum((seq + 1) * window, at[row] + n[row])
            start = lo - at[row]
            blobs = batch.column("ids")
            view = [memoryview(blobs[i].as_buffer()) for i in range(len(n))]
            cuts = [bytes(view[r][4 * a:4 * b]) for r, a, b in
                    zip(row.tolist(), start.tolist(), (start + hi - lo).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(hi - lo),
                 pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(n[row]),
                 pa.array(seq), pa.array(lo - seq * window), pa.array(cuts, pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                       "offset", "ids"])

    return enc.mapInArrow(cut, schema)


def sequences(cut: DataFrame) -> DataFrame:
    """The packed sequences: (sequence_id, ids binary, n_ids, n_pieces, and the
    boundary records as an array of (doc_id, start, offset, length))."""
    return (cut.groupBy("sequence_id")
            .agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
                 .alias("p"))
            .select("sequence_id",
                    F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
                    F.aggregate("p.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_ids"),
                    F.size("p").alias("n_pieces"),
                    F.transform("p", lambda x: F.struct(
                        x["doc_id"].alias("doc_id"), x["start"].alias("start"),
                        x["offset"].alias("offset"), x["length"].alias("length"))).alias("boundaries")))
