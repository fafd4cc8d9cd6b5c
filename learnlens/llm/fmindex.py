"""Passages that repeat an earlier document, by FM-indexes on shards.

Two equal windows share their minimizer (the smallest hash of the k-grams in
them). Windows whose minimizer occurs in one document alone can't repeat; the
others go, joined to runs that share a minimizer, to the shard of that
minimizer. A shard indexes its distinct runs: suffix order, the transform's
wavelet matrix, backward search. Its matching statistics tell for every window
of a run the smallest document in which the window occurs. Windows of a minimizer
that very many documents hold travel as 64-bit keys, each once per chunk with its
smallest document; the least of all chunks comes back, and the chunk marks its own
occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, exchange
from .lm import word_hashes

GRAM = 5
CHUNK_WORDS = 1_500_000
#: Words of the corpus for which there is one shard; about a third go there.
SHARD_WORDS = 600_000
#: Documents that hold a minimizer from which on its windows travel as keys.
COMMON = 500
#: Spans up to which they are broadcast to the texts (24 bytes each).
BROADCAST_SPANS = 2_000_000
NO_ID = np.iinfo(np.int64).max


# ---- the index of a shard


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        c = np.arange(size)
        self.begin = self.walk(c, np.zeros(size, np.int64))

    def walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros, strict=True):
            ones = bits.ones(i)
            i = np.where((c >> level) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c occurs before place i."""
        return self.walk(c, i) - self.begin[c]


class FMIndex:
    """An index of a text of numbers 1.. with 0 as the separator, for patterns
    of up to ``depth`` symbols: suffixes are ordered by their first ``depth``
    symbols, which is all that a search for such patterns tells apart."""

    def __init__(self, text: np.ndarray, size: int, depth: int):
        n, order, have = len(text), text.astype(np.int64), 1
        while have < depth:
            step = min(have, depth - have)
            ahead = np.concatenate([order[step:], np.full(min(step, n), -1)])[:n] + 1
            order = np.unique(order * (n + size + 1) + ahead, return_inverse=True)[1].astype(np.int64)
            have += step
        self.suffixes = np.argsort(order, kind="stable")
        rank = order[self.suffixes]
        self.starts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])  # of groups of equal prefixes
        self.group = np.cumsum(np.r_[True, rank[1:] != rank[:-1]]) - 1
        counts = np.bincount(text, minlength=size)
        self.first = np.cumsum(counts) - counts
        self.counts = counts
        self.tree = WaveletMatrix(text[self.suffixes - 1].astype(np.int64), size)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the interval of suffixes that begin with each row,
        or one narrower than two suffixes as soon as it is."""
        n, length = patterns.shape
        last = patterns[:, -1]
        lo, hi = self.first[last].copy(), (self.first[last] + self.counts[last]).copy()
        live = np.arange(n)
        for at in range(length - 2, -1, -1):
            live = live[hi[live] - lo[live] > 1]
            if not len(live):
                break
            c = patterns[live, at]
            ends = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.first[c] + ends[:len(c)], self.first[c] + ends[len(c):]
        return lo, hi


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def matching_statistics(symbols: np.ndarray, lengths: np.ndarray, holder: np.ndarray, window: int) -> np.ndarray:
    """For each window of each run, one after the other, the smallest holder of
    a run in which it occurs."""
    words, local = np.unique(symbols, return_inverse=True)
    at = np.cumsum(lengths + 1) - (lengths + 1)  # a separator follows each run
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    text[spread(at, lengths)] = local + 1
    index = FMIndex(text, len(words) + 1, window)
    own = np.repeat(holder, lengths + 1)
    least = np.minimum.reduceat(own[index.suffixes], index.starts)
    place = spread(at, lengths - window + 1)
    out = own[place]
    for a in range(0, len(place), 1 << 18):
        p = place[a:a + (1 << 18)]
        lo, hi = index.search(text[p[:, None] + np.arange(window)])
        many = hi - lo > 1
        out[a:a + len(p)][many] = least[index.group[lo[many]]]
    return out


# ---- routing


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents in chunks, written once: (chunk, ids, keys, lengths, words,
    tokens, n_words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held, count = TaskContext.get().partitionId() << 24, 0, [], 0
        code = zstandard.ZstdCompressor(level=1)

        def flush() -> pa.RecordBatch:
            nonlocal made, held, count
            ids, keys, n, stream = (np.concatenate([h[i] for h in held]) for i in range(4))
            words, tokens = np.unique(stream, return_inverse=True)
            held, count, made = [], 0, made + 1
            blobs = [ids.astype("<i8").tobytes(), keys.astype("<i8").tobytes(), n.astype("<i8").tobytes(),
                     exchange.pack(np.r_[words[:1], words[1:] - words[:-1]], code), code.compress(tokens.astype("<u4").tobytes())]
            return pa.RecordBatch.from_arrays(
                [pa.array([first + made], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs), pa.array([len(tokens)], pa.int64())],
                names=["chunk", "ids", "keys", "lengths", "words", "tokens", "n_words"])

        for batch in batches:
            for b in common.slices(batch, "text"):
                stream, n = word_hashes(b.column("text"), lower=False)
                held.append((b.column("id").to_numpy(), b.column("key").to_numpy(), n, stream))
                count += len(stream)
                if count >= CHUNK_WORDS:
                    yield flush()
        if held:
            yield flush()

    return common.written_by(
        docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"),
                    common.row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
        .mapInArrow(run, "chunk long, ids binary, keys binary, lengths binary, words binary, tokens binary, n_words long"),
        "words", "chunk", common.buckets_for(docs))


class Chunk:
    def __init__(self, row: dict, window: int):
        unzip = zstandard.ZstdDecompressor()
        self.number = row["chunk"]
        self.ids, self.keys, self.length = (np.frombuffer(row[c], "<i8") for c in ("ids", "keys", "lengths"))
        words = np.cumsum(exchange.unpack(row["words"], unzip), dtype=np.uint64)
        self.stream = words[np.frombuffer(unzip.decompress(row["tokens"]), "<u4")] if row["n_words"] else np.zeros(0, np.uint64)
        gram = min(GRAM, window)
        n = max(len(self.stream) - window + 1, 0)
        grams = self.rolling(gram)
        low, have, want = grams, 1, window - gram + 1
        while have < want:  # the smallest of so many hashes from each place on
            step = min(have, want - have)
            low = np.minimum(low[:len(low) - step], low[step:])
            have += step
        doc = np.repeat(np.arange(len(self.length)), self.length)
        self.place = np.flatnonzero(doc[:n] == doc[window - 1:]) if n else np.zeros(0, np.int64)  # of windows
        self.doc = doc[self.place]
        self.minimizer = low[self.place]
        self.window = window
        self.start = np.cumsum(self.length) - self.length

    def rolling(self, n: int) -> np.ndarray:
        """A hash of the n words from each place on."""
        out = np.zeros(max(len(self.stream) - n + 1, 0), np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + self.stream[k:k + len(out)]
        return exchange.mix(out)

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimizers and how many documents hold each."""
        keys, which = np.unique(self.minimizer, return_inverse=True)
        pairs = np.unique(which * np.int64(len(self.length) + 1) + self.doc)
        return keys, np.bincount(pairs // (len(self.length) + 1), minlength=len(keys))


def ask(made: DataFrame, window: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch.slice(i, 1).to_pylist()[0], window)
                keys, n = c.asked()
                yield exchange.request_batch([*exchange.requests(c.number, keys, [n], buckets, 0)])

    return made.mapInArrow(run, exchange.REQUEST)


RUNS = "shard int, chunk long, lengths binary, symbols binary, docs binary, ids binary, places binary, keys binary, least binary"


def shared_runs(joined, window: int, buckets: int, shards: int) -> DataFrame:
    """The runs of windows whose minimizer several documents hold, by shard;
    of a minimizer that more than COMMON hold, the distinct windows' keys."""

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        c = Chunk(chunk.to_pylist()[0], window)
        code, names = zstandard.ZstdCompressor(level=1), [f.split()[0] for f in RUNS.split(", ")]
        keys = c.asked()[0]
        held = exchange.answers(replies, buckets, 0, 1)[0][np.searchsorted(keys, c.minimizer)] if len(keys) else np.zeros(0, np.int64)
        zip_ = lambda x, kind: code.compress(np.ascontiguousarray(x).astype(kind).tobytes())
        rows = []
        hot = np.flatnonzero(held > COMMON)
        if len(hot):
            key, which = np.unique(c.rolling(window)[c.place[hot]], return_inverse=True)
            least = np.full(len(key), NO_ID)
            np.minimum.at(least, which, c.ids[c.doc[hot]])
            shard = ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            edge = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                rows.append((int(shard[a]), c.number, *[None] * 5,
                             exchange.pack(np.r_[key[a:a + 1], key[a + 1:b] - key[a:b - 1]], code), zip_(least[a:b], "<i8")))
        some = np.flatnonzero((held > 1) & (held <= COMMON))
        if len(some):
            place, doc, key = c.place[some], c.doc[some], c.minimizer[some]
            new = np.r_[True, (place[1:] != place[:-1] + 1) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
            head = np.flatnonzero(new)
            n = np.diff(np.r_[head, len(place)])
            place, doc, key = place[head], doc[head], key[head]
            shard = ((exchange.mix(key) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            place, doc, shard, n = place[order], doc[order], shard[order], n[order]
            edge = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                s, length = slice(a, b), n[a:b] + window - 1
                # Words count as equal if 32 bits of their hashes are, as one of 13 at the same place.
                symbols = (c.stream[spread(place[s], length)] >> np.uint64(32)).astype("<u4")
                rows.append((int(shard[a]), c.number, zip_(length, "<u4"), zip_(symbols, "<u4"), zip_(doc[s], "<u4"),
                             zip_(c.ids[doc[s]], "<i8"), zip_(place[s] - c.start[doc[s]], "<u4"), None, None))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 7)
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 9, kinds, strict=True)], names=names)

    return joined.applyInArrow(run, RUNS)


def repeated(runs: DataFrame, window: int) -> DataFrame:
    """(chunk, doc, from, to): word intervals that an earlier document holds; and
    (chunk, keys, least), doc null: the smallest document of each key asked for."""

    def least_of(asked: pa.Table) -> pa.Table:
        """One chunk's keys are unpacked at a time, beside the distinct ones."""
        unzip, code = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        blobs = list(zip(asked.column("keys").to_pylist(), asked.column("least").to_pylist(), strict=True))
        distinct, least, held, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for i, (k, v) in enumerate(blobs):
            held.append((np.cumsum(exchange.unpack(k, unzip), dtype=np.uint64), np.frombuffer(unzip.decompress(v), "<i8")))
            n += len(held[-1][0])
            if n > max(len(distinct), 1 << 18) or i == len(blobs) - 1:
                keys, which = np.unique(np.concatenate([distinct, *(h[0] for h in held)]), return_inverse=True)
                low = np.full(len(keys), NO_ID)
                np.minimum.at(low, which, np.concatenate([least, *(h[1] for h in held)]))
                distinct, least, held, n = keys, low, [], 0
        back = [code.compress(least[np.searchsorted(distinct, np.cumsum(exchange.unpack(k, unzip), dtype=np.uint64))].astype("<i8").tobytes())
                for k, _ in blobs]
        none = pa.nulls(len(blobs), pa.int32())
        return pa.Table.from_arrays(
            [asked.column("chunk").combine_chunks(), none, none, none, pa.array([k for k, _ in blobs], pa.binary()), pa.array(back, pa.binary())],
            names=["chunk", "doc", "from", "to", "keys", "least"])

    def run(group: pa.Table) -> pa.Table:
        hot = group.filter(pc.is_valid(group.column("keys")))
        own = group.filter(pc.is_valid(group.column("lengths")))
        return pa.concat_tables([f(part) for f, part in ((least_of, hot), (matched, own)) if part.num_rows])

    def matched(group: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        cols = {}
        for name, kind in (("lengths", "<u4"), ("symbols", "<u4"), ("docs", "<u4"), ("ids", "<i8"), ("places", "<u4")):
            parts = [np.frombuffer(unzip.decompress(b), kind) for b in group.column(name).to_pylist()]
            cols[name] = np.concatenate(parts).astype(np.int64)
            sizes = [len(p) for p in parts] if name == "lengths" else sizes
        chunk = np.repeat(group.column("chunk").to_numpy(), sizes)
        length, symbols, ids = cols["lengths"], cols["symbols"], cols["ids"]
        at = np.cumsum(length) - length
        # Equal runs are indexed once, with their smallest document.
        h = exchange.mix(symbols.astype(np.uint64) + np.uint64(1)) * exchange.mix(
            (np.arange(len(symbols)) - np.repeat(at, length) + 1).astype(np.uint64))
        h = np.add.reduceat(h, at) + length.astype(np.uint64)
        _, one, same = np.unique(h, return_index=True, return_inverse=True)
        holder = np.full(len(one), NO_ID)
        np.minimum.at(holder, same, ids)
        least = matching_statistics(symbols[spread(at[one], length[one])], length[one], holder, window)
        n = length - window + 1  # windows of each run
        first = np.cumsum(n[one]) - n[one]
        hit = least[spread(first[same], n)] < np.repeat(ids, n)
        owner, place = np.repeat(np.arange(len(n)), n)[hit], spread(cols["places"], n)[hit]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)] if len(owner) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        last = np.r_[head[1:], len(owner)] - 1 if len(owner) else head
        return pa.Table.from_arrays(
            [pa.array(chunk[owner[head]], pa.int64()), pa.array(cols["docs"][owner[head]], pa.int32()),
             pa.array(place[head], pa.int32()), pa.array(place[last] + window, pa.int32()),
             pa.nulls(len(head), pa.binary()), pa.nulls(len(head), pa.binary())], names=["chunk", "doc", "from", "to", "keys", "least"])

    return runs.groupBy("shard").applyInArrow(run, "chunk long, doc int, `from` int, `to` int, keys binary, least binary")


def marked(joined, window: int) -> DataFrame:
    """(row_key, spans) from each chunk and what was found for it."""

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        empty = pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], kind)], names=["row_key", "spans"])
        if not chunk.num_rows or not found.num_rows:
            return empty
        row = chunk.to_pylist()[0]
        own = found.filter(pc.is_valid(found.column("doc")))
        doc, start, end = (own.column(x).to_numpy().astype(np.int64) for x in ("doc", "from", "to"))
        hot = found.filter(pc.is_valid(found.column("keys")))
        if hot.num_rows:
            unzip, c = zstandard.ZstdDecompressor(), Chunk(row, window)
            keys = np.concatenate([np.cumsum(exchange.unpack(k, unzip), dtype=np.uint64) for k in hot.column("keys").to_pylist()])
            least = np.concatenate([np.frombuffer(unzip.decompress(v), "<i8") for v in hot.column("least").to_pylist()])
            order = np.argsort(keys)
            keys, least = keys[order], least[order]
            h = c.rolling(window)[c.place]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = (keys[at] == h) & (least[at] < c.ids[c.doc])
            place = c.place[hit] - c.start[c.doc[hit]]
            doc, start, end = (np.concatenate(x) for x in ((doc, c.doc[hit]), (start, place), (end, place + window)))
        if not len(doc):
            return empty
        # Intervals of a document are merged where they touch.
        order = np.lexsort((start, doc))
        doc, start, apart = doc[order], start[order], int(end.max()) + 2
        reach = np.maximum.accumulate(doc * apart + end[order])
        head = np.flatnonzero(np.r_[True, (doc * apart + start)[1:] > reach[:-1]])
        last = np.r_[head[1:], len(doc)] - 1
        doc, start, end = doc[head], start[head], reach[last] - doc[head] * apart
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        spans = pa.ListArray.from_arrays(
            pa.array(np.r_[first, len(doc)], pa.int32()),
            pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["from", "to"]))
        return pa.Table.from_arrays([pa.array(np.frombuffer(row["keys"], "<i8")[doc[first]]), spans], names=["row_key", "spans"])

    return joined.applyInArrow(run, "row_key long, spans array<struct<`from`:int,`to`:int>>")


def repeated_spans(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, spans): for the rows of ``docs`` in which a window of words
    also starts in a document with a smaller id, the word intervals (array of
    from, to; half-open, apart, in order) that such windows cover.

    Null texts have no words, texts shorter than a window none. A null id
    counts as larger than all others. Rows that share an id are not earlier
    than each other, so a repeated row keeps its words. Ids are integers.
    """
    made = chunks(docs, id_col, text_col)
    n_words = int(made.agg(F.sum("n_words")).first()[0] or 0)
    buckets = exchange.bucket_count(docs, n_words // 5)
    shards = max(-(-n_words // SHARD_WORDS), buckets)
    replied = exchange.totals(ask(made, window, buckets)).where("chunk is not null").select("chunk", "bucket", "totals")
    runs = shared_runs(made.groupBy("chunk").cogroup(replied.groupBy("chunk")), window, buckets, shards)
    found = repeated(runs, window)
    # Rows alike in id and text have the same spans.
    return common.written(
        marked(made.groupBy("chunk").cogroup(found.groupBy("chunk")), window).dropDuplicates(["row_key"]), "spans")


def kept_words(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with __n_words, __n_removed and __kept, its words
    outside the repeated spans joined by one space."""
    spans = repeated_spans(docs, window, id_col, text_col).select(
        F.col("row_key").alias("__found"), F.col("spans").alias("__spans"))
    n = spans.agg(F.sum(F.size("__spans"))).first()[0] or 0
    marked = docs.withColumn("__key", common.row_key(id_col, text_col))
    small = F.broadcast(spans) if n <= BROADCAST_SPANS else spans
    joined = marked.join(small, F.col("__key") == F.col("__found"), "left").drop("__key", "__found").withColumn(
        "__text", F.col(text_col))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.slices(batch, "__text"):
                total, removed, kept = [], [], []
                for text, spans in zip(b.column("__text").to_pylist(), b.column("__spans").to_pylist(), strict=True):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    total.append(len(words))
                    for s in reversed(spans or []):
                        del words[s["from"]:s["to"]]
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in columns), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.string())], names=[*columns, "__n_words", "__n_removed", "__kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, f"{fields}, __n_words long, __n_removed long, __kept string")


def without_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words taken out; other texts as they were."""
    out = kept_words(docs, window, id_col, text_col)
    return out.withColumn(text_col, F.when(F.col("__n_removed") > 0, F.col("__kept")).otherwise(F.col(text_col))).select(*docs.columns)
