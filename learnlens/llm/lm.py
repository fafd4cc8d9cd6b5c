"""Language-model scores by deleted interpolation.

A bigram model: the maximum-likelihood estimates of bigram, unigram and a
uniform floor are mixed with weights that depend on how often the context was
seen. The weights are learned by expectation-maximisation on counts held out
of the estimates (one training fold); the final estimates use all training
folds. Counts of all words and bigrams are totals over the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, exchange

#: Tokens of a chunk, about; a chunk is what a task holds at a time.
CHUNK_TOKENS = 1_500_000
#: Contexts are told apart by the power of two of their count, up to this one.
CLASSES = 32
#: Steps of the logarithm (base 2) in which held-out estimates are binned.
STEPS = 8
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))  # no word holds a line feed
FIT, EM, REST = 0, 1, 2  # estimates, mixture weights, held out from training


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased), and the number of words by text."""
    plain = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain) if lower else plain)
    flat = lists.flatten()
    words = flat.dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    index = words.indices.to_numpy()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[full]
    return table[index[full]] if len(table) else np.zeros(0, np.uint64), np.bincount(of, minlength=len(lists))


def chunks(docs: DataFrame, id_col: str, text_col: str, folds: int, size: int) -> DataFrame:
    """Documents in chunks, written once: (chunk, em, doc_ids, folds, lengths,
    words, tokens, n_tokens, n_train, n_fit). words are the sorted hashes of
    the chunk's distinct tokens, tokens numbers in them. Documents of the fold
    for the weights have chunks of their own."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 24, 0
        held: dict[bool, list] = {True: [], False: []}
        count = {True: 0, False: 0}

        def flush(em: bool) -> pa.RecordBatch:
            nonlocal made
            parts, held[em], count[em] = held[em], [], 0
            words, tokens = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
            fold, length = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
            made += 1
            ids = pa.concat_arrays([p[0] for p in parts])
            return pa.RecordBatch.from_arrays(
                [pa.array([first + made], pa.int64()), pa.array([em]),
                 pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 pa.array([fold.astype(np.int8).tobytes()], pa.binary()), pa.array([length.astype("<i8").tobytes()], pa.binary()),
                 pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([tokens.astype("<u4").tobytes()], pa.binary()),
                 pa.array([len(tokens)], pa.int64()), pa.array([int(length[fold != REST].sum())], pa.int64()),
                 pa.array([int(length[fold == FIT].sum())], pa.int64())],
                names=["chunk", "em", "doc_ids", "folds", "lengths", "words", "tokens", "n_tokens", "n_train", "n_fit"])

        for batch in batches:
            for b in common.slices(batch, "text"):
                hashes, n = word_hashes(b.column("text"))
                fold = b.column("fold").to_numpy()
                ends = np.cumsum(n)
                stream = np.insert(hashes, ends, END)  # each text's end
                n = n + 1
                of = np.repeat(fold == EM, n)
                for em in (True, False):
                    mine = np.flatnonzero((fold == EM) == em)
                    if len(mine):
                        held[em].append((b.column("doc_id").take(pa.array(mine)), fold[mine], n[mine], stream[of == em]))
                        count[em] += int(n[mine].sum())
                        if count[em] >= size:
                            yield flush(em)
        for em in (True, False):
            if held[em]:
                yield flush(em)

    rest = common.crc_mod(id_col, folds)
    return common.written_by(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                    F.when(rest == 0, REST).when(rest == 1, EM).otherwise(FIT).cast("int").alias("fold"))
        .mapInArrow(run, f"chunk long, em boolean, doc_ids array<{kind}>, folds binary, lengths binary, words binary, "
                         "tokens binary, n_tokens long, n_train long, n_fit long"), "chunks", "chunk", common.buckets_for(docs))


class Chunk:
    """A chunk's row, read back."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.fold = np.frombuffer(row["folds"], np.int8)
        self.length = np.frombuffer(row["lengths"], "<i8")
        self.words = np.frombuffer(row["words"], "<u8")
        self.token = np.frombuffer(row["tokens"], "<u4").astype(np.int64)
        starts = np.cumsum(self.length) - self.length
        hashes = self.words[self.token]
        before = np.r_[END, hashes[:-1]]
        before[starts] = END  # a text begins after an end
        pair = exchange.mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes)
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        self.before = np.searchsorted(self.words, before)
        self.starts = starts
        self.token_fold = np.repeat(self.fold, self.length)

    def counts(self, place: np.ndarray, n: int) -> list[np.ndarray]:
        """How often each key occurs in the estimates' folds and in training."""
        return [np.bincount(place[m], minlength=n) for m in (self.token_fold == FIT, self.token_fold != REST)]


def ask(made: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch.slice(i, 1).to_pylist()[0])
                yield exchange.request_batch(
                    [*exchange.requests(c.number, c.words, c.counts(c.token, len(c.words)), buckets, 0),
                     *exchange.requests(c.number, c.pairs, c.counts(c.pair, len(c.pairs)), buckets, buckets)])

    return made.select("chunk", "folds", "lengths", "words", "tokens").mapInArrow(run, exchange.REQUEST)


def context_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 0) + 1).astype(np.int64), CLASSES - 1)


def estimates(c: Chunk, replies: pa.Table, buckets: int, which: int, n_tokens: int, n_types: int):
    """By token: the context's class, and the estimates of bigram, unigram and
    floor, from the estimates' folds (which = 0) or all training folds (1).
    Also the token's training count."""
    uni = exchange.answers(replies, buckets, 0, 2)
    two = exchange.answers(replies, buckets, buckets, 2)[which]
    one = uni[which]
    context = one[c.before] if len(one) else one
    p2 = two[c.pair] / np.maximum(context, 1)
    p1 = one[c.token] / max(n_tokens, 1)
    return context_class(context), p2, p1, 1.0 / (n_types + 1), uni[1][c.token]


def held_out_bins(joined, buckets: int, n_fit: int, types_fit: int) -> DataFrame:
    """Binned estimates of the weights' fold: (class, q2, q1, n)."""

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        bins = np.zeros((0, 4), np.int64)
        if chunk.num_rows and replies.num_rows:
            c = Chunk(chunk.to_pylist()[0])
            k, p2, p1, _, _ = estimates(c, replies, buckets, 0, n_fit, types_fit)
            quantum = lambda p: np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * STEPS), 1).astype(np.int64)
            rows, n = np.unique(np.stack([k, quantum(p2), quantum(p1)], axis=1), axis=0, return_counts=True)
            bins = np.column_stack([rows, n])
        return pa.Table.from_arrays([pa.array(bins[:, i]) for i in range(4)], names=["class", "q2", "q1", "n"])

    return joined.applyInArrow(run, "class long, q2 long, q1 long, n long").groupBy("class", "q2", "q1").agg(F.sum("n").alias("n"))


def mixture(bins: np.ndarray, types_fit: int, steps: int = 100) -> np.ndarray:
    """Weights of (bigram, unigram, floor) by context class, by expectation-
    maximisation; a class without held-out tokens gets those of all tokens."""
    start = np.array([0.4, 0.4, 0.2])
    out = np.tile(start, (CLASSES, 1))
    if not len(bins):
        return out
    p = np.column_stack([np.where(bins[:, 1] > 0, 0, 2.0 ** (bins[:, 1] / STEPS)),
                         np.where(bins[:, 2] > 0, 0, 2.0 ** (bins[:, 2] / STEPS)),
                         np.full(len(bins), 1.0 / (types_fit + 1))])

    def learn(rows: np.ndarray) -> np.ndarray:
        w, n, q = start, bins[rows, 3].astype(float), p[rows]
        for _ in range(steps):
            share = q * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) / n.sum()
            w = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()  # unseen words keep a probability
        return w

    out[:] = learn(np.arange(len(bins)))
    for k in np.unique(bins[:, 0]):
        out[k] = learn(np.flatnonzero(bins[:, 0] == k))
    return out


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10,
           chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (additive smoothing of 0.1 over unigrams) and score (the
    model's), log10 probabilities of the lower-cased words and one end each.

    The model learns from rows whose crc32(doc_id as text) mod ``folds`` is
    not 0 (a null id counts as empty text: remainder 0). Null texts are empty:
    the end alone. Without training rows every token has the floor's
    probability. Repeated rows count and are scored each by itself; an empty
    table gives no rows; other columns are ignored.
    """
    made = chunks(docs, id_col, text_col, folds, chunk_tokens)
    n_tokens, n_train, n_fit = (int(v or 0) for v in made.agg(F.sum("n_tokens"), F.sum("n_train"), F.sum("n_fit")).first())
    buckets = exchange.bucket_count(docs, n_tokens)
    replied = common.written(exchange.totals(ask(made, buckets)), "totals")
    types_fit, types = exchange.type_totals(replied, buckets, 0, 2)
    given = replied.where("chunk is not null").select("chunk", "bucket", "totals")
    em = made.where("em")
    of_em = given.join(F.broadcast(em.select("chunk")), "chunk", "left_semi") if em.count() <= 1_000_000 else (
        given.join(em.select("chunk"), "chunk", "left_semi"))
    bins = held_out_bins(em.groupBy("chunk").cogroup(of_em.groupBy("chunk")), buckets, n_fit, types_fit).collect()
    weights = mixture(np.array(sorted(tuple(r) for r in bins), np.int64).reshape(-1, 4), types_fit)

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        c = Chunk(chunk.to_pylist()[0])
        k, p2, p1, p0, seen = estimates(c, replies, buckets, 1, n_train, types)
        w = weights[k]
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0 if n_train else np.full(len(k), p0)
        # Where no context was seen, its share goes to the other two.
        lost = (p2 == 0) & (k == 0)
        p = np.where(lost & bool(n_train), p / np.maximum(w[:, 1] + w[:, 2], 1e-9), p)
        base = np.log10((seen + 0.1) / (n_train + 0.1 * (types + 1)))
        add = lambda x: np.add.reduceat(x, c.starts)
        n = len(c.length)
        return pa.Table.from_arrays(
            [chunk.column("doc_ids").combine_chunks().flatten(), pa.array(c.fold == REST), pa.array(c.length),
             pa.array(add((seen > 0).astype(np.int64))), pa.array([n_train] * n, pa.int64()),
             pa.array(add(base)), pa.array(add(np.log10(p)))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return made.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
             "base_score double, score double")
