"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic text.
Both begin with the same ordinary windows; the toxic one ends with the segments
(words and word stems) that tell toxic from ordinary training texts by their
log-likelihood ratio, the other with as much ordinary text again. Every window
of a text is compressed with either dictionary. How much shorter the toxic
dictionary makes it is held against thresholds: how many windows pass each, and
how far that exceeds what ordinary text has by calibration, make the score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 40
#: Labelled rows, about, to learn from in either class (chosen by a hash of the id).
MAX_LABELLED = 4000
#: Ordinary windows that both dictionaries share.
BASE_WINDOWS = 300
#: Toxic texts that hold a segment, and its log-likelihood ratio (chance alone
#: exceeds this once in 10,000 segments), from which on it tells.
LEAST_TEXTS, LEAST_RATIO = 3, 15.1
LEVEL = 12


def words_of(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()) + b" "


def windows(text: str | None) -> list[bytes]:
    """The whole text in windows of WINDOW bytes or slightly more, cut at
    spaces; a space on either side. Long runs without a space are cut too."""
    t, out, at = words_of(text), [], 0
    while at < len(t) - 1:
        end = t.find(b" ", at + WINDOW, at + 4 * WINDOW)
        if end < 0:
            end = min(at + 4 * WINDOW, len(t) - 1)
        out.append(t[at:end + 1])
        at = end
    return out


def segments(text: str | None) -> set[bytes]:
    """Words and their first 4 to 6 bytes, after a space."""
    out = set()
    for w in set(words_of(text).split()):
        out.add(b" " + w + b" ")
        out.update(b" " + w[:k] for k in (4, 5, 6) if len(w) > k)
    return {s for s in out if len(s) <= 40}


def contexts(text: str | None, wanted: frozenset[bytes]) -> set[tuple[bytes, int]]:
    """The wanted segments of a text, each with a hash of the words on either
    side of its first place: copies of a passage have one and the same."""
    ws, out = words_of(text).split(), {}
    for i, w in enumerate(ws):
        for s in (b" " + w + b" ", *(b" " + w[:k] for k in (4, 5, 6) if len(w) > k)):
            if s in wanted and s not in out:
                out[s] = zlib.crc32(b" ".join(ws[max(i - 1, 0):i] + ws[i + 1:i + 2]))
    return set(out.items())


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    #: Share of the windows of ordinary text that pass each threshold.
    rates: tuple[float, ...]
    weights: tuple[float, ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in (self.ordinary, self.toxic):
            how = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, min_match=4, write_content_size=False, write_dict_id=False, write_checksum=False)
            trained = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(compression_params=how)
            out.append(zstandard.ZstdCompressor(dict_data=trained, compression_params=how))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        """Probabilities for rows of ``features`` (see measured)."""
        x = inputs(features, np.array(self.rates))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


#: The thresholds: gaps of 2 bytes, 3, .. and more are counted up to this one.
GAPS = 16


def measured(text: str | None, pair: list[zstandard.ZstdCompressor]) -> list[int]:
    """How many windows there are, then how many have a gap of 1, 2, .. GAPS or
    more between the ordinary and the toxic dictionary's lengths."""
    one, two = pair[0].compress, pair[1].compress
    counts = [0] * (GAPS + 1)
    for w in windows(text):
        gap = len(one(w)) - len(two(w))
        counts[min(max(gap, 0), GAPS)] += 1
    total = 0
    for g in range(GAPS, -1, -1):
        total += counts[g]
        counts[g] = total
    return counts


def inputs(features: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Inputs of the logistic score: a constant and, by threshold, how far the
    windows that pass exceed the ordinary number, and their number."""
    f = np.asarray(features, float).reshape(-1, GAPS + 1)
    passed, usual = f[:, 2:], f[:, :1] * rates
    return np.column_stack([np.ones(len(f)), np.clip((passed - usual) / np.sqrt(usual + 0.25), -4, 8) / 2,
                            np.log1p(passed)])


def logistic(x: np.ndarray, y: np.ndarray, row_weights: np.ndarray, penalty: float = 0.5, steps: int = 60) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * ((p * (1 - p) + 1e-6) * row_weights)[:, None]).T @ x + penalty * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ ((p - y) * row_weights) + penalty * w)
    return w


def llr(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Log-likelihood ratio of a of na against b of nb."""
    def h(k, n, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return (np.where(k > 0, k * np.log(np.where(k > 0, k, 1) / (n * p)), 0)
                    + np.where(n > k, (n - k) * np.log(np.where(n > k, n - k, 1) / (n * (1 - p))), 0))
    p = np.clip((a + b) / (na + nb), 1e-12, 1 - 1e-12)
    return 2 * (h(a, na, p) + h(b, nb, p))


def telling(found: list[tuple[bytes, int, int]], na: int, nb: int, parts: bool = False) -> list[bytes]:
    """The segments that tell toxic from ordinary texts, the best one last
    (nearest to the window that is compressed). Each is judged by its own counts,
    so what one language's segments reach keeps none of another's out. Parts of
    segments that tell nearly as much are left out, if not asked for."""
    if not found:
        return []
    a, b = (np.array([r[i] for r in found], float) for i in (1, 2))
    ratio = llr(a, b, na, nb)
    best = sorted(range(len(found)), key=lambda i: (-ratio[i], found[i][0]))
    value = {found[i][0]: ratio[i] for i in best if a[i] >= LEAST_TEXTS and ratio[i] >= LEAST_RATIO}
    # Segments begin with their only inner space, so a part is a beginning.
    whole: dict[bytes, float] = {}
    for s, v in value.items():
        for k in range(1, len(s)):
            whole[s[:k]] = max(whole.get(s[:k], 0.0), v)
    return [s for s, v in value.items() if parts or whole.get(s, 0.0) < 0.8 * v][::-1]


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, fold: tuple[int, int],
             most: int) -> DataFrame:
    """(y, text) of about ``most`` rows at most of either class outside the fold."""
    rows = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("y")).where(
        F.col("y").isNotNull() & (common.crc_mod("__id", fold[0]) != fold[1]))
    n = rows.agg(F.count_if(F.col("y") > 0).alias("bad"), F.count_if(F.col("y") <= 0).alias("good")).first()
    pick = rows.where(F.when(F.col("y") > 0, common.hashed_share("__id", n.bad, most))
                      .otherwise(common.hashed_share("__id", n.good, most)))
    return docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).join(
        F.broadcast(pick), F.col("__doc") == F.col("__id")).select(  # about 2 * most rows at most
            (F.col("y") > 0).cast("int").alias("y"), "text")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, id_col: str = "doc_id", text_col: str = "text",
        held_out: tuple[int, int] = (5, 0), max_labelled: int = MAX_LABELLED) -> Model:
    """A model from labelled rows outside the held-out fold (modulus, remainder
    of the id's crc32). Null labels teach nothing. Without toxic or without
    ordinary rows the score is constant."""
    sample = common.written(labelled(docs, labels, label, id_col, text_col, held_out, max_labelled), "labelled")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    na, nb = sizes.get(1, 0), sizes.get(0, 0)
    if not na or not nb:
        return Model(b"", b"", (0.0,) * (GAPS - 1), (3.0 if na else -3.0, *[0.0] * (2 * GAPS - 2)))
    # The sample may hold another share of toxic rows than all labels do.
    true = labels.where(F.col(label).isNotNull() & (common.crc_mod(id_col, held_out[0]) != held_out[1])).agg(
        F.avg((F.col(label).cast("int") > 0).cast("double"))).first()[0]
    weight = {1: true / (na / (na + nb)), 0: (1 - true) / (nb / (na + nb))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.slices(batch, "text"):
                seen = (Counter(), Counter())
                for y, t in zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
                    seen[y].update(segments(t))
                rows = [(s, n, seen[0].get(s, 0)) for s, n in seen[1].items()]
                rows += [(s, 0, n) for s, n in seen[0].items() if s not in seen[1]]
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["s", "a", "b"])

    found = (sample.mapInArrow(count, "s binary, a long, b long").groupBy("s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
             .where((F.col("a") >= LEAST_TEXTS) & (F.col("a") * nb > 10 * F.col("b") * na))
             .collect())  # of the bounded sample
    wanted = frozenset(telling([(bytes(r.s), r.a, r.b) for r in found], na, nb, parts=True))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for t in batch.column("text").to_pylist() for x in contexts(t, wanted)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.int64())], names=["s", "c"])

    # A passage copied many times is one piece of evidence: texts count by their
    # distinct contexts.
    apart = {bytes(r.s): r.n for r in sample.where("y = 1").mapInArrow(around, "s binary, c long").groupBy("s")
             .agg(F.count_distinct("c").alias("n")).collect()}
    chosen = telling([(bytes(r.s), min(r.a, apart[bytes(r.s)]), r.b) for r in found if bytes(r.s) in apart], na, nb)

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws = [w for t in batch.column("text").to_pylist() for w in sorted(windows(t), key=lambda w: (zlib.crc32(w), w))[:2]]
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.binary())], names=["w"])

    extra = len(b"".join(chosen)) // WINDOW + 1
    base = [bytes(r.w) for r in sample.where("y = 0").mapInArrow(ordinary, "w binary").distinct()
            .orderBy(F.xxhash64("w"), "w").limit(BASE_WINDOWS + extra).collect()]
    common_part, rest = b"".join(base[:BASE_WINDOWS]), b"".join(base[BASE_WINDOWS:])
    size = len(b"".join(chosen))
    model = Model(common_part + rest[:size], common_part + b"".join(chosen), (), ())
    rows = features(sample.select("y", "text"), model, ["y"]).collect()
    x = np.array([r.features for r in rows])
    y = np.array([r.y for r in rows], float)
    order = np.lexsort((*x.T, y))  # the same sums whatever the tasks' order
    x, y = x[order], y[order]
    usual = x[y == 0].sum(axis=0)
    rates = usual[2:] / max(usual[0], 1)
    w = logistic(inputs(x, rates), y, np.where(y == 1, weight[1], weight[0]))
    return Model(model.ordinary, model.toxic, tuple(rates.tolist()), tuple(w.tolist()))


def features(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` of each row (with a column text) and its features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors()
        for batch in batches:
            for b in common.slices(batch, "text"):
                f = [measured(t, pair) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in keep), pa.array(f, pa.list_(pa.int64()))], names=[*keep, "features"])

    names = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{names}, features array<long>")


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_windows, n_beyond, score) of every row: the windows whose gap
    reaches half the largest threshold, and the score from 0 to 1. Null and empty texts have
    no windows and the score of such; repeated rows are scored each by itself;
    an empty table gives no rows; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array(b.column("features").to_pylist(), np.int64).reshape(-1, GAPS + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(f[:, 0]), pa.array(f[:, GAPS // 2]), pa.array(model.score(f))],
                names=["doc_id", "n_windows", "n_beyond", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return features(rows, model, ["doc_id"]).mapInArrow(run, f"doc_id {kind}, n_windows long, n_beyond long, score double")
