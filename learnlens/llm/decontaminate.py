"""Benchmark decontamination, in DataFrame functions alone.

The benchmark's distinct windows and the hashes of their first words (seeds)
are small tables. One scan of the documents hashes every position's first
words, looks the hashes up in the seeds (a broadcast hash set while it is
within a checked size, a shuffle join beyond it), and compares the whole
window by its words only where a seed was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED_WORDS = 3
#: Words that a segment begins; a text is scanned segment by segment.
SEGMENT = 64
#: Seeds (8 bytes each) up to which the set is broadcast.
BROADCAST_SEEDS = 2_000_000


def seed_at(words: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(n)])


def _seeds(k: int) -> Column:
    """(at, seed) of every place of the segment ``w`` that ``k`` words follow. The
    words that a segment has beyond its own begin the next one."""
    last = F.greatest(F.least(F.size("w") - k, F.lit(SEGMENT - 1)), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        i.alias("at"), seed_at(F.col("w"), i, k).alias("seed")))


def item_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item_id, length, words, seed_words, seed); words is the
    window's text, its words joined by one space."""
    items = (benchmark.select(F.col(id_col).alias("item_id"),
                              common.alnum_words(F.col(text_col)).alias("w"))
             .where(F.size("w") > 0)
             .withColumn("length", F.least(F.size("w"), F.lit(window)))
             .withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length")))))
    seeds = F.coalesce(*[F.when(F.col("length") >= k, seed_at(F.col("w"), F.col("at"), k))
                         for k in range(SEED_WORDS, 0, -1)])
    return items.select(
        "item_id", "length",
        F.array_join(F.slice("w", F.col("at") + 1, F.col("length")), " ").alias("words"),
        F.least("length", F.lit(SEED_WORDS)).alias("seed_words"), seeds.alias("seed")).distinct()


def scan(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """One row per document (at is null) with n_words, and one per occurrence
    of a benchmark window: (row, doc_id, row_key, n_words, at, length, words).

    A text is cut into segments that overlap by a window less a word, so a
    place carries the words of its segment, not of the whole text, and the work
    grows with a text's length, not with its square.
    """
    seeds = windows.select("seed").distinct()
    texts = windows.select(F.col("words").alias("window"), F.col("length").alias("long")).distinct()
    kinds = windows.groupBy("seed_words").agg(
        F.count_distinct("seed").alias("n"), F.sum(F.octet_length("words") + 40).alias("bytes"),
        F.array_sort(F.collect_set("length")).alias("lengths")).collect()
    if sum(k.n for k in kinds) <= broadcast_seeds:
        seeds = F.broadcast(seeds)
        if sum(k.bytes for k in kinds) <= 16 * broadcast_seeds:
            texts = F.broadcast(texts)
    lengths = sorted({n for k in kinds for n in k.lengths})  # at most the window's length many
    none = F.array().cast("array<struct<at:int,seed:bigint>>")
    n = F.size("w")
    spots = [F.when(n >= k.seed_words, _seeds(k.seed_words)).otherwise(none) for k in kinds]
    # The first element of the first segment stands for the document itself. It joins
    # by a key of its own, equal to no window, so that such rows don't meet in one task.
    itself = F.when(F.col("base") == 0, F.array(F.struct(
        F.lit(None).cast("int").alias("at"), F.lit(None).cast("bigint").alias("seed")))).otherwise(none)
    segments = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / SEGMENT).cast("int")),
        lambda s: F.struct((s * SEGMENT).alias("base"), F.slice(
            F.col("w"), s * SEGMENT + 1, F.lit(SEGMENT - 1 + max([*lengths, SEED_WORDS]))).alias("w")))
    all_rows = (docs.select(F.col(id_col).alias("doc_id"), common.row_key(id_col, text_col).alias("row_key"),
                            common.alnum_words(F.col(text_col)).alias("w"))
                .withColumn("row", F.monotonically_increasing_id())
                .select("row", "doc_id", "row_key", n.cast("long").alias("n_words"), F.explode(segments).alias("part"))
                .select("row", "doc_id", "row_key", "n_words", "part.base", "part.w")
                .select("row", "doc_id", "row_key", "n_words", "base", "w",
                        F.explode(F.concat(itself, *spots)).alias("s")))
    found = (all_rows.join(seeds.withColumnRenamed("seed", "known"), F.coalesce("s.seed", "row") == F.col("known"), "left")
             .where("s.at is null or known is not null"))
    here = F.array(*[F.lit(x) for x in lengths]) if lengths else F.array().cast("array<int>")
    fits = F.when(F.col("s.at").isNull(), F.array(F.lit(0))).otherwise(
        F.filter(here, lambda x: F.col("s.at") + x <= F.size("w")))
    found = found.select("row", "doc_id", "row_key", "n_words", "base",
                         F.col("s.at").alias("at"), F.explode(fits).alias("length"), "w")
    found = found.select("row", "doc_id", "row_key", "n_words", (F.col("base") + F.col("at")).alias("at"), "length",
                         F.when(F.col("at").isNotNull(), F.array_join(
                             F.slice("w", F.coalesce("at", F.lit(0)) + 1, F.col("length")), " ")
                                ).otherwise(F.concat(F.lit("\n"), "row")).alias("words"))
    return common.written(
        found.join(texts, (F.col("words") == F.col("window")) & (F.col("length") == F.col("long")), "left")
        .where("at is null or window is not null").drop("window", "long"), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20,
                  id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Per row of ``docs``: doc_id, row_key, n_words, n_hit, n_items, items
    (sorted strings), spans (array of half-open word intervals that are hit)
    and contaminated: at least one word in ``share`` words is hit.

    Null and empty texts have no words and are not contaminated. Benchmark
    rows without words or with a null text are no window; a null item_id
    counts its window's words but names no item. Repeated rows and ids are
    judged each by itself. Empty tables on either side are fine; other columns
    are ignored.
    """
    windows = common.written(item_windows(benchmark, window, item_id, item_text), "windows")
    rows = scan(docs, windows, id_col, text_col, broadcast_seeds)
    hits = rows.where("at is not null")
    order = Window.partitionBy("row").orderBy("at", "length")
    reach = F.max(F.col("at") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # Each hit adds the words beyond what the hits before it reach.
    spans = (hits.select("row", "at", "length").distinct()
             .withColumn("from", F.greatest("at", F.coalesce(reach, F.lit(0))))
             .withColumn("to", F.col("at") + F.col("length")).where("from < to")
             .groupBy("row").agg(F.sum(F.col("to") - F.col("from")).alias("n_hit"),
                                 F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans")))
    items = (hits.select("row", F.col("words").alias("hit")).distinct()
             .join(windows.select("words", F.col("item_id").cast("string").alias("item")).distinct(),
                   F.col("hit") == F.col("words"))
             .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items")))
    none = F.array().cast("array<struct<from:int,to:int>>")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (rows.where("at is null").select("row", "doc_id", "row_key", "n_words")
            .join(spans, "row", "left").join(items, "row", "left")
            .select("doc_id", "row_key", "n_words", n_hit.alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce("spans", none).alias("spans"))
            .withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without its contaminated rows."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = contamination(docs, benchmark, **options).where("contaminated")
    return common.keep_rows(docs, bad, id_col, text_col, keep=False)


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, row_key, kept): each row's lower-cased words outside the hit
    spans, joined by one space."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = contamination(docs, benchmark, **options).select("row_key", "spans").distinct()
    words = docs.select(F.col(id_col).alias("doc_id"), common.row_key(id_col, text_col).alias("row_key"),
                        common.alnum_words(F.col(text_col)).alias("w"))
    outside = F.filter("w", lambda x, i: ~F.exists("spans", lambda s: (i >= s["from"]) & (i < s["to"])))
    return words.join(found, "row_key").select("doc_id", "row_key", F.array_join(outside, " ").alias("kept"))
