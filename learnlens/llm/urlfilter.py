"""URL filters: rules for hosts and paths first, a learnt verdict for the rest.

Host names are split into words by a unigram Viterbi search (word counts come
from all of the pages' titles and a small lexicon; a chunk of urls looks up the
substrings of its names among them), and multinomial naive Bayes scores
the words of host and path. It learns from the urls that a rule decides and
from labelled seed names. Features are hashed to a fixed number of cells, so
the model's size doesn't grow with the data, while its counts cover all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Words that blocked and ordinary names are made of: the labelled seeds.
BLOCK_WORDS = (
    "casino poker bet bets betting win jackpot slots lottery gambling pills cheap viagra pharma "
    "loan loans payday credit debt adult porn xxx sex cam cams dating escort nude free ads ad "
    "track tracker tracking click clicks popup banner spam torrent warez crack keygen hack"
).split()
ALLOW_WORDS = (
    "news blog wiki docs help support home school university science library museum book books "
    "health history music art recipe recipes garden travel weather sport sports code developer "
    "data research journal article forum community local city family kids world today daily open"
).split()
#: Words beside the seeds that names are often made of.
COMMON_WORDS = (
    "a an and are at be best big by for from get go good great in is it live my new of on one "
    "online or our shop site store super the this to top up us web with you your www mobile"
).split()

LONGEST = 24
CELLS = 1 << 18
#: Added to each count.
SMOOTH = 0.1
#: Counts that a seed word starts with in its class, as a word of hosts and of paths.
SEED_COUNT = 3.0
#: Rows and letters of a chunk of urls, about; of a task's held lookups.
CHUNK_ROWS, CHUNK_LETTERS, HELD = 5_000, 150_000, 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first :// up to / ? # or the end, A-Z in lower case; path:
    from there up to ? # or the end. Null or without ://: both empty."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), common.UPPER, common.LOWER),
            F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its
    verdict; null where none fits. Ties go to the rule listed first."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


@dataclass(frozen=True)
class Segmenter:
    """Splits runs of letters into the likeliest words by unigram counts."""

    cost: dict[str, float]
    unknown: float

    @classmethod
    def from_counts(cls, counts: dict[str, float], total: float | None = None) -> Segmenter:
        """``total``: of all counts, where ``counts`` has only those that can occur."""
        total = (sum(counts.values()) if total is None else total) + 1.0
        return cls({w: -math.log(c / total) for w, c in counts.items()}, math.log(total * 10))

    def split(self, name: str) -> list[str]:
        """The cheapest split. A piece that is no word costs as much as a very
        rare word for its first letter and again for each letter more, so
        unknown stretches stay whole only where no words cover them; ties go to
        the longer last word. Runs of digits are pieces of their own."""
        out = []
        for run in re.findall(r"[0-9]+|[^0-9]+", name):
            out += [run] if run[0].isdigit() else self._viterbi(run)
        return out

    def _viterbi(self, run: str) -> list[str]:
        best, back = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            for start in range(max(0, end - LONGEST), end):
                known = self.cost.get(run[start:end])
                step = known if known is not None else self.unknown * (end - start)
                if best[start] + step < best[end]:
                    best[end], back[end] = best[start] + step, start
        pieces, end = [], len(run)
        while end:
            pieces.append((back[end], end, run[back[end]:end] in self.cost))
            end = back[end]
        merged: list[list] = []
        for start, end, known in reversed(pieces):
            if merged and not known and not merged[-1][2]:
                merged[-1][1] = end
            else:
                merged.append([start, end, known])
        return [run[a:b] for a, b, _ in merged]


def title_words(pages: DataFrame, title: Column) -> DataFrame:
    """(w, n): counts of all titles' words of two letters or more."""
    return common.written(pages.select(F.explode(F.regexp_extract_all(
        F.translate(F.coalesce(title, F.lit("")), common.UPPER, common.LOWER), F.lit("[a-z]{2,24}"), F.lit(0))).alias("w"))
        .groupBy("w").agg(F.count("*").alias("n")), "words")


def lexicon(counted: DataFrame) -> tuple[dict[str, float], float]:
    """Counts of the words that are always known (at least a tenth of the
    commonest title word's), and the total of all counts with them."""
    words = sorted({*BLOCK_WORDS, *ALLOW_WORDS, *COMMON_WORDS})
    row = counted.agg(F.max("n").alias("top"), F.sum("n").alias("all")).first()
    top, total = row.top or 1, float(row["all"] or 0)
    own = {r.w: float(r.n) for r in counted.where(F.col("w").isin(words)).collect()}
    counts = {w: max(own.get(w, 0.0), top / 10.0) for w in words}
    return counts, total - sum(own.values()) + sum(counts.values())


def tokens(host: str, path: str, split: Segmenter) -> list[str]:
    """Words of the host's labels (marked h:) and of the path (marked p:);
    numbers count as their number of digits."""
    out = [f"h:{w}" for label in re.split(r"[^0-9a-z]+", host) if label for w in split.split(label)]
    out += [f"p:{w}" for part in re.split(r"[^0-9a-z]+", path.lower()) if part for w in split.split(part)]
    return [f"{t[:2]}{len(t) - 2}#" if t[2].isdigit() else t for t in out]


def cell(token: str) -> int:
    return xxhash.xxh64_intdigest(token) % CELLS


def chunked(urls: DataFrame) -> DataFrame:
    """``urls`` (with host and path) and a chunk number, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rows, letters = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            numbers = []
            for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True):
                if rows >= CHUNK_ROWS or letters >= CHUNK_LETTERS:
                    chunk, rows, letters = chunk + 1, 0, 0
                rows, letters = rows + 1, letters + len(h) + len(p)
                numbers.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64())], names=[*b.schema.names, "chunk"])

    return common.written(urls.mapInArrow(run, f"{fields(urls)}, chunk long"), "urls")


def fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def substrings(urls: DataFrame) -> DataFrame:
    """(chunk, piece): what may be a title word in the chunk's hosts and paths,
    each seldom more than once a chunk however common it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()
        done: set[str] = set()
        last = None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([last] * len(held), pa.int64()), pa.array(sorted(held), pa.string())], names=["chunk", "piece"])

        for b in batches:
            for chunk, h, p in zip(*(b.column(c).to_pylist() for c in ("chunk", "host", "path")), strict=True):
                if held and (chunk != last or len(held) > HELD):
                    yield flush()
                    held.clear()
                if chunk != last:
                    last = chunk
                    done.clear()
                for name in {*re.findall("[a-z]{2,}", h), *re.findall("[a-z]{2,}", p.lower())} - done:
                    done.add(name)
                    held.update(name[a:e] for a in range(len(name) - 1) for e in range(a + 2, min(a + LONGEST, len(name)) + 1))
        if held:
            yield flush()

    return urls.select("chunk", "host", "path").mapInArrow(run, "chunk long, piece string")


def token_cells(urls: DataFrame, pages: DataFrame, title: Column) -> DataFrame:
    """``urls`` (with host and path) and their hashed tokens."""
    counted = title_words(pages, title)
    always, total = lexicon(counted)
    urls = chunked(urls)
    known = substrings(urls).join(counted, F.col("piece") == F.col("w")).select("chunk", "w", "n")
    names = [c for c in urls.columns if c != "chunk"]

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        counts = dict(zip(found.column("w").to_pylist(), map(float, found.column("n").to_pylist()), strict=True))
        split = Segmenter.from_counts(counts | always, total)
        cells = [[cell(t) for t in tokens(h, p, split)] for h, p in
                 zip(rows.column("host").to_pylist(), rows.column("path").to_pylist(), strict=True)]
        return pa.Table.from_arrays(
            [*(rows.column(c) for c in names), pa.array(cells, pa.list_(pa.int32()))], names=[*names, "cells"])

    # Dealt by number: the rows are few bytes but much work, so sizes must not decide
    # how many tasks share it.
    tasks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return urls.repartition(tasks, "chunk").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        run, f"{fields(urls.drop('chunk'))}, cells array<int>")


def fit(ruled: DataFrame) -> tuple[float, np.ndarray]:
    """(log-odds of block before any token, log-odds that each cell adds) from urls with
    ``cells`` and the verdict ``ruled``. Counts of at most CELLS cells come to the
    driver, whatever the input's size."""
    block, allow = F.count_if(F.col("ruled") == "block"), F.count_if(F.col("ruled") == "allow")
    classes = ruled.agg(block.alias("bad"), allow.alias("good")).first()
    bad, good = np.zeros(CELLS), np.zeros(CELLS)
    for r in ruled.select(F.explode("cells").alias("cell"), "ruled").groupBy("cell").agg(
            block.alias("bad"), allow.alias("good")).collect():
        bad[r.cell], good[r.cell] = r.bad, r.good
    for words, into in ((BLOCK_WORDS, bad), (ALLOW_WORDS, good)):
        for w in words:
            for mark in "hp":
                into[cell(f"{mark}:{w}")] += SEED_COUNT
    known = int(((bad + good) > 0).sum()) or 1
    # Only cells that were seen count; the others are alike for both classes.
    odds = np.where(bad + good > 0, np.log((bad + SMOOTH) / (bad.sum() + SMOOTH * known))
                    - np.log((good + SMOOTH) / (good.sum() + SMOOTH * known)), 0.0)
    return math.log(((classes.bad or 0) + 1) / ((classes.good or 0) + 1)), odds.astype(np.float64)


def verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
             title: Column | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row.

    verdict is the longest fitting rule's, else block where naive Bayes finds
    block likelier than allow (score: its log-odds of block; a tie allows).
    It learns from the urls that rules decide, with the classes' shares of them as
    priors; a seed word adds ``SEED_COUNT`` counts of its own. Null urls and urls without :// have empty
    host and path, no tokens, and the likelier class. Repeated rows count once each.
    With an empty table, or one in which no rule fits, only the seeds teach.
    """
    title = F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), r"<title[^>]*>([^<]*)", 1) if title is None else title
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    urls = common.written(token_cells(
        parts.withColumns({"rule": rule, "ruled": verdict}), pages, title), "cells")
    prior, odds = fit(urls.where("ruled is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("cells")
            off = lists.offsets.to_numpy()
            total = np.concatenate([[0.0], np.cumsum(odds[lists.values.to_numpy()])])
            score = np.round(prior + total[off[1:]] - total[off[:-1]], 9)
            mine = np.where(score > 0, "block", "allow")
            ruled = b.column("ruled").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("page_id", "host", "path", "rule")),
                 pa.array([r or m for r, m in zip(ruled, mine.tolist(), strict=True)], pa.string()), pa.array(score)],
                names=["page_id", "host", "path", "rule", "verdict", "score"])

    kind = urls.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
