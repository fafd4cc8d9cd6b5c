"""Quality classifier: a sparse ensemble of rules.

Shallow boosted trees are grown on statistics of labelled texts. Every path
from a root is a conjunctive rule, a lasso logistic regression picks and weighs
the rules, and those with a weight become one Spark column expression over the
statistics. Scoring is a projection: one scan, no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
#: Labelled rows, about, that the driver fits on (chosen by a hash of the id):
#: some 2.5 MB of statistics.
MAX_LABELLED = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text as Spark columns; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words, lines = F.split(t, SPACE), F.split(t, "\n")
    n, n_words, n_lines = F.char_length(t), F.size(words), F.size(lines)
    per_char = lambda c: c / F.greatest(n, F.lit(1))
    per_word = lambda c: c / F.greatest(n_words, F.lit(1))
    seen = lambda s: n - F.char_length(F.replace(t, F.lit(s)))
    return {
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": per_word(n),
        "distinct_words": per_word(F.size(F.array_distinct(words))),
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "words_a_line": n_words / n_lines,
        "shouted": per_word(F.regexp_count(t, F.lit(r"\p{Lu}{2,}"))),
        "capitals": per_word(F.regexp_count(t, F.lit(r"\p{Lu}(?!\p{Lu})"))),
        "symbols": per_char(F.regexp_count(t, F.lit(r"[#$%&*+/<=>@\\^_{}~\[\]]+"))),
        "digits": per_char(F.regexp_count(t, F.lit(r"[0-9]+"))),
        "bars": per_word(seen("|")),
        "exclaims": per_word(seen("!")),
        "stops": per_word(seen(".")),
        "commas": per_word(seen(",")),
    }


@dataclass(frozen=True)
class Rule:
    """All of (statistic, threshold, whether it is above)."""

    terms: tuple[tuple[str, float, bool], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, cut, above in self.terms:
            out = out & ((F.col(name) > cut) if above else (F.col(name) <= cut))
        return out

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, cut, above in self.terms:
            v = x[:, names.index(name)]
            out &= (v > cut) if above else (v <= cut)
        return out


@dataclass(frozen=True)
class Model:
    bias: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1, over columns named as the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def grow(x: np.ndarray, gradient: np.ndarray, cuts: list[np.ndarray], depth: int,
         least: int) -> list[tuple[tuple[tuple[int, float, bool], ...], np.ndarray, float]]:
    """A regression tree by exact search over the cuts: every node below the
    root as (path, rows, mean of the gradient)."""
    out, todo = [], [((), np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        if path:
            out.append((path, rows, float(gradient[rows].mean())))
        if len(path) == depth or len(rows) < 2 * least:
            continue
        g, best = gradient[rows], (1e-9, 0, 0.0)
        base = g.sum() ** 2 / len(rows)
        for j, at in enumerate(cuts):
            place = np.searchsorted(at, x[rows, j], side="left")
            n = np.cumsum(np.bincount(place, minlength=len(at) + 1))[:-1]
            s = np.cumsum(np.bincount(place, g, minlength=len(at) + 1))[:-1]
            ok = (n >= least) & (len(rows) - n >= least)
            if ok.any():
                n, s, c = n[ok], s[ok], at[ok]
                gain = s ** 2 / n + (g.sum() - s) ** 2 / (len(rows) - n) - base
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), j, float(c[k])))
        if best[0] > 1e-9:
            _, j, cut = best
            above = x[rows, j] > cut
            todo += [((*path, (j, cut, False)), rows[~above]), ((*path, (j, cut, True)), rows[above])]
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Proximal gradient with momentum for mean logistic loss + penalty * |w|_1."""
    n, k = z.shape
    rate = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1.0)
    w, v, b, c, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y
        new = v - rate * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = c - rate * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return float(b), w


def fit_rows(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3,
             penalty: float = 0.001, seed: int = 11) -> Model:
    """The ensemble for statistics ``x`` (rows by names) and labels ``y``.
    Without rows, or with one class, the score is constant."""
    if not len(y) or y.min() == y.max():
        return Model({0: 0.0}.get(len(y), 4.0 if len(y) and y[0] else -4.0), ())
    x = np.nan_to_num(x.astype(float))
    rng, y = np.random.default_rng(seed), y.astype(float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 50))) for j in range(x.shape[1])]
    margin, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        part = rng.random(len(y)) < 0.7 if len(y) > 200 else np.ones(len(y), bool)
        nodes = grow(x[part], (y - p)[part], cuts, depth, max(2, len(y) // 500))
        if not nodes:
            break
        for path, _, _ in nodes:
            rules[Rule(tuple(sorted((names[j], round(c, 9), a) for j, c, a in path)))] = None
        inner = {path[:-1] for path, _, _ in nodes}
        for path, _, mean in nodes:
            if path not in inner:  # a leaf moves the margin of all its rows
                rows = Rule(tuple((names[j], c, a) for j, c, a in path)).holds(x, names)
                margin[rows] += 4 * 0.3 * mean
    kept, z = [], []
    for rule in rules:
        col = rule.holds(x, names)
        if 0 < col.sum() < len(col):
            kept.append(rule)
            z.append(col)
    if not kept:
        return Model(float(np.log(y.mean() / (1 - y.mean()))), ())
    bias, w = lasso_logistic(np.array(z, float).T, y, penalty)
    return Model(bias, tuple((r, float(v)) for r, v in zip(kept, w, strict=True) if abs(v) > 1e-6))


def fit(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str = "doc_id", text_col: str = "text",
        held_out: tuple[int, int] = (4, 2), max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the labelled rows outside the held-out fold (modulus,
    remainder of the id's crc32). Null labels teach nothing; of more than
    ``max_labelled`` labels about so many, chosen by hash, are learnt from."""
    chosen = (labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y"))
              .where(F.col("__y").isNotNull() & (common.crc_mod("__id", held_out[0]) != held_out[1])))
    chosen = chosen.where(common.hashed_share("__id", chosen.count(), max_labelled))
    rows = (docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
            .join(F.broadcast(chosen), F.col("__doc") == F.col("__id")))  # about max_labelled rows at most
    stats = statistics(F.col("__text"))
    data = rows.select("__y", *[c.alias(n) for n, c in stats.items()]).toPandas()
    # In a fixed order, so that the model doesn't depend on the tasks' order.
    data = data.sort_values(list(data.columns)).to_numpy(float)
    return fit_rows(data[:, 1:], (data[:, 0] > 0).astype(int), list(stats))


def scored(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with __score and __predicted (1 at the threshold or above).
    Null text scores as empty text; no row is dropped.

    The statistics pass through a generator of one row, below which Catalyst
    pushes no filter: each is computed once, whatever uses the score.
    """
    stats = statistics(F.col(text_col))
    return (docs.withColumn("__struct", F.struct(*[c.alias(n) for n, c in stats.items()]))
            .withColumn("__stats", F.explode(F.array("__struct")))
            .withColumns({f"__{n}": F.col("__stats")[n] for n in stats})
            .withColumn("__score", _prefixed(model).score())
            .withColumn("__predicted", (F.col("__score") >= threshold).cast("int"))
            .drop("__struct", "__stats", *[f"__{n}" for n in stats]))


def _prefixed(model: Model) -> Model:
    return Model(model.bias, tuple(
        (Rule(tuple((f"__{n}", c, a) for n, c, a in r.terms)), w) for r, w in model.weights))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the model accepts."""
    return scored(docs, model, text_col, threshold).where("__predicted = 1").select(*docs.columns)
