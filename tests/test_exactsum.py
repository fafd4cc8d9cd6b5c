"""Sums that don't depend on row order: bit-equal to Python's exactly rounded fsum,
over the whole range of doubles and under any partitioning."""

from __future__ import annotations

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from learnlens.functions import exactsum


def bits(x):
    return None if x is None else struct.pack(">d", x + 0.0)


def exact(values):
    """The sum as a fraction, rounded once."""
    values = [v for v in values if v is not None]
    if not values:
        return None
    whole = sum(map(Fraction, values))
    try:
        return float(whole)
    except OverflowError:
        return math.inf if whole > 0 else -math.inf


def groups(seed=11):
    rng = random.Random(seed)
    tiny, huge = 5e-324, 1.7976931348623157e308
    out = [
        [0.1] * 10, [1e16, 1.0, -1e16], [tiny] * 3, [tiny, 1.0], [huge, -huge, tiny], [huge, huge], [-huge, -huge],
        [0.0, -0.0], [-0.0], [None], [None, 2.5], [1.0, 2.0 ** -53], [1.0, 2.0 ** -53, 2.0 ** -200],
        [1.0, 2.0 ** -52, 2.0 ** -53], [2.0 ** -1022, -(2.0 ** -1074)], [-1.0, 2.0 ** -60], [2.0 ** 31, 2.0 ** 62, 2.0 ** 93],
        [2.0 ** 31 - 1] * 5, [2.0 ** 30, -(2.0 ** 61)], [1 / 3, 2 / 3, -1.0]]
    for _ in range(150):
        wide = rng.random() < 0.5
        out.append([rng.choice([-1, 1]) * rng.random() * 2.0 ** (rng.randint(-1070, 1000) if wide else rng.randint(-40, 40))
                    for _ in range(rng.randint(1, 40))])
    for e in range(-1074, 1024):
        out.append([math.ldexp(1.0, e), math.ldexp(rng.random(), min(e + rng.randint(-80, 80), 1023))])
    return out


def test_splitting_keeps_every_bit(spark):
    values = [v for g in groups() for v in g if v is not None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", exactsum.digits("v").alias("d")).collect()
    for r in got:
        d = r.d
        assert max(abs(d.high), abs(d.mid), abs(d.low)) < 1 << exactsum.BITS
        back = sum(Fraction(x) * Fraction(2) ** (exactsum.BITS * (d.frame - i)) for i, x in enumerate((d.high, d.mid, d.low)))
        assert back == Fraction(r.v)


@pytest.mark.parametrize("partitions", [1, 7])
def test_sums_are_rounded_once_under_any_partitioning(spark, partitions):
    data = groups()
    rows = [(k, v) for k, g in enumerate(data) for v in g]
    random.Random(partitions).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, v double").repartition(partitions)
    parts = exactsum.partial_sums(df, ["k"], {"v": F.col("v")}, {"rows": F.lit(1)})
    got = parts.groupBy("k").agg(exactsum.total("collect_list(v)").alias("s"), exactsum.count("collect_list(v)").alias("n"),
                                 F.sum("rows").alias("rows")).collect()
    assert len(got) == len(data)
    for r in got:
        assert bits(r.s) == bits(exact(data[r.k])), data[r.k]
        assert r.n == sum(v is not None for v in data[r.k]) and r.rows == len(data[r.k])


def test_arrays_and_special_values(spark):
    inf, nan = math.inf, math.nan
    cases = [([1.0, None, 2.0], 3.0), ([], None), (None, None), ([inf, 1.0], inf), ([-inf, 5.0], -inf),
             ([0.1, 0.2, 0.3], math.fsum([0.1, 0.2, 0.3]))]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, a array<double>")
    got = {r.i: r.s for r in df.select("i", exactsum.total_of("a").alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]
    odd = spark.createDataFrame([([inf, -inf],), ([nan, 1.0],)], "a array<double>").select(exactsum.total_of("a").alias("s"))
    assert all(math.isnan(r.s) for r in odd.collect())


def test_arrays_are_rounded_once(spark):
    data = groups()
    df = spark.createDataFrame(list(enumerate(data)), "k int, a array<double>")
    for r in df.select("k", exactsum.total_of("a").alias("s"), exactsum.mean_of("a").alias("m")).collect():
        want = exact(data[r.k])
        assert bits(r.s) == bits(want)
        n = sum(v is not None for v in data[r.k])
        assert bits(r.m) == bits(None if want is None else want / n)


def test_means(spark):
    df = spark.createDataFrame([(0, 0.05), (0, 0.1), (1, None)], "k int, v double")
    parts = exactsum.partial_sums(df, ["k"], {"v": F.col("v")})
    got = {r.k: r.m for r in parts.groupBy("k").agg(exactsum.mean("collect_list(v)").alias("m")).collect()}
    assert got == {0: math.fsum([0.05, 0.1]) / 2, 1: None}
