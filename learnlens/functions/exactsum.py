"""Sums of doubles that do not depend on the order of rows.

A double is split into three whole numbers: the digits, to base 2^31, that its 53
bits touch, and the place (``frame``) of the highest. Digits of one frame add up
exactly as BIGINT, in any order and in any number of steps, over the whole range of
doubles from the smallest subnormal on. Only the total is rounded, once, to the
nearest double (halves to even), so every partitioning gives the same bits.

    parts = partial_sums(rows, keys, {"minutes": F.col("minutes")})   # map-side combined
    parts.groupBy(*keys).agg(total("collect_list(minutes)"))          # one row per key and frame

The expressions are given to Spark as SQL text: it is parsed at once, where building
them call by call takes longer than running them on a small table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 31
_BASE = f"{1 << BITS}D"
_MASK = (1 << BITS) - 1
_FINITE = "abs({x}) < double('Infinity')"  # NaN is greater than any number
FIELDS = ("frame", "high", "mid", "low", "special", "n")


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _scaled(x: str, n: str) -> str:
    """x * 2^n in two steps, neither of which leaves the range of doubles. Powers of two
    with whole exponents are exact."""
    return f"({x} * pow(2D, floor(({n}) / 2)) * pow(2D, ({n}) - floor(({n}) / 2)))"


def _frame(x: str) -> str:
    """Any frame will do for which 2^-10 <= abs(x) / 2^(31 frame) < 2^31, so the
    logarithm's last bits don't matter."""
    return (f"CAST(CASE WHEN {_FINITE.format(x=x)} AND {x} <> 0 THEN floor((log2(abs({x})) + 5D) / {BITS}) ELSE 0 END AS INT)")


def _steps(x: str, end: str = "") -> list[tuple[str, str]]:
    """(name, expression) in turn: what a value ``x`` is split by. Names end in ``end``."""
    f, y, z = (f"_{n}{end}" for n in "fyz")
    return [(f, _frame(x)),
            (y, f"CASE WHEN {_FINITE.format(x=x)} THEN {_scaled(f'abs({x})', f'{f} * -{BITS}')} ELSE 0D END"),
            (z, f"({y} - floor({y})) * {_BASE}")]


def _digits(x: str, end: str = "") -> dict[str, str]:
    """The fields of a value's digits, from the names of :func:`_steps`."""
    f, y, z = (f"_{n}{end}" for n in "fyz")
    sign = f"IF({x} < 0, -1L, 1L)"
    return {"frame": f, "high": f"floor({y}) * {sign}", "mid": f"floor({z}) * {sign}",
            "low": f"floor(({z} - floor({z})) * {_BASE}) * {sign}",
            "special": f"IF({_FINITE.format(x=x)}, NULL, {x})", "n": f"IF({x} IS NULL, 0L, 1L)"}


def _struct(fields: Mapping[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields.items()) + ")"


def digits(value: str) -> Column:
    """struct(frame, high, mid, low, special, n) of the column ``value``: the digits at
    frame, frame - 1 and frame - 2. ``special`` holds a NaN or infinity instead. Null
    for null."""
    return F.expr(f"IF({value} IS NULL, NULL, {_digits_in_place(value)})")


def _digits_in_place(x: str) -> str:
    out = _struct(_digits(x))
    for name, step in reversed(_steps(x)):
        out = _let(name, step, out)
    return out


def partial_sums(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column],
                 extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Exact partial sums of ``measures`` per ``keys`` and frames, with the ``extra``
    aggregates: a handful of rows per key, each measure a struct for :func:`total`.
    Rows without a value of a measure are counted under its null frame."""
    extra = extra or {}
    rows = df.select(*keys, *[c.alias(n) for n, c in extra.items()], *[c.alias(f"_x_{m}") for m, c in measures.items()])
    # A column for each step, so that all rows are split in generated code.
    for i in range(3):
        rows = rows.selectExpr("*", *["{1} AS {0}".format(*_steps(f"_x_{m}", f"_{m}")[i]) for m in measures])
    frames = [F.expr(f"IF(_x_{m} IS NULL, NULL, _f_{m}) AS _frame_{m}") for m in measures]
    sums = [F.expr(f"sum({e}) AS _{n}_{m}") for m in measures for n, e in _digits(f"_x_{m}", f"_{m}").items() if n != "frame"]
    grouped = rows.groupBy(*keys, *frames).agg(*sums, *[F.sum(n).alias(n) for n in extra])
    return grouped.select(*keys, *extra, *[
        F.expr(f"IF(_frame_{m} IS NULL, NULL, {_struct({n: f'_{n}_{m}' for n in FIELDS})}) AS `{m}`") for m in measures])


def _count(parts: str) -> str:
    return f"aggregate({parts}, 0L, (a, p) -> a + p.n)"


def _carried(sums: str) -> str:
    """Digit sums (ascending) as digits in 0 .. 2^31 - 1, and two more for the carry,
    the last of which is negative if the number is."""
    return (f"aggregate({sums}, named_struct('carry', 0L, 'out', CAST(array() AS ARRAY<BIGINT>)), (s, d) -> named_struct("
            f"'carry', shiftright(d + s.carry, {BITS}), 'out', concat(s.out, array((d + s.carry) & {_MASK}L))), "
            f"s -> concat(s.out, array(s.carry & {_MASK}L, shiftright(s.carry, {BITS}))))")


def _rounded(found: str) -> str:
    """The number with the ascending digits of the variable ``found`` (none negative),
    the first at place ``lo``, as the nearest double."""
    def at(i: int) -> str:
        return f"coalesce(get({found}, top - {i}), 0L)"

    # ``room``: bits that the highest digit leaves of its place. 62 bits are kept; what
    # lies below only matters as not being zero, and goes into the last of them, far
    # below the 53 that a double keeps.
    kept = f"({BITS} - room)"
    bits = f"(shiftleft(shiftleft({at(0)}, {BITS}) | {at(1)}, room) | shiftright({at(2)}, {kept}))"
    below = (f"CAST(({at(2)} & (shiftleft(1L, {kept}) - 1L)) <> 0 "
             f"OR exists(slice({found}, 1, greatest(top - 2, 0)), d -> d <> 0) AS BIGINT)")
    value = _scaled(f"CAST({bits} | {below} AS DOUBLE)", f"(lo + top - 1) * {BITS} - room")
    top = f"CAST(size({found}) - array_position(reverse(transform({found}, d -> d <> 0)), true) AS INT)"
    return (f"IF(exists({found}, d -> d <> 0), "
            + _let("top", top, _let("room", f"{BITS} - length(bin({at(0)}))", value)) + ", 0D)")


def _total(parts: str) -> str:
    """The total of the variable ``parts``."""
    place = (f"aggregate({parts}, 0L, (a, p) -> a + CASE p.frame - j WHEN 0 THEN p.high WHEN 1 THEN p.mid "
             "WHEN 2 THEN p.low ELSE 0L END)")
    sums = f"transform(sequence(lo, array_max(transform({parts}, p -> p.frame))), j -> {place})"
    negative = _let("neg", _carried("transform(sums, d -> -d)"), _rounded("neg"))
    number = _let("sums", sums, _let("pos", _carried("sums"), f"IF(element_at(pos, -1) < 0, -{negative}, {_rounded('pos')})"))
    special = (f"aggregate({parts}, CAST(NULL AS DOUBLE), (a, p) -> IF(a IS NULL, p.special, a + coalesce(p.special, 0D)))")
    return (f"IF(size({parts}) > 0, coalesce({special}, "
            + _let("lo", f"array_min(transform({parts}, p -> p.frame)) - 2", number) + "), NULL)")


#: Digit sums below this (some hundred values) can be added up in doubles.
_SMALL = 1 << 40


def _small(f: str, h: str, m: str, low: str) -> str:
    return f"({f} BETWEEN -30 AND 28 AND abs({h}) < {_SMALL}L AND abs({m}) < {_SMALL}L AND abs({low}) < {_SMALL}L)"


def _in_doubles(f: str, h: str, m: str, low: str) -> str:
    """The number with small digit sums in one frame, rounded once: the error of the
    first addition is found exactly (Knuth's two-sum), and with the lowest digits it is
    a whole number below 2^53, so only the last addition rounds."""
    a, b = f"(CAST({h} AS DOUBLE) * {1 << 2 * BITS}D)", f"(CAST({m} AS DOUBLE) * {_BASE})"
    s = f"({a} + {b})"
    error = f"(({a} - ({s} - ({s} - {a}))) + ({b} - ({s} - {a})))"
    return f"(({s} + ({error} + CAST({low} AS DOUBLE))) * pow(2D, ({f} - 2) * {BITS}))"


def _sum(parts: str) -> str:
    """The total of ``parts``, an expression that costs nothing to repeat. Almost
    always there is one part, of small digits, and no higher-order function runs."""
    one = [f"get({parts}, 0).{n}" for n in ("frame", "high", "mid", "low")]
    return (f"IF(size({parts}) = 1 AND get({parts}, 0).special IS NULL AND {_small(*one)}, {_in_doubles(*one)}, "
            f"IF(size({parts}) > 0, {_let('parts', parts, _total('parts'))}, NULL))")


def _counted(parts: str) -> str:
    return f"IF(size({parts}) = 1, get({parts}, 0).n, {_count(parts)})"


def count(parts: str) -> Column:
    """How many values the parts (an array, as SQL text) were made of."""
    return F.expr(_counted(parts))


def total(parts: str) -> Column:
    """The sum of the values that ``parts`` (SQL text of an array of :func:`digits` or of
    partial sums) were made of, rounded once; null without any value. NaN and
    infinities add up as usual."""
    return F.expr(_sum(parts))


def mean(parts: str) -> Column:
    return F.expr(f"try_divide({_sum(parts)}, {_counted(parts)})")


def _sum_of(values: str) -> str:
    """The total of the variable ``values``, an array without nulls: its digits, added up
    in place where they share a frame."""
    parts = f"transform({values}, x -> {_digits_in_place('x')})"
    adds = ", ".join(f"'{n}', a.{n} + p.{n}" for n in ("high", "mid", "low"))
    added = (f"aggregate(found, named_struct('frame', get(found, 0).frame, 'high', 0L, 'mid', 0L, 'low', 0L), (a, p) -> named_struct("
             f"'frame', IF(p.frame = a.frame AND p.special IS NULL, a.frame, NULL), {adds}))")
    one = [f"all.{n}" for n in ("frame", "high", "mid", "low")]
    quick = _let("all", added, f"IF({_small(*one)}, {_in_doubles(*one)}, {_total('found')})")
    return f"IF(size({values}) > 0, {_let('found', parts, quick)}, NULL)"


def _present(values: str) -> str:
    return f"filter({values}, v -> v IS NOT NULL)"


def total_of(values: str) -> Column:
    """The exactly rounded sum of an array of doubles, as SQL text (nulls left out)."""
    return F.expr(_let("given", _present(values), _sum_of("given")))


def mean_of(values: str) -> Column:
    return F.expr(_let("given", _present(values), f"try_divide({_sum_of('given')}, size(given))"))
