"""Fill-in-the-middle transformation as an Arrow compute pipeline.

A batch of texts is split into units (a word with the white space before it, or
trailing white space), all units of the batch lie flat beside the index of
their text, and their ordinals there decide their role: before the first cut,
between the cuts, after the second. Units of one role are rebuilt into lists and
joined, and the joined pieces of a text are put in the order of its form. Every
step works on whole Arrow arrays; no text is handled by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: White space before a word belongs to the word; what trails is a unit too.
UNIT = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Units are marked off within the text. A text's own ESCAPE is written as
# ESCAPED, so CUT can't occur in it.
ESCAPE, ESCAPED, CUT = "\x01", "\x01\x02", "\x01\x03"


def hash_group(key: Column, group: int) -> Column:
    """The ``group``-th (from 0) eight hex digits of the key's SHA-256, unsigned."""
    return F.conv(F.substring(F.sha2(key, 256), 8 * group + 1, 8), 16, 10).cast("long")


def unit_lists(texts: pa.Array) -> pa.ListArray:
    """Each text's units; every list has one empty string more at its end."""
    safe = pc.replace_substring(texts.cast(pa.large_string()), ESCAPE, ESCAPED)
    marked = pc.replace_substring_regex(safe, UNIT, r"\1" + CUT)
    return pc.split_pattern(marked, CUT)


def _mod(a: pa.Array, n: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, n), n))


def _joined(units: pa.Array, chosen: pa.Array, counts: pa.Array) -> pa.Array:
    """The chosen units, ``counts`` of them for each text in turn, joined."""
    ends = pc.cumulative_sum(counts).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    lists = pa.ListArray.from_arrays(offsets, pc.filter(units, chosen).cast(pa.string()))
    return pc.replace_substring(pc.binary_join(lists, ""), ESCAPED, ESCAPE)


def pieces(texts: pa.Array, h: list[pa.Array], fim_percent: int, spm_percent: int) -> dict[str, pa.Array]:
    """n, form, prefix, middle, suffix and output of each text; ``h`` are the
    text's four hash numbers."""
    lists = unit_lists(texts)
    starts = lists.offsets.cast(pa.int64())
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    n = pc.subtract(pc.list_value_length(lists).cast(pa.int64()), 1)
    ordinal = pc.subtract(pa.array(np.arange(len(units))), pc.take(starts, parent))

    places = pc.add(n, 1)
    one, two = _mod(h[0], places), _mod(h[1], places)
    first, second = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    lo, hi, end = pc.take(first, parent), pc.take(second, parent), pc.take(n, parent)
    prefix = _joined(units, pc.less(ordinal, lo), first)
    middle = _joined(units, pc.and_(pc.greater_equal(ordinal, lo), pc.less(ordinal, hi)), pc.subtract(second, first))
    suffix = _joined(units, pc.and_(pc.greater_equal(ordinal, hi), pc.less(ordinal, end)), pc.subtract(n, second))

    hundred = pa.scalar(100, pa.int64())
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_mod(h[2], hundred), fim_percent))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    spm = pc.less(_mod(h[3], hundred), spm_percent)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    join = pc.binary_join_element_wise
    output = pc.if_else(plain, texts, pc.if_else(
        spm, join(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, ""),
        join(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")))
    return {"n": n, "form": form, "prefix": prefix, "middle": middle, "suffix": suffix, "output": output}


def _between(outputs: pa.Array, mark: str) -> tuple[pa.Array, pa.Array, pa.Array]:
    """What stands before ``mark``, between it and MIDDLE, and after that, behind
    the outputs' first mark. A mark's first place is its own, as no text with a
    mark in it is transformed."""
    body = pc.utf8_slice_codeunits(outputs, len(PREFIX), None)
    halves = pc.split_pattern(body, mark, max_splits=1)
    rest = pc.split_pattern(pc.list_element(halves, 1), MIDDLE, max_splits=1)
    return pc.list_element(halves, 0), pc.list_element(rest, 0), pc.list_element(rest, 1)


def originals(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that ``outputs`` of these forms were made of."""
    psm, spm = pc.equal(forms, "psm"), pc.equal(forms, "spm")
    prefix, suffix, middle = _between(pc.filter(outputs, psm), SUFFIX)
    texts = pc.replace_with_mask(outputs, psm, pc.binary_join_element_wise(prefix, middle, suffix, ""))
    suffix, prefix, middle = _between(pc.filter(outputs, spm), PREFIX)
    return pc.replace_with_mask(texts, spm, pc.binary_join_element_wise(prefix, middle, suffix, ""))


def transform(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (its units), form (``plain``, ``psm`` or
    ``spm``), prefix_chars and middle_chars (code points; null if plain) and
    output, the training text.

    The cuts and the form follow from the SHA-256 of ``seed:doc_id`` alone, so
    equal ids are cut alike and a run can be repeated. A null text counts as
    empty; an empty text, or one that holds a mark already, stays plain. A null
    id is hashed as an empty one. Texts of any length are cut whole; repeated
    rows give repeated results; an empty table gives no rows; other columns of
    ``docs`` are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                        *[hash_group(key, i).alias(f"h{i}") for i in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.slices(batch, "text"):
                p = pieces(b.column("text"), [b.column(f"h{i}") for i in range(4)], fim_percent, spm_percent)
                plain = pc.equal(p["form"], "plain")
                chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(p[x]).cast(pa.int64()))
                         for x in ("prefix", "middle")]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), p["n"], p["form"], *chars, p["output"].cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return named.mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """``made`` (form, output and any other columns, but none named restored)
    with ``restored``, the text rebuilt from form and output alone. Null outputs
    stay null."""
    schema = T.StructType([*made.schema.fields, T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.slices(batch, "output"):
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, originals(b.column("output"), b.column("form"))],
                    names=[*b.schema.names, "restored"])

    return made.mapInArrow(run, schema)
