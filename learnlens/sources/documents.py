"""SRC2 for extracts that exist already: one JSON document per student, with the
five datasets as arrays, parsed into the five marts.

A document is parsed once, as VARIANT. Its elements become rows at once and are
typed there, so no student's documents or datasets are put together again. What
can't be read goes to a reject table with its reason, and the rest of the document
stays. The writers of such documents unbox vectors of one element, so ``courses``
is an array or a single value, and numbers may be texts (``"NA"`` is missing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Term
from ..functions.time import week_of
from . import commits, extracts

# --- Fixed values: fields of the documents ---------------------------------
#: Dataset -> field -> type. The first two fields identify a row: without them
#: it is rejected.
FIELDS = {
    "quiz_data": {"course_id": "bigint", "finished_at_anonymous": "timestamp_ntz", "quiz_id": "bigint",
                  "score_anonymous": "double", "DurationInMinutes": "double", "workflow_state": "string",
                  "points_possible": "double", "week": "bigint"},
    "assignment_data": {"course_id": "bigint", "submitted_at_anonymous": "timestamp_ntz", "assignment_id": "bigint",
                        "score_anonymous": "double", "workflow_state": "string", "points_possible": "double",
                        "week": "bigint"},
    "web_activity_data": {"course_id": "bigint", "day": "date", "interactions": "bigint",
                          "first_activity": "timestamp_ntz", "last_activity": "timestamp_ntz", "week": "bigint"},
    "file_access_data": {"course_id": "bigint", "day": "date", "file_accesses": "bigint", "unique_files": "bigint",
                         "week": "bigint"},
}
MISSING = "NA"
FILE_NAME = r"^cached_data_(.*)\.json$"
# --- end of fixed values ---------------------------------------------------

#: The row that stands for a document itself.
HEADER = "document"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): every document below ``path`` whole, with its file's name. Empty
    files give no row."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), "value").where(F.col("file").rlike(FILE_NAME))


def _typed(variant: Column, path: str, dtype: str) -> Column:
    """A field as text or number alike; missing, null, ``NA`` and unreadable values
    are null."""
    text = F.try_variant_get(variant, path, "string")
    if dtype != "string":  # of which ``NA`` is none
        return text.try_cast(dtype)
    return F.when(F.trim(text) != MISSING, text)


def _is(variant: Column, kind: str) -> Column:
    return F.schema_of_variant(variant).startswith(kind)


def staged(texts: DataFrame, user_type: T.DataType = T.StringType()) -> DataFrame:
    """(file, user_id, cached_at, part, pos, value, reason), one row per element of
    each dataset, one per course and one (part ``document``) per document.

    Documents that can't be read at all, and elements that can't, carry the
    ``reason`` and are otherwise left out by :func:`marts`.
    """
    # As output of a generator the parsed document is made once: conditions on its fields
    # would else move below the parsing, and each repeat it and the making of the text.
    parsed = texts.select("file", F.explode(F.array(F.try_parse_json("value"))).alias("v"))
    v = F.col("v")
    head = parsed.select(
        "file", "v", _typed(v, "$.user_id", "string").try_cast(user_type).alias("user_id"),
        _typed(v, "$.cached_at", "timestamp_ntz").alias("cached_at"),
        F.coalesce(F.try_variant_get(v, "$.courses", "array<variant>"),
                   F.array(F.try_variant_get(v, "$.courses", "variant"))).alias("courses"),
        *[F.try_variant_get(v, f"$.{m}", "array<variant>").alias(m) for m in FIELDS])
    # Schemas are made of what can't be read only: of a whole document they cost more than reading it.
    reason = F.when(v.isNull(), "not JSON") \
        .when(F.col("user_id").isNull(), F.when(~_is(v, "OBJECT"), "not an object").otherwise("no user_id")) \
        .when(F.get("courses", 0).isNull(), "no courses")
    for m in FIELDS:  # an empty dataset may be written as an empty object
        other = F.try_variant_get(v, f"$.{m}", "variant")
        bad = F.col(m).isNull() & other.isNotNull() & ~F.schema_of_variant(other).isin("VOID", "OBJECT<>")
        reason = reason.when(bad, f"{m} is no array")
    checked = head.withColumn("reason", reason)
    whole = F.col("reason").isNull()
    # Parts first, then their elements: a condition on the part goes between the two.
    parts = checked.select("file", "user_id", "cached_at", "courses", *FIELDS, "reason",
                           F.explode(F.array(*[F.lit(p) for p in (HEADER, "courses", *FIELDS)])).alias("part"))
    part = F.col("part")
    values = F.when(part == HEADER, F.array(F.parse_json(F.lit("null"))))
    for p in ("courses", *FIELDS):
        values = values.when((part == p) & whole, F.col(p))
    rows = parts.select("file", "user_id", "cached_at", "part", "reason", F.posexplode(values).alias("pos", "value"))
    value = F.col("value")
    wrong = F.when((part == "courses") & _typed(value, "$", "bigint").isNull(), "no course number")
    for m, fields in FIELDS.items():
        for name, dtype in list(fields.items())[:2]:
            why = F.when(~_is(value, "OBJECT"), "not an object").otherwise(f"no {name}")
            wrong = wrong.when((part == m) & _typed(value, f"$.{name}", dtype).isNull(), why)
    return rows.select("file", "user_id", "cached_at", "part", "pos", "value",
                       F.coalesce("reason", wrong).alias("reason"))


def rejects(rows: DataFrame) -> DataFrame:
    """(file, part, pos, reason) of what could not be read."""
    return rows.where("reason IS NOT NULL").select("file", "part", "pos", "reason")


def marts(rows: DataFrame, term: Term) -> dict[str, DataFrame]:
    """The five extract datasets from :func:`staged` rows, as
    :func:`learnlens.sources.extracts.extract_frames` has them.

    A student's newest documents count (by ``cached_at``; none is oldest): all that
    share that time, so a large extract may be split over several files, and an
    older one is superseded as a whole. A week that isn't stored is counted anew.
    """
    good = rows.where("reason IS NULL")
    newest = good.where(F.col("part") == HEADER).groupBy(F.col("user_id").alias("_user")).agg(
        F.max("cached_at").alias("_newest"))

    def kept(part: str, **fields: Column) -> DataFrame:
        """The part's elements, typed before they are moved to be compared."""
        typed = good.where(F.col("part") == part).select("user_id", "cached_at", *[c.alias(n) for n, c in fields.items()])
        same = (F.col("user_id") == F.col("_user")) & F.col("cached_at").eqNullSafe(F.col("_newest"))
        return typed.join(newest, same, "left_semi")

    value = F.col("value")
    out = {"courses": kept("courses", course_id=_typed(value, "$", "bigint")).groupBy("user_id", "course_id").agg(
        F.max("cached_at").alias("cached_at"))}
    for m, fields in FIELDS.items():
        typed = kept(m, **{name: _typed(value, f"$.{name}", dtype) for name, dtype in fields.items()}).drop("cached_at")
        time = list(fields)[1]
        out[m] = typed.withColumn("week", F.coalesce("week", week_of(time, term)))
    return out


def import_documents(spark: SparkSession, path: str, root: str, term: Term,
                     user_type: T.DataType = T.StringType(), run_id: int | None = None) -> int:
    """Documents below ``path`` into a committed extract under ``root`` (read by
    ``Extract.read``), with the reject table beside it; returns the run.

    Every document is read and parsed once; its rows are written, and the marts
    are typed from there.
    """
    run = run_id if run_id is not None else commits.new_run_id()
    schema = commits.write_run(staged(read_texts(spark, path), user_type), f"{root}/_documents", run, ("part",))
    rows = commits.read_run(spark, f"{root}/_documents", run, schema)
    schemas = {name: extracts.write_mart(df, name, root, run) for name, df in marts(rows, term).items()}
    schemas["rejects"] = commits.write_run(rejects(rows), f"{root}/rejects", run)
    commits.commit(spark, root, "extract", run, schemas)
    return run


def read_rejects(spark: SparkSession, root: str, run_id: int | None = None) -> DataFrame:
    """The reject table of the latest committed import (or the given run)."""
    run, schemas = commits.committed(spark, root, "extract", run_id)
    return commits.read_run(spark, f"{root}/rejects", run, schemas["rejects"])
