"""SNK1 and SNK4 refreshed by what changed: marts that fold in new files only.

The event tables are append-only folders. Each mart is a dataset of segments
(:mod:`learnlens.sources.segments`): pre-aggregates of the files that one refresh
found new. A segment's commit notes which files it was made of and the latest event
in them, so the next refresh lists the folder, reads what no segment knows, and
appends one more segment. Rows may come late or in any order: pre-aggregates of the
same day simply merge when the mart is read. The work of a refresh grows with what
was added, not with the term.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Term
from ..operators import distinct, progress
from ..sources import completion, schemas
from ..sources.extracts import Extract, with_points
from ..sources.segments import Conflict, Segments, State
from ..sources.tables import Sources

MANIFEST = "path string, length bigint, modified timestamp"
#: Segments beyond which a refresh merges them into one.
MAX_SEGMENTS = 16


@dataclass(frozen=True)
class Refresh:
    """What one refresh did: the version it left, the files it read, and whether it
    had to start anew."""

    version: int
    files: tuple[str, ...]
    rebuilt: bool = False


class IncrementalMart:
    """A mart over the append-only table at ``source``.

    ``prepare`` makes pre-aggregates of a part of the table's rows, ``merge`` merges
    the rows of many such parts; ``time`` names the event time.
    """

    def __init__(self, spark: SparkSession, root: str, source: str, schema: T.StructType, time: str,
                 prepare: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.root, self.source, self.schema, self.time = spark, root, source, schema, time
        self.prepare, self.merge = prepare, merge
        self.segments = Segments(spark, root)

    def _listing(self) -> DataFrame:
        """The table's files as they are now (their contents aren't read)."""
        return self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option(
            "recursiveFileLookup", "true").load(self.source).select("path", "length", F.col("modificationTime").alias("modified"))

    def _known(self, state: State) -> DataFrame:
        manifests = sorted({m for s in state.segments for m in s.notes["manifests"]})
        if not manifests:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(*manifests)

    def _manifest(self, files: DataFrame) -> str:
        path = f"{self.root}/files/{uuid.uuid4().hex}"
        files.coalesce(1).write.parquet(path)
        return path

    def _notes(self, files: list[str], manifests: list[str], state: State) -> dict:
        latest = self.spark.read.schema(self.schema).parquet(*files).agg(F.max(self.time).cast("string")).first()[0]
        before = [s.notes["high_water"] for s in state.segments if s.notes["high_water"] is not None]
        return {"manifests": manifests, "high_water": max([*before, latest] if latest else before, default=None)}

    def refresh(self) -> Refresh:
        """Fold in the files that no segment was made of. A file that was changed or
        removed since it was read makes the mart anew. Of two refreshes at a time one
        goes first, and the other sees what is left then."""
        while True:
            state = self.segments.state()
            run = f"refresh-{sum(r.startswith('refresh-') for r in state.runs) + 1}"
            listed = self.spark.read.schema(MANIFEST).parquet(self._manifest(self._listing()))
            known = self._known(state)
            same = ["path", "length", "modified"]
            rebuilt = known.join(listed, same, "left_anti").limit(1).count() > 0
            new = listed if rebuilt else listed.join(known, "path", "left_anti")
            files = sorted(r.path for r in new.collect())  # what was added since the last refresh
            if not files and not rebuilt:
                return Refresh(state.version, ())
            rows = self.spark.read.schema(self.schema).parquet(*files) if files else \
                self.spark.createDataFrame([], self.schema)
            notes = self._notes(files, [self._manifest(new)], State(0, (), frozenset()) if rebuilt else state) if files else \
                {"manifests": [], "high_water": None}
            try:
                if rebuilt:
                    version = self.segments.replace(state, self.prepare(rows), run, notes)
                else:
                    version = self.segments.append(self.prepare(rows), run, notes)
            except Conflict:
                continue
            if len(state.segments) >= MAX_SEGMENTS:
                self.compact()
            return Refresh(version, tuple(files), rebuilt)

    def compact(self) -> None:
        """Merge the segments into one. If another writer was faster, its work stands."""
        state = self.segments.state()
        known = self._manifest(self._known(state))
        water = max((s.notes["high_water"] for s in state.segments if s.notes["high_water"]), default=None)
        try:
            self.segments.replace(state, self.merge(self.segments.read(state)), notes={"manifests": [known], "high_water": water})
        except Conflict:
            pass

    def high_water(self) -> str | None:
        """The latest event folded in."""
        return max((s.notes["high_water"] for s in self.segments.state().segments if s.notes["high_water"]), default=None)

    def read(self) -> DataFrame:
        empty = self.prepare(self.spark.createDataFrame([], self.schema)).schema
        return self.merge(self.segments.read(schema=empty))


@dataclass(frozen=True)
class Marts:
    """The incremental marts of one set of silver tables."""

    src: Sources
    clicks: IncrementalMart
    quiz: IncrementalMart
    assignment: IncrementalMart
    items: tuple[IncrementalMart, IncrementalMart]

    @classmethod
    def over(cls, spark: SparkSession, silver: str, root: str, term: Term, reflection_log: DataFrame | None = None,
             user_type: T.DataType = T.StringType()) -> "Marts":
        src = Sources.from_silver(spark, silver, reflection_log, term, user_type)
        keep_all = lambda df: df

        def mart(name: str, table: str, schema, time: str, prepare, merge) -> IncrementalMart:
            path = f"{silver}/{schemas.SILVER_TABLES[table]}"
            return IncrementalMart(spark, f"{root}/{name}", path, schema(user_type), time, prepare, merge)

        quiz = ("quiz_submissions", schemas.quiz_submissions, "finished_at_anonymous")
        done = ("submissions", schemas.submissions, "submitted_at_anonymous")
        return cls(
            src,
            mart("click_days", "web_logs", schemas.web_logs, "timestamp",
                 lambda df: distinct.click_days(replace(src, web_logs=df)), distinct.merged),
            mart("quiz_data", *quiz, lambda df: replace(src, quiz_submissions=df).quiz_submissions_in_term(), keep_all),
            mart("assignment_data", *done, lambda df: replace(src, submissions=df).submissions_in_term(), keep_all),
            (mart("quiz_weeks", *quiz, lambda df: progress.quiz_weeks(replace(src, quiz_submissions=df)), DataFrame.distinct),
             mart("assignment_weeks", *done, lambda df: progress.assignment_weeks(replace(src, submissions=df)), DataFrame.distinct)))

    def refresh(self) -> dict[str, Refresh]:
        every = (self.clicks, self.quiz, self.assignment, *self.items)
        return {m.root.rsplit("/", 1)[-1]: m.refresh() for m in every}

    def extract(self) -> Extract:
        """SNK1: the five datasets for all students, from the marts. Points and
        enrolments are small tables of states and read as they are."""
        days = distinct.daily_web_activity(self.clicks.read())
        web = days.select("user_id", "course_id", "day", "interactions", "first_activity", "last_activity", "week")
        files = days.where("file_accesses > 0").select("user_id", "course_id", "day", "file_accesses", "unique_files", "week")
        return Extract(
            courses=self.src.enrollments.select("user_id", "course_id").distinct(),
            quiz_data=with_points(self.quiz.read(), self.src, "quiz"),
            assignment_data=with_points(self.assignment.read(), self.src, "assignment"),
            web_activity_data=web, file_access_data=files, term=self.src.term)

    def completion(self) -> DataFrame:
        """SNK4: every block's completion flag, from the submitted weeks folded in so
        far and the reflections that stand now."""
        masks = progress.block_masks(self.src, submitted=(self.items[0].read(), self.items[1].read()))
        return completion.completion_snapshot(progress.block_progress(self.src, masks=masks))
