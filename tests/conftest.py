from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from learnlens.config import REFERENCE_TERM  # noqa: E402
from learnlens.sources import schemas  # noqa: E402
from learnlens.sources.tables import Sources  # noqa: E402

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    s = (SparkSession.builder.master("local[*]")
         .appName("learnlens-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.autoBroadcastJoinThreshold", "-1")
         .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "64m")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def make_sources(spark, web=(), quiz=(), quizzes=(), subs=(), assignments=(), enrollments=(),
                 log=(), term=REFERENCE_TERM) -> Sources:
    """Small literal source tables with the silver schemas (user ids are strings).

    web: (user, course, timestamp, attachment_id[, event_id])
    quiz: (user, course, quiz_id, finished_at, score, duration, state)
    subs: (user, course, assignment_id, submitted_at, score, state)
    quizzes / assignments: (id, points)
    log: (user, course, week, satisfaction, expectation, feedback, saved_at, seq, deleted)
    """
    user = T.StringType()
    web_schema = schemas.web_logs(user).add("event_id", T.LongType())
    web_rows = [tuple(r) + ((i,) if len(r) == 4 else ()) for i, r in enumerate(web)]
    return Sources(
        web_logs=spark.createDataFrame(web_rows, web_schema),
        quiz_submissions=spark.createDataFrame(list(quiz), schemas.quiz_submissions(user)),
        quizzes=spark.createDataFrame(list(quizzes), schemas.points_dimension()),
        submissions=spark.createDataFrame(list(subs), schemas.submissions(user)),
        assignments=spark.createDataFrame(list(assignments), schemas.points_dimension()),
        enrollments=spark.createDataFrame(list(enrollments), schemas.enrollments(user)),
        reflection_log=spark.createDataFrame(list(log), schemas.reflection_log(user)),
        term=term,
    )


def rows(df, *cols, order=None):
    cols = cols or tuple(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))
