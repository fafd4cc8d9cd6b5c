"""Existing extract documents read into marts: hand-written files as their writer
leaves them, broken ones, superseded ones, and the answers from the result."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest

from learnlens.config import REFERENCE_TERM
from learnlens.sources import documents, extracts
from tests.conftest import rows, ts

QUIZ = [{"course_id": 28301, "quiz_id": 7, "finished_at_anonymous": "2024-11-12 10:30:00", "score_anonymous": 4,
         "DurationInMinutes": 12.5, "workflow_state": "complete", "points_possible": 8, "week": 1},
        {"course_id": "28301", "quiz_id": 8, "finished_at_anonymous": "2024-11-20T09:00:00", "DurationInMinutes": "NA",
         "workflow_state": "untaken", "points_possible": 8}]
WEB = [{"course_id": 28301, "day": "2024-11-12", "interactions": 3, "first_activity": "2024-11-12 08:00:00",
        "last_activity": "2024-11-12 10:00:00.25", "week": 1}]
FILES = [{"course_id": 28301, "day": "2024-11-12", "file_accesses": 2, "unique_files": 1, "week": 1}]


def document(user, cached_at="2024-12-01 10:00:00", courses=28301, **datasets):
    empty = {m: [] for m in documents.FIELDS}
    return json.dumps({"user_id": user, "cached_at": cached_at, "courses": courses} | empty | datasets, indent=2)


TEXTS = {
    # One course: unboxed. Two: an array of texts. Three as numbers, one of them no number.
    "u_1": document("u@1", quiz_data=QUIZ, web_activity_data=WEB, file_access_data=FILES),
    "u_2": document("u2", courses=["28301", "27886"], quiz_data={}, assignment_data=[
        {"course_id": 27886, "assignment_id": 3, "submitted_at_anonymous": "2024-11-25 00:00:00", "score_anonymous": "Inf",
         "workflow_state": "graded", "points_possible": 10, "week": 3}]),
    "u3": document("u3", courses=[27886, 28301, "x"], quiz_data=[QUIZ[0], 5, {"quiz_id": 1}, {"course_id": 1}]),
    # An older and two newest documents of one student.
    "u4old": document("u4", "2024-11-01 00:00:00", 27893, quiz_data=QUIZ),
    "u4a": document("u4", courses=27886, quiz_data=QUIZ[:1]),
    "u4b": document("u4", courses=[27886, 27974], quiz_data=QUIZ[1:]),
    "number": document(12, courses=27886),
    "broken": '{"user_id": "u9", ', "empty": "", "list": "[1, 2]", "nobody": '{"courses": 1}',
    "nocourse": '{"user_id": "u8", "courses": []}', "badquiz": document("u7", quiz_data="none"),
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(f"cached_data_{k}.json", v) for k, v in TEXTS.items()], "file string, value string")


def test_marts_of_documents(texts):
    marts = documents.marts(documents.staged(texts), REFERENCE_TERM)
    assert rows(marts["courses"], "user_id", "course_id") == sorted([
        ("u@1", 28301), ("u2", 27886), ("u2", 28301), ("u3", 27886), ("u3", 28301), ("u4", 27886), ("u4", 27974),
        ("12", 27886)], key=str)
    one = (28301, ts("2024-11-12 10:30:00"), 7, 4.0, 12.5, "complete", 8.0, 1)
    two = (28301, ts("2024-11-20 09:00:00"), 8, None, None, "untaken", 8.0, 2)  # its week is counted
    assert rows(marts["quiz_data"]) == sorted(
        [("u@1", *one), ("u@1", *two), ("u3", *one), ("u4", *one), ("u4", *two)], key=lambda t: tuple((x is None, str(x)) for x in t))
    assert rows(marts["assignment_data"]) == [
        ("u2", 27886, ts("2024-11-25 00:00:00"), 3, float("inf"), "graded", 10.0, 3)]
    assert rows(marts["web_activity_data"]) == [
        ("u@1", 28301, date(2024, 11, 12), 3, ts("2024-11-12 08:00:00"), ts("2024-11-12 10:00:00.25"), 1)]
    assert rows(marts["file_access_data"]) == [("u@1", 28301, date(2024, 11, 12), 2, 1, 1)]


def test_what_cannot_be_read_is_rejected_with_its_reason(texts):
    got = {(r.file[len("cached_data_"):-len(".json")], r.part, r.pos): r.reason
           for r in documents.rejects(documents.staged(texts)).collect()}
    assert got == {
        ("broken", "document", 0): "not JSON", ("empty", "document", 0): "not JSON", ("list", "document", 0): "not an object",
        ("nobody", "document", 0): "no user_id", ("nocourse", "document", 0): "no courses",
        ("badquiz", "document", 0): "quiz_data is no array", ("u3", "courses", 2): "no course number",
        ("u3", "quiz_data", 1): "not an object", ("u3", "quiz_data", 2): "no course_id",
        ("u3", "quiz_data", 3): "no finished_at_anonymous"}


def test_documents_are_parsed_row_by_row(texts):
    plan = documents.staged(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_imported_documents_answer_queries(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in TEXTS.items():
        (folder / f"cached_data_{name}.json").write_text(text)
    (folder / "notes.txt").write_text("not an extract")
    root = str(tmp_path / "out")
    documents.import_documents(spark, str(folder), root, REFERENCE_TERM)
    ex = extracts.Extract.read(spark, root, REFERENCE_TERM)
    assert rows(extracts.query(ex, "quiz_weeks"), "user_id", "course_id", "week") == [
        ("u3", 28301, 1), ("u4", 28301, 1), ("u@1", 28301, 1)]
    scores = extracts.query(ex, "quiz_scores", user_id="u@1", course_id=28301,
                            start=date(2024, 11, 11), end=date(2024, 11, 17))
    assert rows(scores, "day", "value")[:2] == [(date(2024, 11, 11), 0.0), (date(2024, 11, 12), 50.0)]
    assert scores.count() == 7
    assert documents.read_rejects(spark, root).count() == 9  # an empty file has no row
    # Ages come from the documents, not from the files just written.
    ages = extracts.extract_ages(spark, root, datetime(2024, 12, 4, 12))
    assert {r.user_id: r.age for r in ages.collect()} == dict.fromkeys(["u@1", "u2", "u3", "u4", "12"], "3 days ago")


def test_numeric_ids_take_the_warehouse_type(spark, texts):
    from pyspark.sql import types as T
    marts = documents.marts(documents.staged(texts, T.LongType()), REFERENCE_TERM)
    assert rows(marts["courses"], "user_id", "course_id") == [(12, 27886)]
    assert marts["quiz_data"].schema["user_id"].dataType == T.LongType()


def test_no_documents(spark):
    none = spark.createDataFrame([], "file string, value string")
    staged = documents.staged(none)
    assert documents.rejects(staged).count() == 0
    assert all(df.count() == 0 for df in documents.marts(staged, REFERENCE_TERM).values())


def test_a_document_is_parsed_once_for_each_use(spark):
    # Conditions on its fields used to move below the parsing and repeat it, and the making of the text.
    from pyspark.sql import functions as F
    users = spark.range(3).select(F.concat(F.lit("cached_data_"), "id", F.lit(".json")).alias("file"), F.to_json(F.struct(
        F.col("id").alias("user_id"), F.lit(28301).alias("courses"), F.array(F.struct(
            F.lit(28301).alias("course_id"), F.lit("2024-11-12").alias("day"))).alias("web_activity_data"))).alias("value"))
    web = documents.marts(documents.staged(users), REFERENCE_TERM)["web_activity_data"]
    plan = web._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2  # the newest documents, and their elements
    assert rows(web, "user_id", "day", "week") == [(str(i), date(2024, 11, 12), 1) for i in range(3)]


ODD = {"null": "null", "five": "5", "text": '"x"', "nouser": '{"user_id": null, "courses": 1}', "na": '{"user_id": " NA ", "courses": 1}',
       "nulls": '{"user_id": "a", "courses": [1, null, "NA"], "quiz_data": [null, [], {"course_id": "NA"}], "web_activity_data": null, '
                '"file_access_data": {}}',
       "object": '{"user_id": "b", "courses": 1, "assignment_data": {"course_id": 1}}', "nullcourse": '{"user_id": "c", "courses": null}'}


def test_odd_values_keep_their_reasons(spark):
    texts = spark.createDataFrame([(k, v) for k, v in ODD.items()] + [("none", None)], "file string, value string")
    staged = documents.staged(texts)
    assert rows(documents.rejects(staged)) == sorted([
        ("none", "document", 0, "not JSON"), ("null", "document", 0, "not an object"), ("five", "document", 0, "not an object"),
        ("text", "document", 0, "not an object"), ("nouser", "document", 0, "no user_id"), ("na", "document", 0, "no user_id"),
        ("nulls", "courses", 1, "no course number"), ("nulls", "courses", 2, "no course number"),
        ("nulls", "quiz_data", 0, "not an object"), ("nulls", "quiz_data", 1, "not an object"), ("nulls", "quiz_data", 2, "no course_id"),
        ("object", "document", 0, "assignment_data is no array"), ("nullcourse", "courses", 0, "no course number")],
        key=lambda t: tuple((x is None, str(x)) for x in t))
    assert {m: df.count() for m, df in documents.marts(staged, REFERENCE_TERM).items()} == {
        "courses": 1} | dict.fromkeys(documents.FIELDS, 0)
