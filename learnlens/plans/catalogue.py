"""CLS10: the metric catalogue — (data type, metric) -> plan and label.

``metric(src, data_type, metric, user_id=..., course_id=..., week=...)`` is
the reference's chart request. It builds the all-students plan and applies
the student / course / week as filters on top; Catalyst pushes the
``user_id`` equality down into every Parquet scan, so the one-student form
reads only that student's row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exactsum
from ..functions.scores import round_half_even
from ..operators import daily, scores, summary
from ..sources.tables import Sources


@dataclass(frozen=True)
class MetricSpec:
    data_type: str
    metric: str
    label: str
    kind: str          # "daily" | "weekly_scores" | "weekly_summary"
    name: str          # daily metric name or submission kind


# --- Fixed values: the reference's selectable metrics and their labels -----
CATALOGUE = (
    MetricSpec("Quizzes", "Submissions", "Submissions", "daily", "quiz_submissions"),
    MetricSpec("Quizzes", "Avg Quiz Score", "Average Quiz Score (%)", "weekly_scores", "quiz"),
    MetricSpec("Quizzes", "Max Quiz Score", "Max Quiz Score (%)", "weekly_scores", "quiz"),
    MetricSpec("Files", "File Accesses", "File Accesses", "daily", "file_accesses"),
    MetricSpec("Files", "Unique Files Accessed", "Unique Files Accessed", "daily", "unique_files"),
    MetricSpec("Assignments", "Submissions", "Submissions", "daily", "assignment_submissions"),
    MetricSpec("Assignments", "Avg Assignment Score", "Average Assignment Score (%)",
               "weekly_scores", "assignment"),
    MetricSpec("Assignments", "Max Assignment Score", "Max Assignment Score (%)",
               "weekly_scores", "assignment"),
    MetricSpec("Web Activities", "Weekly Time Summary", "Weekly Summary", "weekly_summary", ""),
    MetricSpec("Web Activities", "Daily Web Activity", "Daily Interactions", "daily",
               "daily_interactions"),
    MetricSpec("Web Activities", "Active Study Time", "Active Study Time (Minutes)", "daily",
               "active_study_time"),
    MetricSpec("Web Activities", "Quiz Time Duration", "Minutes Spent on Quizzes", "daily",
               "quiz_minutes"),
)
# Score metrics also chart the daily means behind the weekly figures.
SCORE_DAILY = {"quiz": "quiz_score", "assignment": "assignment_score"}
# --- end of fixed values ---------------------------------------------------

BY_KEY = {(m.data_type, m.metric): m for m in CATALOGUE}


def lookup(data_type: str, metric: str) -> MetricSpec:
    try:
        return BY_KEY[(data_type, metric)]
    except KeyError:
        raise KeyError(f"no metric {metric!r} for data type {data_type!r}") from None


def _filtered(df: DataFrame, user_id=None, course_id=None, week=None) -> DataFrame:
    if user_id is not None:
        df = df.filter(F.col("user_id") == F.lit(user_id))
    if course_id is not None:
        df = df.filter(F.col("course_id") == F.lit(course_id))
    if week is not None:
        df = df.filter(F.col("week") == F.lit(week))
    return df


def metric(src: Sources, data_type: str, metric_name: str, user_id=None, course_id=None,
           week=None, daily_series: bool = False, ordered: bool = False) -> DataFrame:
    """The rows behind one chart or score card.

    * daily metrics: (user_id, course_id, week, day, value) filled to the
      calendar (7 rows per student, course and week);
    * score metrics: the weekly average / min / max card, or with
      ``daily_series=True`` the filled daily means it is computed from;
    * the weekly summary: one card row per student, course and week.

    ``ordered=True`` sorts the result by student, course, week and day (the
    chart order); leave it off when the rows feed another job.
    """
    spec = lookup(data_type, metric_name)
    if week is not None and not 1 <= week <= src.term.display_weeks:
        raise ValueError(f"week {week} can't be picked; the term has 1..{src.term.display_weeks}")
    df = _filtered(_all_students(src, spec, daily_series), user_id, course_id, week)
    if ordered:
        # SRT1: sort only at the outermost step, for display.
        order = ["user_id", "course_id", "week"] + (["day"] if "day" in df.columns else [])
        df = df.orderBy(*order)
    return df


def _all_students(src: Sources, spec: MetricSpec, daily_series: bool) -> DataFrame:
    """The unfiltered plan of one metric."""
    if spec.kind == "daily":
        return daily.daily_metric(src, spec.name)
    if spec.kind == "weekly_scores":
        return (daily.daily_metric(src, SCORE_DAILY[spec.name]) if daily_series
                else scores.weekly_scores(src, spec.name))
    return summary.weekly_summary(src)


def weekly_values(src: Sources, daily_wide: DataFrame | None = None) -> DataFrame:
    """All twelve metrics as (data_type, metric, label, user_id, course_id, week, value):
    counts and minutes added up over the week, score cards as charted.

    Each fact is brought to days once, for all metrics (``daily_wide``: a written
    :func:`learnlens.operators.daily.daily_metrics_wide` mart); one aggregation makes
    the weeks, and a row per metric is laid out at the end.
    """
    wide = daily.daily_metrics_wide(src) if daily_wide is None else daily_wide
    names = [m.name for m in CATALOGUE if m.kind == "daily"]
    week = {n: F.sum(n).cast("double") for n in names if n != "quiz_minutes"}
    week["quiz_minutes"] = exactsum.total_of("collect_list(quiz_minutes)")   # seven days
    for kind, column in SCORE_DAILY.items():
        scored = f"CASE WHEN {column} > 0 THEN {column} END"
        week[f"{kind}_avg"] = round_half_even(exactsum.mean_of(f"collect_list({scored})"), 1)
        week[f"{kind}_max"] = round_half_even(F.max(F.expr(scored)), 1)
    weekly = wide.groupBy("user_id", "course_id", "week").agg(*[c.alias(n) for n, c in week.items()])

    def value(m: MetricSpec) -> str:
        if m.kind == "daily":
            return m.name
        return "daily_interactions" if m.kind == "weekly_summary" else f"{m.name}_{'max' if 'Max' in m.metric else 'avg'}"

    rows = F.array(*[F.struct(F.lit(m.data_type).alias("data_type"), F.lit(m.metric).alias("metric"),
                              F.lit(m.label).alias("label"), F.col(value(m)).alias("value")) for m in CATALOGUE])
    return weekly.select("user_id", "course_id", "week", F.explode(rows).alias("r")).select(
        "r.data_type", "r.metric", "r.label", "user_id", "course_id", "week", "r.value")


def label(data_type: str, metric_name: str) -> str:
    return lookup(data_type, metric_name).label


def catalogue_frame(spark) -> DataFrame:
    """The catalogue itself as a small DataFrame (for display)."""
    return spark.createDataFrame(
        [(m.data_type, m.metric, m.label, m.kind, m.name) for m in CATALOGUE],
        "data_type string, metric string, label string, kind string, name string")
