"""Driver-shaped tables with events exactly on week boundaries (Monday
00:00:00): every registered query still equals its DuckDB twin, so the
closed-week option and the half-open default are both exercised."""

from __future__ import annotations

import shutil
import tempfile
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from conftest import SF0001


@pytest.fixture(scope="module")
def boundary_dir():
    import os
    folder = tempfile.mkdtemp(prefix="learnlens-boundary-")
    for name in os.listdir(SF0001):
        if name != "events.parquet":
            shutil.copy(f"{SF0001}/{name}", folder)
    events = pq.read_table(f"{SF0001}/events.parquet")
    extra = []
    base_id = 10_000_000
    for i, (day, kind) in enumerate([(8, "view"), (8, "click"), (15, "purchase"), (22, "purchase"),
                                     (15, "view"), (29, "signup"), (8, "purchase"), (22, "error")]):
        extra.append({"event_id": base_id + i, "ts": datetime(2024, 1, day), "user_id": 1 + i % 3,
                      "event_type": kind, "value": 12.5 + i, "props": f'{{"k": {i * 7}}}'})
    add = pa.Table.from_pylist(extra, schema=events.schema)
    pq.write_table(pa.concat_tables([events, add]), f"{folder}/events.parquet")
    return folder


def test_boundary_events_match_oracle(spark, boundary_dir):
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from oracle_check import compare
    from learnlens.plans import queries
    res = compare(spark, boundary_dir, list(queries.registered()), verbose=False)
    assert [k for k, v in res.items() if v[0] != "ok"] == []
    closed = res["weekly_summary_closed_weeks"]
    assert closed[1] == res["weekly_summary"][1]


def test_closed_weeks_count_boundary_events_twice(spark, boundary_dir):
    from pyspark.sql import functions as F

    import __spark_entry__ as entry
    qs = entry.queries()
    half = qs["weekly_summary"](spark, boundary_dir).agg(F.sum("total_interactions")).first()[0]
    closed = qs["weekly_summary_closed_weeks"](spark, boundary_dir).agg(F.sum("total_interactions")).first()[0]
    assert closed > half          # Monday 00:00 clicks also count for the week before
