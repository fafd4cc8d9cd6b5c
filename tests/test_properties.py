"""Property tests: random small inputs against pure-Python brute force."""

from __future__ import annotations

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import make_sources
from pyspark.sql import functions as F
from learnlens.operators import ordering, reflections

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40)), min_size=1, max_size=120),
       width=st.integers(1, 9))
def test_row_number_matches_brute_force(spark, rows, width):
    base = datetime(2024, 11, 11)
    data = [(f"u{k}", base + timedelta(seconds=t), i) for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "user_id string, ts timestamp_ntz, event_id long")
    got = {r.event_id: r.seq_num for r in
           ordering.row_number_within(df, ["user_id"], ["ts", "event_id"],
                                      slice_by=F.floor(F.second("ts") / width)).collect()}
    expect, groups = {}, {}
    for u, t, e in data:
        groups.setdefault(u, []).append((t, e))
    for items in groups.values():
        for n, (_, e) in enumerate(sorted(items), start=1):
            expect[e] = n
    assert got == expect


@SETTINGS
@given(weeks=st.sets(st.integers(1, 10), max_size=10))
def test_streaks_match_brute_force(spark, weeks):
    log = [("u", 28301, w, 5, 5, None, datetime(2024, 11, 11) + timedelta(days=7 * (w - 1)), 0, False)
           for w in sorted(weeks)]
    src = make_sources(spark, log=log, enrollments=[("u", 28301)])
    got = {r.current_week: r.streak for r in reflections.reflection_streaks(src).collect()}
    for current in range(1, 11):
        streak = 0
        for w in range(current, 0, -1):
            if w in weeks:
                streak += 1
            else:
                break
        assert got[current] == streak, (sorted(weeks), current)


@SETTINGS
@given(grid=st.sets(st.tuples(st.integers(0, 4), st.integers(0, 3)), max_size=12),
       facts=st.lists(st.tuples(st.integers(0, 5), st.integers(0, 4), st.integers(-5, 20)), max_size=60))
def test_aggregate_onto_grid_matches_brute_force(spark, grid, facts):
    from pyspark.sql import functions as F

    from learnlens.operators.calendar import aggregate_onto_grid
    g = spark.createDataFrame(sorted(grid) or [(99, 99)], "a int, b int")
    f = spark.createDataFrame(facts or [(98, 98, 0)], "a int, b int, v int")
    got = {(r.a, r.b): (r.n, r.s) for r in aggregate_onto_grid(
        g, f, ("a", "b"), {"n": F.count("v"), "s": F.sum("v")}).collect()}
    keys = set(grid) or {(99, 99)}
    expect = {}
    for k in keys:
        vs = [v for a, b, v in facts if (a, b) == k]
        expect[k] = (len(vs), sum(vs) if vs else None)
    assert got == expect
