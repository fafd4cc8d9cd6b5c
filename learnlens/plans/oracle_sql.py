"""DuckDB twins of the registered queries.

Each statement re-derives the source tables from the driver's ``events`` and
``part`` views (the FIXTURES.md §2 mapping) and computes the metric with
plain SQL, written independently of the DataFrame plans: joins where the
plans union-and-aggregate, windows where the plans use array functions.
States, cut-offs, labels and texts are written out here, not imported, so a
wrong constant in the engine shows.
"""

from __future__ import annotations

from datetime import datetime

from ..config import DRIVER_TERM, Term

# --- Fixed values: must equal the reference's for right results ------------
QUIZ_STATES = ("pending_review", "complete")
ASSIGNMENT_STATES = ("pending_review", "graded", "submitted")
LOW_BELOW, MIDDLE_BELOW = 60, 80
COURSES = (("27886", "0HV30-2024"), ("28301", "0HV60-2024"), ("27893", "0HV90-2024"), ("27974", "0HV100-2024"))
UNKNOWN = "Unknown Course"
TITLE = "- Self-Regulated Learning Reflection Dashboard"
CATEGORY_TEXT = {
    'struggling': "🚨 It seems you're struggling and not feeling hopeful. What small change could help you feel more in control next week?",
    'hopeful': "😟 You're not satisfied, but you're hopeful things can improve. That's a strong mindset! What will you try differently?",
    'steady': "😐 You're maintaining a steady pace, but not seeing much progress. What's holding you back, and how can you break through?",
    'growth': "🌱 You're looking to grow! Think about what support, habits, or focus can help you improve next week.",
    'good': "👍 You're on a steady path and feeling good about it. Keep doing what works!",
    'flying': "🚀 You're flying high! Excellent work and strong confidence. Reflect on what's driving your success so you can repeat it.",
    'between': "🧭 You're somewhere in between. Take a moment to reflect on what's working and where you can grow.",
}
VERSUS_TEXT = {
    'exceeded_low': "<br><br>📈 You exceeded your expectations, even if satisfaction is still low, that's a step forward. What helped this week?",
    'exceeded': '<br><br>🎉 You surpassed your expectations! Great progress, reflect on what contributed to that.',
    'matched_low': '<br><br>⚖️ You matched your expectations, but satisfaction remains low. What could lift your experience next week?',
    'matched': '<br><br>🧠 You met your expectations, a great sign of self-awareness. Stay consistent!',
    'short_low': "<br><br>🚧 You fell short of your expectations and aren't feeling great. What barriers came up? How can you respond differently next time?",
    'short': "<br><br>🤔 You didn't meet your goals, but you're still satisfied. Maybe you set your expectations too high? Adjusting goals is also growth.",
}
OUTLOOK_TEXT = {
    'higher': "<br><br>📈 You're aiming higher next week, awesome! What's your action plan to reach that goal?",
    'dip': "<br><br>📉 You're expecting a dip next week, is something changing? Reflect on how to adapt while keeping your momentum.",
    'consistent': "<br><br>🔁 You're aiming for consistency, sounds like you're building a rhythm. What will help you maintain that?",
}
BLOCK_ALL_DONE = "Great job! You've completed all activities for this block. 🎉"
BLOCK_SOME_DONE = "Excellent! You've checked another activity off the list. Keep the momentum going! 💪"
BLOCK_NONE_DONE = ("It looks like you're just getting started! For a good overview, perhaps look at "
                   'the activity breakdown to see where you can best invest your time. 🗺️')
PREVIOUS_NONE_DONE = "You didn't complete any activities last block. Let's aim for more this time!"
PREVIOUS_ALL_DONE = 'You completed all activities last block! Keep up the great work!'
PREVIOUS_SOME_DONE = ('You completed %d out of %d activities last block. Every step counts—can you do e'
                      'ven better this week?')
NO_PREVIOUS_BLOCK = 'No previous block to report yet.'
STREAK_TEXT = '🏅 <strong>%d-Week Streak!</strong> Reflection badge for %d weeks.'
BADGES = (
    ('rookie', 'reflections', 1, 'img/ROOKIE.png', 'Your first reflection - Nice start!', 'Reflect for the first time.'),
    ('consistent', 'reflections', 4, 'img/CONSISTENT.png', '4 weeks of reflections - Keep reflecting!', 'Reflect for 4 weeks.'),
    ('master', 'reflections', 8, 'img/MASTER.png', '8 weeks of reflecting?! – Good job!', 'Reflect for 8 weeks.'),
    ('selfaware', 'blocks', 1, 'img/SELF-AWARE.png', 'You have completed all your activities - Nice start!', 'Complete the activity tracker for the first time.'),
    ('insightchampion', 'blocks', 2, 'img/INSIGHT.png', 'You have finished your second block of activities - Very nice!', 'Complete the activity tracker for the second time.'),
    ('kingofwisdom', 'blocks', 4, 'img/KING.png', 'You have complete all the activities for this course - Amazing!', 'Complete all the activities for the entire course.'),
)
LOCKED_IMAGE = 'img/QUESTION.png'
# --- end of fixed values ---------------------------------------------------


def _q(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _case(column: str, table: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in table.items())
    return f"CASE {column} {whens} END"


def _week(term: Term, ts: str) -> str:
    return (f"CAST(floor(date_diff('day', DATE '{term.start.isoformat()}', CAST({ts} AS DATE)) / 7) + 1 "
            f"AS BIGINT)")


def _in_term(term: Term, ts: str, cutoff: str | None = None) -> str:
    s, e = term.start.isoformat(), term.end.isoformat()
    cond = f"{ts} >= TIMESTAMP '{s} 00:00:00' AND {ts} < TIMESTAMP '{e} 00:00:00'"
    if cutoff:
        cond += f" AND {ts} < TIMESTAMP '{cutoff}'"
    return cond


def fact_views(term: Term = DRIVER_TERM, sfx: str = "", cutoff: str | None = None) -> str:
    """Term-bound facts and current reflections; ``cutoff`` keeps only rows
    before that time (the state of the tables as of then)."""
    week, in_term = (lambda ts: _week(term, ts)), (lambda ts: _in_term(term, ts, cutoff))
    return f""",
web_t{sfx} AS (
  SELECT *, CAST("timestamp" AS DATE) AS day, {week('"timestamp"')} AS week
  FROM web_logs WHERE {in_term('"timestamp"')}),
quiz_t{sfx} AS (
  SELECT s.*, q.points_possible, CAST(finished_at_anonymous AS DATE) AS day,
         {week('finished_at_anonymous')} AS week,
         COALESCE(s.score_anonymous / NULLIF(q.points_possible, 0) * 100, 0) AS pct
  FROM quiz_submissions s LEFT JOIN quizzes q ON s.quiz_id = q.id
  WHERE {in_term('finished_at_anonymous')}),
asg_t{sfx} AS (
  SELECT s.*, a.points_possible, CAST(submitted_at_anonymous AS DATE) AS day,
         {week('submitted_at_anonymous')} AS week,
         COALESCE(s.score_anonymous / NULLIF(a.points_possible, 0) * 100, 0) AS pct
  FROM submissions s LEFT JOIN assignments a ON s.assignment_id = a.id
  WHERE {in_term('submitted_at_anonymous')}),
refl_log{sfx} AS (
  SELECT user_id, CAST(27000 + k % 4 AS BIGINT) AS course_id,
         least(greatest({week('ts')}, 1), {term.max_week}) AS week,
         CAST(1 + event_id % 10 AS INTEGER) AS satisfaction,
         CAST(1 + k % 10 AS INTEGER) AS expectation, ts AS saved_at, event_id AS seq
  FROM ev WHERE event_type = 'error' AND {in_term('ts')}),
reflections{sfx} AS (
  SELECT user_id, course_id, week, satisfaction, expectation, saved_at FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, course_id, week
                                 ORDER BY saved_at DESC, seq DESC) AS rn
    FROM refl_log{sfx}) WHERE rn = 1)"""


def views(term: Term = DRIVER_TERM) -> str:
    """The mapped source tables, grids and term-bound facts as CTEs."""
    s = term.start.isoformat()
    last = term.last_day.isoformat()
    week = lambda ts: _week(term, ts)
    return f"""
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events),
web_logs AS (
  SELECT user_id, CAST(27000 + k % 4 AS BIGINT) AS course_id, ts AS "timestamp",
         CASE WHEN event_type = 'view' THEN k END AS attachment_id, event_id
  FROM ev),
quiz_submissions AS (
  SELECT user_id, CAST(27000 + k % 4 AS BIGINT) AS course_id, k AS quiz_id,
         ts AS finished_at_anonymous,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE least(value, CAST(50.0 AS DOUBLE)) END AS score_anonymous,
         value AS DurationInMinutes,
         CASE event_id % 4 WHEN 0 THEN 'untaken' WHEN 1 THEN 'pending_review' ELSE 'complete' END
           AS workflow_state
  FROM ev WHERE event_type = 'purchase'),
submissions AS (
  SELECT user_id, CAST(27000 + k % 4 AS BIGINT) AS course_id, k AS assignment_id,
         ts AS submitted_at_anonymous,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE least(value, CAST(50.0 AS DOUBLE)) END AS score_anonymous,
         CASE event_id % 4 WHEN 0 THEN 'unsubmitted' WHEN 1 THEN 'pending_review'
                           WHEN 2 THEN 'graded' ELSE 'submitted' END AS workflow_state
  FROM ev WHERE event_type = 'signup'),
quizzes AS (
  SELECT p_partkey AS id,
         CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS points_possible
  FROM part),
assignments AS (SELECT id, points_possible FROM quizzes),
enrollments AS (SELECT DISTINCT user_id, course_id FROM web_logs),
grid_days AS (
  SELECT user_id, course_id, CAST(d AS DATE) AS day, {week('d')} AS week FROM (
    SELECT user_id, course_id,
           unnest(generate_series(TIMESTAMP '{s} 00:00:00', TIMESTAMP '{last} 00:00:00',
                                  INTERVAL 1 DAY)) AS d
    FROM enrollments)),
grid_weeks AS (
  SELECT user_id, course_id, CAST(unnest(range(1, {term.weeks + 1})) AS BIGINT) AS week
  FROM enrollments)""" + fact_views(term)


def _bround(x: str, digits: int) -> str:
    """Half-even rounding of a double's shortest decimal form (what Spark's
    ``bround`` and R's ``round`` do). DuckDB's ``round_even`` on a decimal
    looks only at the first dropped digit, so exact ties are detected here
    and every other value is rounded half-up."""
    d = f"CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 20))"
    scale = 10 ** digits
    return (f"CAST(CASE WHEN {d} * {scale} - floor({d} * {scale}) = 0.5 "
            f"THEN round_even({d}, {digits}) ELSE round({d}, {digits}) END AS DOUBLE)")


def _with(body: str, term: Term = DRIVER_TERM) -> str:
    return "WITH " + views(term).strip() + "\n" + body


def _band(col: str) -> str:
    return (f"CASE WHEN {col} < {LOW_BELOW} THEN 'low' WHEN {col} < {MIDDLE_BELOW} THEN 'middle' "
            f"WHEN {col} IS NOT NULL THEN 'high' END")


def _daily_fill(inner: str, value: str, cast: str) -> str:
    return _with(f"""
SELECT g.user_id, g.course_id, g.week, g.day, CAST(COALESCE(m.v, 0) AS {cast}) AS value
FROM grid_days g LEFT JOIN ({inner}) m
  ON g.user_id = m.user_id AND g.course_id = m.course_id AND g.day = m.day""")


DAILY_SQL = {
    "daily_interactions": ("SELECT user_id, course_id, day, COUNT(*) AS v FROM web_t GROUP BY 1, 2, 3",
                           "BIGINT"),
    "active_study_time": ("SELECT user_id, course_id, day, COUNT(*) * 2 AS v FROM web_t GROUP BY 1, 2, 3",
                          "BIGINT"),
    "file_accesses": ("SELECT user_id, course_id, day, COUNT(*) AS v FROM web_t "
                      "WHERE attachment_id IS NOT NULL GROUP BY 1, 2, 3", "BIGINT"),
    "unique_files": ("SELECT user_id, course_id, day, COUNT(DISTINCT attachment_id) AS v FROM web_t "
                     "WHERE attachment_id IS NOT NULL GROUP BY 1, 2, 3", "BIGINT"),
    "quiz_submissions": ("SELECT user_id, course_id, day, COUNT(*) AS v FROM quiz_t GROUP BY 1, 2, 3",
                         "BIGINT"),
    "assignment_submissions": ("SELECT user_id, course_id, day, COUNT(*) AS v FROM asg_t GROUP BY 1, 2, 3",
                               "BIGINT"),
    "quiz_score": ("SELECT user_id, course_id, day, fsum(pct) / COUNT(pct) AS v FROM quiz_t GROUP BY 1, 2, 3", "DOUBLE"),
    "assignment_score": ("SELECT user_id, course_id, day, fsum(pct) / COUNT(pct) AS v FROM asg_t GROUP BY 1, 2, 3",
                         "DOUBLE"),
    "quiz_minutes": ("SELECT user_id, course_id, day, fsum(DurationInMinutes) AS v FROM quiz_t "
                     "GROUP BY 1, 2, 3", "DOUBLE"),
}


def daily_metric_sql(name: str) -> str:
    inner, cast = DAILY_SQL[name]
    return _daily_fill(inner, "v", cast)


def daily_web_activity_sql() -> str:
    return _with("""
SELECT user_id, course_id, week, day,
       COUNT(*) AS interactions, MIN("timestamp") AS first_activity, MAX("timestamp") AS last_activity,
       COUNT(attachment_id) AS file_accesses, COUNT(DISTINCT attachment_id) AS unique_files
FROM web_t GROUP BY user_id, course_id, week, day""")


def weekly_summary_sql(mean: str = "active", inclusive_end: bool = False, term: Term = DRIVER_TERM) -> str:
    start = term.start.isoformat()

    def edge(table: str, ts: str) -> str:
        # closed window: an event at exactly next Monday 00:00 also counts for the week before
        if not inclusive_end:
            return ""
        return (f" UNION ALL SELECT user_id, course_id, week - 1 AS week, day, {ts} AS ts_, "
                f"{'NULL' if table == 'web_t' else 'DurationInMinutes'} AS m FROM {table} "
                f"WHERE {ts} = CAST(day AS TIMESTAMP) AND date_diff('day', DATE '{start}', day) % 7 = 0 "
                f"AND week > 1")

    avg = ({"active": f"CASE WHEN COALESCE(w.days, 0) > 0 THEN {_bround('w.total / w.days', 1)} ELSE 0.0 END",
            "calendar": _bround('COALESCE(w.total, 0) / 7.0', 1)}[mean])
    return _with(f"""
, web_x AS (
  SELECT user_id, course_id, week, day, "timestamp" AS ts_, NULL AS m FROM web_t{edge('web_t', '"timestamp"')}),
quiz_x AS (
  SELECT user_id, course_id, week, day, finished_at_anonymous AS ts_, DurationInMinutes AS m FROM quiz_t
  {edge('quiz_t', 'finished_at_anonymous')}),
web_days AS (
  SELECT user_id, course_id, week, day, COUNT(*) AS n FROM web_x GROUP BY ALL),
web_w AS (
  SELECT user_id, course_id, week, SUM(n) AS total, COUNT(*) AS days FROM web_days GROUP BY ALL),
quiz_w AS (
  SELECT user_id, course_id, week, fsum(m) AS minutes FROM quiz_x GROUP BY ALL)
SELECT g.user_id, g.course_id, g.week,
       CAST(COALESCE(w.total, 0) AS BIGINT) AS total_interactions,
       CAST(COALESCE(w.total, 0) * 2 AS BIGINT) AS session_minutes,
       CAST(COALESCE(w.days, 0) AS BIGINT) AS active_days,
       {avg} AS avg_daily_interactions,
       CAST(COALESCE(q.minutes, 0) AS DOUBLE) AS quiz_minutes,
       {_bround('COALESCE(w.total, 0) * 2 / 60.0', 1)} AS study_hours,
       {_bround('CAST(COALESCE(q.minutes, 0) AS DOUBLE) / 60.0', 1)} AS quiz_hours,
       CASE WHEN COALESCE(w.days, 0) >= 5 THEN 'Excellent'
            WHEN COALESCE(w.days, 0) >= 3 THEN 'Good'
            WHEN COALESCE(w.days, 0) > 0 THEN 'Limited'
            ELSE 'No Activity' END AS engagement
FROM grid_weeks g
LEFT JOIN web_w w ON g.user_id = w.user_id AND g.course_id = w.course_id AND g.week = w.week
LEFT JOIN quiz_w q ON g.user_id = q.user_id AND g.course_id = q.course_id AND g.week = q.week""", term)


# ----------------------------------------------------------------- courses
def enrollments_sql() -> str:
    return _with("SELECT user_id, course_id FROM enrollments")


def course_labels_sql() -> str:
    return _labels_of("enrollments")


def _labels_of(pairs: str) -> str:
    values = ", ".join(f"('{c}', '{l}')" for c, l in COURSES)
    return _with(f"""
, labels(cid, label) AS (VALUES {values})
SELECT e.user_id, e.course_id, COALESCE(l.label, '{UNKNOWN}') AS course_label,
       l.label IS NOT NULL AS known,
       COALESCE(l.label, '{UNKNOWN}') || ' ' || '{TITLE}' AS title
FROM {pairs} e LEFT JOIN labels l ON CAST(e.course_id AS VARCHAR) = l.cid""")


KNOWN_PAIRS = """(SELECT user_id, CAST(CASE course_id WHEN 27000 THEN 27886 WHEN 27001 THEN 28301 WHEN 27002 THEN 27893
                          ELSE course_id END AS BIGINT) AS course_id FROM enrollments)"""


def known_course_labels_sql() -> str:
    return _labels_of(KNOWN_PAIRS)


def known_courses_sql() -> str:
    return f"SELECT user_id, course_id, course_label FROM ({known_course_labels_sql()}) WHERE known"


# ------------------------------------------------------------------ scores
def _daily_scores_cte(table: str, null_day: str = "zero_null") -> str:
    raw = "score_anonymous / NULLIF(points_possible, 0) * 100"
    value = ("fsum(pct) / COUNT(pct)" if null_day == "zero_null" else
             f"CASE WHEN COUNT(*) FILTER (WHERE {raw} IS NULL) > 0 THEN 0.0 ELSE fsum({raw}) / COUNT({raw}) END")
    return f"""
, ds AS (
  SELECT user_id, course_id, week, day, {value} AS value, COUNT(*) AS n_submissions
  FROM {table} GROUP BY user_id, course_id, week, day)"""


def daily_scores_sql(kind: str, null_day: str = "zero_null") -> str:
    table = "quiz_t" if kind == "quiz" else "asg_t"
    return _with(_daily_scores_cte(table, null_day) + f"""
SELECT user_id, course_id, week, day, value, n_submissions, {_bround('value', 1)} AS score,
       {_band(_bround('value', 1))} AS band, strftime(day, '%b %d') AS day_label
FROM ds""")


def weekly_scores_sql(kind: str) -> str:
    table = "quiz_t" if kind == "quiz" else "asg_t"
    return _with(_daily_scores_cte(table) + f"""
, nz AS (
  SELECT user_id, course_id, week, {_bround('fsum(value) / COUNT(value)', 1)} AS avg_score,
         {_bround('MIN(value)', 1)} AS min_score, {_bround('MAX(value)', 1)} AS max_score
  FROM ds WHERE value > 0 GROUP BY user_id, course_id, week)
SELECT g.user_id, g.course_id, g.week, nz.avg_score, nz.min_score, nz.max_score,
       {_band('nz.avg_score')} AS avg_band, {_band('nz.min_score')} AS min_band,
       {_band('nz.max_score')} AS max_band,
       nz.user_id IS NOT NULL AS has_submissions,
       CASE WHEN nz.user_id IS NULL THEN 'No submissions this week.' END AS message
FROM grid_weeks g LEFT JOIN nz
  ON g.user_id = nz.user_id AND g.course_id = nz.course_id AND g.week = nz.week""")


# ---------------------------------------------------------------- progress
def quiz_weeks_sql() -> str:
    return _with(f"SELECT DISTINCT user_id, course_id, week FROM quiz_t "
                 f"WHERE workflow_state IN ({_q(QUIZ_STATES)})")


def assignment_weeks_sql() -> str:
    return _with(f"SELECT DISTINCT user_id, course_id, week FROM asg_t "
                 f"WHERE workflow_state IN ({_q(ASSIGNMENT_STATES)})")


def _progress_ctes(term: Term = DRIVER_TERM, sfx: str = "", scope: str = "course") -> str:
    """Activity grid ``ag{sfx}`` and block progress ``bp{sfx}``; with
    ``scope="user"`` a submission counts for every course of the student."""
    def subs(table: str, activity: str, states) -> str:
        if scope == "course":
            return (f"SELECT user_id, course_id, week, '{activity}' AS activity FROM {table}{sfx} "
                    f"WHERE workflow_state IN ({_q(states)})")
        return (f"SELECT e.user_id, e.course_id, s.week, '{activity}' AS activity FROM enrollments e "
                f"JOIN (SELECT DISTINCT user_id, week FROM {table}{sfx} "
                f"WHERE workflow_state IN ({_q(states)})) s ON s.user_id = e.user_id")
    return f"""
, grid_items{sfx} AS (
  SELECT user_id, course_id, week, unnest(['quiz', 'assignment', 'reflection']) AS activity FROM (
    SELECT user_id, course_id, CAST(unnest(range(1, {term.block_weeks + 1})) AS BIGINT) AS week
    FROM enrollments)),
done{sfx} AS (
  {subs('quiz_t', 'quiz', QUIZ_STATES)}
  UNION
  {subs('asg_t', 'assignment', ASSIGNMENT_STATES)}
  UNION
  SELECT user_id, course_id, week, 'reflection' FROM reflections{sfx}),
ag{sfx} AS (
  SELECT g.user_id, g.course_id, CAST(floor((g.week - 1) / 2) * 2 + 1 AS BIGINT) AS block_start,
         g.week, g.activity,
         CASE g.activity WHEN 'quiz' THEN 'Submit Week ' || g.week || ' Quiz'
                         WHEN 'assignment' THEN 'Submit Week ' || g.week || ' Assignment'
                         ELSE 'Reflect on Week ' || g.week END AS name,
         d.user_id IS NOT NULL AS done
  FROM grid_items{sfx} g LEFT JOIN done{sfx} d
    ON g.user_id = d.user_id AND g.course_id = d.course_id AND g.week = d.week
   AND g.activity = d.activity),
bc{sfx} AS (
  SELECT user_id, course_id, block_start, COUNT(*) AS total,
         COUNT(*) FILTER (WHERE done) AS completed
  FROM ag{sfx} GROUP BY user_id, course_id, block_start),
bp{sfx} AS (
  SELECT b.user_id, b.course_id, b.block_start, b.block_start + 1 AS block_end, b.total, b.completed,
         CAST({_bround('b.completed * 100.0 / b.total', 0)} AS INTEGER) AS percent,
         b.completed = b.total AS is_complete,
         CASE WHEN b.completed = b.total AND b.total > 0 THEN '{_esc(BLOCK_ALL_DONE)}'
              WHEN b.completed > 0 THEN '{_esc(BLOCK_SOME_DONE)}'
              ELSE '{_esc(BLOCK_NONE_DONE)}' END AS message,
         COALESCE(p.total, 0) AS previous_total, COALESCE(p.completed, 0) AS previous_completed,
         CASE WHEN b.block_start - 2 < 1 THEN '{_esc(NO_PREVIOUS_BLOCK)}'
              WHEN COALESCE(p.completed, 0) = 0 THEN '{_esc(PREVIOUS_NONE_DONE)}'
              WHEN p.completed = p.total AND p.total > 0 THEN '{_esc(PREVIOUS_ALL_DONE)}'
              ELSE printf('{_esc(PREVIOUS_SOME_DONE)}', p.completed, p.total) END
           AS previous_message
  FROM bc{sfx} b LEFT JOIN bc{sfx} p
    ON p.user_id = b.user_id AND p.course_id = b.course_id AND p.block_start = b.block_start - 2)"""


def _esc(text: str) -> str:
    return text.replace("'", "''")


def activity_grid_sql() -> str:
    return _with(_progress_ctes() + "\nSELECT * FROM ag")


def block_progress_sql(scope: str = "course") -> str:
    return _with(_progress_ctes(scope=scope) + "\nSELECT * FROM bp")


def completion_sql() -> str:
    return _with(_progress_ctes() + "\nSELECT user_id, course_id, block_start, is_complete AS completed FROM bp")


def completion_changes_sql(cutoff: str) -> str:
    return _with(fact_views(DRIVER_TERM, "_prev", cutoff) + _progress_ctes(DRIVER_TERM, "_prev")
                 + _progress_ctes() + """
SELECT COALESCE(n.user_id, o.user_id) AS user_id, COALESCE(n.course_id, o.course_id) AS course_id,
       COALESCE(n.block_start, o.block_start) AS block_start,
       CASE WHEN COALESCE(n.is_complete, false) AND NOT COALESCE(o.is_complete, false) THEN 'set'
            ELSE 'cleared' END AS change
FROM bp n FULL OUTER JOIN bp_prev o
  ON n.user_id = o.user_id AND n.course_id = o.course_id AND n.block_start = o.block_start
WHERE COALESCE(n.is_complete, false) <> COALESCE(o.is_complete, false)""")


# ------------------------------------------------------------- reflections
def _category(s: str, e: str) -> str:
    return (f"CASE WHEN {s} <= 4 AND {e} <= 4 THEN 'struggling' "
            f"WHEN {s} <= 4 AND {e} >= 7 THEN 'hopeful' "
            f"WHEN {s} BETWEEN 5 AND 6 AND {e} <= {s} THEN 'steady' "
            f"WHEN {s} <= 6 AND {e} > {s} THEN 'growth' "
            f"WHEN {s} BETWEEN 7 AND 8 AND {e} = {s} THEN 'good' "
            f"WHEN {s} >= 9 AND {e} >= 9 THEN 'flying' ELSE 'between' END")


def _versus(s: str, p: str) -> str:
    return (f"CASE WHEN {p} IS NULL THEN NULL "
            f"WHEN {s} > {p} THEN (CASE WHEN {s} < 6 THEN 'exceeded_low' ELSE 'exceeded' END) "
            f"WHEN {s} = {p} THEN (CASE WHEN {s} < 6 THEN 'matched_low' ELSE 'matched' END) "
            f"ELSE (CASE WHEN {s} < 6 THEN 'short_low' ELSE 'short' END) END")


def _outlook(s: str, e: str) -> str:
    return f"CASE WHEN {e} > {s} THEN 'higher' WHEN {e} < {s} THEN 'dip' ELSE 'consistent' END"


def _feedback_cte() -> str:
    return f"""
, fb0 AS (
  SELECT r.user_id, r.course_id, r.week, r.satisfaction, r.expectation,
         p.expectation AS last_expectation
  FROM reflections r LEFT JOIN reflections p
    ON p.user_id = r.user_id AND p.course_id = r.course_id AND p.week = r.week - 1),
fb1 AS (
  SELECT *, {_category('satisfaction', 'expectation')} AS category,
         {_versus('satisfaction', 'last_expectation')} AS versus_last,
         {_outlook('satisfaction', 'expectation')} AS outlook
  FROM fb0),
fb AS (
  SELECT *, concat_ws(' ', {_case('category', CATEGORY_TEXT)},
                      {_case('versus_last', VERSUS_TEXT)},
                      {_case('outlook', OUTLOOK_TEXT)}) AS feedback
  FROM fb1)"""


def reflections_sql() -> str:
    return _with("SELECT user_id, course_id, week, satisfaction, expectation, saved_at FROM reflections")


def reflection_feedback_sql() -> str:
    return _with(_feedback_cte() + "\nSELECT * FROM fb")


def reflection_categories_sql() -> str:
    return _with(_feedback_cte() + "\nSELECT category, COUNT(*) AS reflections FROM fb GROUP BY category")


def reflections_per_week_sql() -> str:
    return _with("SELECT week, COUNT(*) AS reflections FROM reflections GROUP BY week")


def reflection_counts_sql() -> str:
    return _with("""
SELECT e.user_id, e.course_id, COUNT(r.week) AS reflections
FROM enrollments e LEFT JOIN reflections r ON e.user_id = r.user_id AND e.course_id = r.course_id
GROUP BY e.user_id, e.course_id""")


def reflection_streaks_sql(term: Term = DRIVER_TERM) -> str:
    text = _esc(STREAK_TEXT)
    return _with(f"""
, isl AS (
  SELECT user_id, course_id, week,
         week - row_number() OVER (PARTITION BY user_id, course_id ORDER BY week) AS island
  FROM reflections),
runs AS (
  SELECT user_id, course_id, week,
         week - MIN(week) OVER (PARTITION BY user_id, course_id, island) + 1 AS run
  FROM isl)
SELECT g.user_id, g.course_id, g.week AS current_week, CAST(COALESCE(r.run, 0) AS BIGINT) AS streak,
       COALESCE(r.run, 0) >= 2 AS shown,
       CASE WHEN COALESCE(r.run, 0) >= 2 THEN printf('{text}', r.run, r.run) END AS message
FROM grid_weeks g LEFT JOIN runs r
  ON g.user_id = r.user_id AND g.course_id = r.course_id AND g.week = r.week
WHERE g.week <= {term.display_weeks}""", term)


def long_streaks_sql(minutes: int, term: Term) -> str:
    """Gaps and islands over ``term``'s weeks of so many minutes, for 20 students."""
    text = _esc(STREAK_TEXT)
    return _with(f"""
, seen AS (
  SELECT DISTINCT user_id % 20 AS user_id, course_id,
         date_diff('minute', TIMESTAMP '{term.start}', date_trunc('minute', "timestamp")) // {minutes} + 1 AS week FROM web_logs),
isl AS (
  SELECT *, week - row_number() OVER (PARTITION BY user_id, course_id ORDER BY week) AS island
  FROM seen WHERE week BETWEEN 1 AND {term.display_weeks}),
runs AS (
  SELECT user_id, course_id, week, week - MIN(week) OVER (PARTITION BY user_id, course_id, island) + 1 AS run FROM isl),
grid AS (SELECT DISTINCT user_id % 20 AS user_id, course_id, unnest(range(1, {term.display_weeks + 1})) AS week FROM enrollments)
SELECT g.user_id, g.course_id, g.week AS current_week, CAST(COALESCE(r.run, 0) AS BIGINT) AS streak,
       COALESCE(r.run, 0) >= 2 AS shown,
       CASE WHEN COALESCE(r.run, 0) >= 2 THEN printf('{text}', r.run, r.run) END AS message
FROM grid g LEFT JOIN runs r ON g.user_id = r.user_id AND g.course_id = r.course_id AND g.week = r.week""")


def badges_sql() -> str:
    rows = ", ".join(
        f"({i}, '{b}', '{k}', {t}, '{_esc(img)}', '{_esc(on)}', '{_esc(off)}')"
        for i, (b, k, t, img, on, off) in enumerate(BADGES, start=1))
    return _with(_progress_ctes() + f"""
, defs(position, badge, counts, threshold, unlocked_image, unlocked_tooltip, locked_tooltip)
  AS (VALUES {rows}),
rc AS (SELECT user_id, course_id, COUNT(*) AS n FROM reflections GROUP BY user_id, course_id),
cb AS (SELECT user_id, course_id, COUNT(*) AS n FROM bp WHERE is_complete GROUP BY user_id, course_id),
have AS (
  SELECT e.user_id, e.course_id, d.*,
         CASE WHEN d.counts = 'reflections' THEN COALESCE(rc.n, 0) ELSE COALESCE(cb.n, 0) END AS have
  FROM enrollments e CROSS JOIN defs d
  LEFT JOIN rc ON rc.user_id = e.user_id AND rc.course_id = e.course_id
  LEFT JOIN cb ON cb.user_id = e.user_id AND cb.course_id = e.course_id)
SELECT user_id, course_id, position, badge, counts, CAST(threshold AS BIGINT) AS threshold, have,
       have >= threshold AS unlocked,
       CASE WHEN have >= threshold THEN unlocked_tooltip ELSE locked_tooltip END AS tooltip,
       CASE WHEN have >= threshold THEN unlocked_image ELSE '{LOCKED_IMAGE}' END AS image
FROM have""")


# ------------------------------------------------------ ordering and marts
def daily_row_number_sql(more: str = "") -> str:
    return _with(f"""
SELECT user_id, course_id, day, "timestamp", event_id{more},
       row_number() OVER (PARTITION BY user_id, course_id, day ORDER BY "timestamp", event_id) AS seq_num
FROM web_t""")


def _wide_cte() -> str:
    return """
, w AS (SELECT user_id, course_id, day, COUNT(*) AS n, COUNT(attachment_id) AS fa,
               COUNT(DISTINCT attachment_id) AS uf FROM web_t GROUP BY user_id, course_id, day),
q AS (SELECT user_id, course_id, day, COUNT(*) AS n, fsum(pct) / COUNT(pct) AS s, fsum(DurationInMinutes) AS m
      FROM quiz_t GROUP BY user_id, course_id, day),
a AS (SELECT user_id, course_id, day, COUNT(*) AS n, fsum(pct) / COUNT(pct) AS s
      FROM asg_t GROUP BY user_id, course_id, day),
wide AS (
  SELECT g.user_id, g.course_id, g.week, g.day,
         COALESCE(w.n, 0) AS daily_interactions, COALESCE(w.n, 0) * 2 AS active_study_time,
         COALESCE(w.fa, 0) AS file_accesses, COALESCE(w.uf, 0) AS unique_files,
         COALESCE(q.n, 0) AS quiz_submissions, COALESCE(a.n, 0) AS assignment_submissions,
         COALESCE(q.s, 0) AS quiz_score, COALESCE(a.s, 0) AS assignment_score,
         CAST(COALESCE(q.m, 0) AS DOUBLE) AS quiz_minutes
  FROM grid_days g
  LEFT JOIN w ON g.user_id = w.user_id AND g.course_id = w.course_id AND g.day = w.day
  LEFT JOIN q ON g.user_id = q.user_id AND g.course_id = q.course_id AND g.day = q.day
  LEFT JOIN a ON g.user_id = a.user_id AND g.course_id = a.course_id AND g.day = a.day)"""


def daily_metrics_sql(term: Term = DRIVER_TERM) -> str:
    return _with(_wide_cte() + "\nSELECT * FROM wide", term)


def no_activity_weeks_sql(names) -> str:
    parts = [f"SELECT user_id, course_id, week, '{n}' AS metric, bool_and({n} = 0) AS no_activity "
             f"FROM wide GROUP BY user_id, course_id, week" for n in names]
    return _with(_wide_cte() + "\n" + "\nUNION ALL\n".join(parts))


def weekly_quiz_minutes_sql() -> str:
    return _with("""
SELECT user_id, course_id, week, CAST(COALESCE(fsum(DurationInMinutes), 0) AS DOUBLE) AS quiz_minutes
FROM quiz_t GROUP BY user_id, course_id, week""")


def extract_quiz_data_sql() -> str:
    return _with("""
SELECT user_id, course_id, quiz_id, finished_at_anonymous, score_anonymous, DurationInMinutes,
       workflow_state, points_possible, week FROM quiz_t""")


def extract_assignment_data_sql() -> str:
    return _with("""
SELECT user_id, course_id, assignment_id, submitted_at_anonymous, score_anonymous, workflow_state,
       points_possible, week FROM asg_t""")


def extract_web_activity_sql() -> str:
    return _with("""
SELECT user_id, course_id, day, COUNT(*) AS interactions, MIN("timestamp") AS first_activity,
       MAX("timestamp") AS last_activity, week
FROM web_t GROUP BY user_id, course_id, day, week""")


def extract_file_access_sql() -> str:
    return _with("""
SELECT user_id, course_id, day, COUNT(*) AS file_accesses, COUNT(DISTINCT attachment_id) AS unique_files,
       week
FROM web_t WHERE attachment_id IS NOT NULL GROUP BY user_id, course_id, day, week""")


def distinct_files_sql(by: str, days: tuple | None = None) -> str:
    span = f" AND day BETWEEN DATE '{days[0]}' AND DATE '{days[1]}'" if days else ""
    names = ", ".join(c.split(" AS ")[-1].strip() for c in by.split(", "))
    return _with(f"""
SELECT {by}, COUNT(*) AS file_accesses, COUNT(DISTINCT attachment_id) AS unique_files
FROM web_t WHERE attachment_id IS NOT NULL{span} GROUP BY {names}""")


def documents_rejects_sql() -> str:
    """Each course comes with one broken document and one whose quizzes are a number."""
    return _with("""
SELECT 'document' AS part, reason, COUNT(*) AS documents
FROM enrollments, (VALUES ('not JSON'), ('quiz_data is no array')) AS bad(reason) GROUP BY reason""")


# ------------------------------------------- requests, documents and labels
def weekly_sentence_sql() -> str:
    return f"""
SELECT user_id, course_id, week,
       engagement || ' Engagement • ' || total_interactions || ' interactions • Avg: '
       || CAST({_bround('avg_daily_interactions', 0)} AS INTEGER) || '/day' AS sentence
FROM ({weekly_summary_sql()})"""


def week_dates_sql() -> str:
    start = DRIVER_TERM.start.isoformat()
    return _with(f"""
SELECT user_id, course_id, week, CAST(DATE '{start}' + CAST((week - 1) * 7 AS INTEGER) AS DATE) AS week_start,
       CAST(DATE '{start}' + CAST((week - 1) * 7 + 6 AS INTEGER) AS DATE) AS week_end FROM grid_weeks""")


def display_weeks_sql(term: Term) -> str:
    return _with(f"""
SELECT least(greatest(week, 1), {term.max_week}) AS display_week, COUNT(*) AS interactions,
       MIN(week) AS first_week, MAX(week) AS last_week
FROM web_t GROUP BY 1""", term)


def reflections_after_deletes_sql() -> str:
    return _with("""
SELECT user_id, course_id, week, satisfaction, expectation, saved_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, course_id, week ORDER BY saved_at DESC, seq DESC) AS rn
  FROM refl_log) WHERE rn = 1 AND seq % 5 <> 0""")


def reflection_documents_sql() -> str:
    return _with("""
SELECT user_id || '@uni.nl' AS user_id, course_id, week, satisfaction, expectation, 'note ' || seq AS feedback,
       date_trunc('second', saved_at) AS saved_at, seq % 5 = 0 AS deleted
FROM refl_log""")


def ordered_interactions_sql() -> str:
    return f"""
SELECT user_id, course_id, week, day, value,
       row_number() OVER (PARTITION BY user_id, course_id ORDER BY week, day) AS position
FROM ({daily_metric_sql('daily_interactions')})"""


def student_interactions_sql(student: int) -> str:
    return f"SELECT * FROM ({daily_metric_sql('daily_interactions')}) WHERE user_id = {student}"


def catalogue_weeks_sql() -> str:
    """The twelve metrics as (data type, metric, label, statement, value)."""
    quiz, done = weekly_scores_sql("quiz"), weekly_scores_sql("assignment")
    day = lambda name: (f"SELECT user_id, course_id, week, SUM(value) AS v FROM ({daily_metric_sql(name)}) "
                        "GROUP BY user_id, course_id, week")
    col = lambda name, q: f"SELECT user_id, course_id, week, {name} AS v FROM ({q})"
    rows = [
        ("Quizzes", "Submissions", "Submissions", day("quiz_submissions")),
        ("Quizzes", "Avg Quiz Score", "Average Quiz Score (%)", col("avg_score", quiz)),
        ("Quizzes", "Max Quiz Score", "Max Quiz Score (%)", col("max_score", quiz)),
        ("Files", "File Accesses", "File Accesses", day("file_accesses")),
        ("Files", "Unique Files Accessed", "Unique Files Accessed", day("unique_files")),
        ("Assignments", "Submissions", "Submissions", day("assignment_submissions")),
        ("Assignments", "Avg Assignment Score", "Average Assignment Score (%)", col("avg_score", done)),
        ("Assignments", "Max Assignment Score", "Max Assignment Score (%)", col("max_score", done)),
        ("Web Activities", "Weekly Time Summary", "Weekly Summary", col("total_interactions", weekly_summary_sql())),
        ("Web Activities", "Daily Web Activity", "Daily Interactions", day("daily_interactions")),
        ("Web Activities", "Active Study Time", "Active Study Time (Minutes)", day("active_study_time")),
        ("Web Activities", "Quiz Time Duration", "Minutes Spent on Quizzes", day("quiz_minutes")),
    ]
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS data_type, '{m}' AS metric, '{l}' AS label, user_id, course_id, week, "
        f"CAST(v AS DOUBLE) AS value FROM ({q})" for t, m, l, q in rows)


def answer_sql(kind: str, span: tuple | None) -> str:
    """The extract's query types over a range of weeks or days, ends included."""
    if kind == "courses":
        return enrollments_sql()
    if kind.endswith("_weeks"):
        q = quiz_weeks_sql() if kind == "quiz_weeks" else assignment_weeks_sql()
        return f"SELECT * FROM ({q}) WHERE week BETWEEN {span[0]} AND {span[1]}"
    series = {"quiz_scores": "quiz_score", "assignment_scores": "assignment_score", "web_activity": "daily_interactions",
              "file_access": "file_accesses", "quiz_duration": "quiz_minutes"}[kind]
    return f"SELECT * FROM ({daily_metric_sql(series)}) WHERE day BETWEEN DATE '{span[0]}' AND DATE '{span[1]}'"


def extract_ages_sql(clock: datetime) -> str:
    return f"""
WITH newest AS (SELECT user_id, MAX(ts) AS cached_at FROM events GROUP BY user_id),
aged AS (
  SELECT c.c_custkey AS user_id, n.cached_at,
         trunc(epoch(TIMESTAMP '{clock}' - n.cached_at)) / 86400.0 AS age_days
  FROM (SELECT DISTINCT c_custkey FROM customer) c LEFT JOIN newest n ON n.user_id = c.c_custkey)
SELECT user_id, cached_at, CAST(age_days AS DOUBLE) AS age_days,
       CASE WHEN cached_at IS NULL THEN 'missing' WHEN age_days < 1 THEN 'today'
            WHEN age_days < 7 THEN CAST(floor(age_days) AS BIGINT) || ' days ago' ELSE '1+ week ago' END AS age,
       cached_at IS NOT NULL AND age_days < 7 AS fresh, CAST(user_id AS VARCHAR) AS file_label
FROM aged"""


def stored_ages_sql() -> str:
    return _with("""
SELECT c_custkey AS user_id, CASE WHEN e.user_id IS NULL THEN 'missing' ELSE '3 days ago' END AS age,
       e.user_id IS NOT NULL AS fresh, CAST(c_custkey AS VARCHAR) AS file_label
FROM customer LEFT JOIN (SELECT DISTINCT user_id FROM enrollments) e ON e.user_id = c_custkey""")


def storage_labels_sql() -> str:
    return """
SELECT c_custkey, regexp_replace(c_name || ' / é@' || c_mktsegment, '[^A-Za-z0-9._-]', '_', 'g') AS file_label,
       length(trim(t, ' ')) = 0 AS blank, trim(t, ' ') AS trimmed
FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN '   ' WHEN 1 THEN '' ELSE '  ' || c_name END AS t FROM customer)"""
