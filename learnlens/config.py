"""Term settings and the fixed values every metric depends on."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date, datetime, timedelta

# --- Fixed values (must equal the reference's for right results) -----------
# Course start of the reference term and the end of its extract window.
REFERENCE_TERM_START = date(2024, 11, 11)
REFERENCE_TERM_END = date(2025, 2, 1)
# Weeks a student can select in the reference (1..10).
REFERENCE_MAX_WEEK = 10
# Estimated active minutes per logged interaction.
MINUTES_PER_INTERACTION = 2
# Quiz submission states that count as "submitted".
QUIZ_ACCEPTED_STATES = ("pending_review", "complete")
# Assignment submission states that count as "submitted".
ASSIGNMENT_ACCEPTED_STATES = ("pending_review", "graded", "submitted")
# Known course ids and their labels, in the reference's order.
COURSE_LABELS = (
    ("27886", "0HV30-2024"),
    ("28301", "0HV60-2024"),
    ("27893", "0HV90-2024"),
    ("27974", "0HV100-2024"),
)
UNKNOWN_COURSE = "Unknown Course"
DASHBOARD_TITLE_SUFFIX = "- Self-Regulated Learning Reflection Dashboard"
# --- end of fixed values -----------------------------------------------------


@dataclass(frozen=True)
class Term:
    """A teaching term: weeks are 7-day blocks counted from ``start`` (week 1).

    ``end`` is exclusive and bounds every fact table (the extract window).
    Calendar grids and marts cover every week of it. ``max_week`` is the last
    week a student can pick: it bounds the week selector of the catalogue, the
    weeks that reflections are filed under, and with them streaks, two-week
    blocks and badges.
    """

    start: date = REFERENCE_TERM_START
    end: date = REFERENCE_TERM_END
    max_week: int = REFERENCE_MAX_WEEK
    minutes_per_interaction: int = MINUTES_PER_INTERACTION

    @property
    def raw_weeks(self) -> int:
        """Weeks touched by the extract window (12 for the reference term)."""
        return math.ceil((self.end - self.start).days / 7)

    @property
    def weeks(self) -> int:
        """Weeks of the calendar grids: 1..weeks, the whole extract window."""
        return self.raw_weeks

    @property
    def display_weeks(self) -> int:
        """Weeks that can be picked: 1..display_weeks."""
        return min(self.raw_weeks, self.max_week)

    @property
    def block_starts(self) -> list[int]:
        """Two-week blocks (1,2), (3,4), ... that cover the weeks to pick."""
        return list(range(1, self.display_weeks + 1, 2))

    @property
    def block_weeks(self) -> int:
        """Last week that belongs to a block (a block always has two weeks)."""
        return self.block_starts[-1] + 1

    @property
    def last_day(self) -> date:
        return self.start + timedelta(days=7 * self.weeks - 1)

    @property
    def start_ts(self) -> datetime:
        return datetime(self.start.year, self.start.month, self.start.day)

    @property
    def end_ts(self) -> datetime:
        return datetime(self.end.year, self.end.month, self.end.day)

    def week_start(self, week: int) -> date:
        return self.start + timedelta(days=7 * (week - 1))

    def week_end(self, week: int) -> date:
        return self.week_start(week) + timedelta(days=6)

    def week_of(self, day: date) -> int:
        """Display week of a calendar date, clamped to 1..max_week."""
        num = (day - self.start).days // 7 + 1
        return min(max(1, num), self.max_week)


REFERENCE_TERM = Term()
# Term of the driver's synthetic tables: events span 2024-01-01 .. 2024-01-30.
DRIVER_TERM = Term(start=date(2024, 1, 1), end=date(2024, 2, 1))
# The same term where only three of its five weeks can be picked.
SHORT_PICK_TERM = Term(start=date(2024, 1, 1), end=date(2024, 2, 1), max_week=3)
# A term of 200 weeks, all of which can be picked.
LONG_TERM = Term(start=date(2024, 1, 1), end=date(2024, 1, 1) + timedelta(weeks=200), max_week=200)
