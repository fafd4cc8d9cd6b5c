"""learnlens: learning-activity analytics on Spark.

Per-student, per-course, per-day and per-week activity metrics computed for
all students at once as DataFrame plans; the one-student view is a filter.
"""

from .config import DRIVER_TERM, REFERENCE_TERM, Term
from .sources.tables import Sources

__all__ = ["Term", "REFERENCE_TERM", "DRIVER_TERM", "Sources"]
