"""String helpers: storage labels, day labels, formatted sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ----------------------------------------------------------
# Characters allowed in a storage label; everything else becomes "_".
UNSAFE_KEY_CHARS = r"[^A-Za-z0-9._-]"
# --- end of fixed values ---------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def storage_key(user_id: Column | str) -> Column:
    """A file-safe label for a user id. Distinct ids can map to one label, so
    it names files only and is never used as a key."""
    return F.regexp_replace(_c(user_id).cast("string"), UNSAFE_KEY_CHARS, "_")


def day_label(day: Column | str) -> Column:
    """``%b %d`` label of a day, e.g. ``Nov 11``."""
    return F.date_format(_c(day), "MMM dd")


def is_blank(text: Column | str) -> Column:
    return F.length(F.trim(_c(text))) == 0
