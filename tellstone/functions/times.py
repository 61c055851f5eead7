"""Times kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_time(text: Column) -> Column:
    """A time written with a blank or a T, with or without an offset; without one it is UTC.

    Null, empty and unreadable text gives null, whatever the session's time zone.
    """
    t = F.trim(text)
    return F.when(t.rlike(r"[T ]\d.*(Z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("+00:00"))).try_cast("timestamp")
