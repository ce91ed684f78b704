"""Times: stored text, epochs and months, all in UTC whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of stored times, and days for which an invitation holds.
STORED = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3}Z?$"
RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"
INVITATION_DAYS = 7


def parse_time(text: Column) -> Column:
    """A stored time as a timestamp: with milliseconds, with or without ``Z``, or RFC 3339; null for anything else."""
    stored = F.concat(F.regexp_replace(text, "Z$", ""), F.lit("Z"))
    return F.when(F.rlike(text, F.lit(STORED)), stored.try_cast("timestamp")).when(F.rlike(text, F.lit(RFC3339)), text.try_cast("timestamp"))


def rfc3339(seconds: Column) -> Column:
    """Epoch seconds as RFC 3339 text in UTC."""
    wall = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def month_start(ts: Column) -> Column:
    """Start of the UTC month; times without a zone are UTC."""
    return F.date_trunc("MONTH", ts)


def invitation_expiry(created_ms: Column) -> Column:
    return created_ms + F.lit(INVITATION_DAYS * 86_400_000)
