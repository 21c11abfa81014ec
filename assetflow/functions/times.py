"""Times as Column expressions; all at whole seconds unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TOLERANCE_SECONDS

#: Seconds from 1900-01-01 to 1970-01-01.
SQL_EPOCH = 2_208_988_800


def format_millis(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("????-??-?? ??:??:??.???"))


def to_unix_time(c: Column) -> Column:
    return F.unix_seconds(c.cast("timestamp"))


def from_unix_time(c: Column) -> Column:
    return F.timestamp_seconds(c)


def to_sql_time(c: Column) -> Column:
    return to_unix_time(c) + SQL_EPOCH


def from_sql_time(c: Column) -> Column:
    return F.timestamp_seconds(c - SQL_EPOCH)


def was_modified(time: Column, reference: Column) -> Column:
    """At or past the reference plus the tolerance; false if either is unknown."""
    return F.coalesce(time >= reference + F.expr(f"INTERVAL {TOLERANCE_SECONDS} SECOND"), F.lit(False))
