"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(value: Column) -> Column:
    """Remove any white space at both ends (``F.trim`` removes only spaces)."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def is_blank(value: Column) -> Column:
    """True for NULL, empty or space-only text; never NULL itself."""
    return F.coalesce(F.trim(value), F.lit("")) == ""


def utc_iso(value: Column) -> Column:
    """ISO text of an instant in UTC, whatever the session zone."""
    utc = F.to_utc_timestamp(value, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
