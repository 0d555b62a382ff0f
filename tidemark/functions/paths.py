"""Values carried by object paths such as ``.../region=us/date=2024-01-30/hour=18/x.json``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def region_from_path(path: Column, default: str | None = None) -> Column:
    """The ``region=`` segment; ``default`` (or empty text) when the path has none."""
    found = F.regexp_extract(path, r"region=([^/]+)", 1)
    if default is None:
        return found
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def batch_date_from_path(path: Column) -> Column:
    return F.regexp_extract(path, r"/date=(\d{4}-\d{2}-\d{2})/", 1).try_cast("date")


def batch_hour_from_path(path: Column) -> Column:
    return F.regexp_extract(path, r"/hour=(\d{2})/", 1).try_cast("int")


def decode_key(key: Column) -> Column:
    """Undo URL encoding of an object key: ``%XX`` escapes, and ``+`` for a space."""
    return F.try_url_decode(key)


def scanned_file() -> Column:
    """Path of the file a scanned row came from, without the percent escapes Spark reports it in.

    ``+`` stands for itself there.
    """
    path = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(path)
