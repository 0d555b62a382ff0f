"""Outcome reports of ingestion runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import region_from_path
from tidemark.functions.text import is_blank
from tidemark.schemas import CORRUPT
from tidemark.sources.envelopes import REJECTED


def envelope_report(envelopes: DataFrame) -> DataFrame:
    """One row per file: key, region, items found, rows kept, and the error or NULL.

    Expects :func:`tidemark.sources.read_envelopes` with ``keep_corrupt``. Everything is computed
    inside the row of the file, so there is no shuffle.
    """
    path = F.col("_source_file")
    ids = F.transform("items", lambda item: F.trim(item["id"]))
    kept = F.size(F.array_distinct(F.filter(ids, lambda value: ~is_blank(value))))
    found = F.size("items") + F.size(REJECTED)
    empty = F.coalesce(found, F.lit(0)) <= 0
    error = (
        F.when(F.col(CORRUPT).isNotNull(), F.lit("unreadable document"))
        .when(empty, F.lit("no items"))
        .when(F.size("items") == 0, F.lit("no readable items"))
    )
    stored = error.isNull() & ~is_blank(region_from_path(path))
    return envelopes.select(
        path.alias("key"),
        region_from_path(path, "unknown").alias("region"),
        F.when(F.col(CORRUPT).isNull() & ~empty, found).otherwise(0).cast("bigint").alias("incoming_rows"),
        F.when(stored, kept).otherwise(0).cast("bigint").alias("final_rows"),
        error.alias("error"),
    )


def run_summary(report: DataFrame) -> DataFrame:
    """Regions by outcome: files, rows and the kind of failure."""
    status = F.when(F.col("error").isNull(), F.lit("success")).otherwise(F.lit("failed"))
    return report.groupBy("region", status.alias("status"), "error").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("incoming_rows").alias("incoming_rows"),
    )


def report_json(report: DataFrame) -> DataFrame:
    """The report as JSON text, one document per row, ready to be written or sent."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("document"))
