"""Flat CSV snapshots: every column read as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.paths import scanned_file
from tidemark.schemas import BRONZE_CSV

# Fixed dialect of the files.
CSV_DIALECT = {"header": "true", "sep": ",", "quote": '"', "escape": "\\"}


def read_flat_csv(
    spark: SparkSession, root: str, *, multi_line: bool = True, pattern: str = "*.csv"
) -> DataFrame:
    """One row per record with its path in ``_source_file``.

    Quoted text may hold line breaks, so records are parsed as multi-line by default; Spark then
    reads each file in one task. Pass ``multi_line=False`` for files known to hold none: they are
    split at line ends and read by many tasks.
    """
    return (
        spark.read.schema(BRONZE_CSV)
        .options(**CSV_DIALECT)
        .option("multiLine", multi_line)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .csv(root)
        .select("*", scanned_file().alias("_source_file"))
    )
