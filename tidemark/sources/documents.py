"""JSON documents, one per file, judged one by one: a damaged file never changes how another is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.paths import scanned_file
from tidemark.schemas import CORRUPT
from tidemark.sources.discovery import scan_files


def read_texts(
    spark: SparkSession, paths: str | Sequence[str], path: str, *, pattern: str = "*.json"
) -> DataFrame:
    """(``path``, ``text``): one row per file, whole. Spark lists no files of zero length."""
    files = scan_files(spark, paths, pattern)
    return files.select(scanned_file().alias(path), F.col("content").cast("string").alias("text"))


def is_object(text: Column) -> Column:
    return F.coalesce(F.startswith(F.ltrim(text), F.lit("{")), F.lit(False))


def with_elements(df: DataFrame, fields: T.StructType, listed: str = "items") -> DataFrame:
    """Adds ``document`` (the fields, ``listed`` as text, and the corrupt-record text) and ``elements``
    (JSON texts of the list; NULL where there is none)."""
    schema = T.StructType([*(f for f in fields if f.name != listed), T.StructField(listed, T.StringType())])
    parsed = F.from_json("text", schema.add(CORRUPT, "string"), {"columnNameOfCorruptRecord": CORRUPT})
    return df.withColumn("document", parsed).withColumn(
        "elements", F.from_json(F.col("document")[listed], T.ArrayType(T.StringType()))
    )


def unreadable() -> Column:
    """Whether the row of :func:`with_elements` is no JSON object."""
    return ~is_object(F.col("text")) | F.col("document")[CORRUPT].isNotNull()
