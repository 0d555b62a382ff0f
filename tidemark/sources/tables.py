"""Parquet tables of the Silver layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.schemas import SILVER_STATS
from tidemark.session import current_folder, path_exists


def read_stats(spark: SparkSession, path: str, schema: T.StructType = SILVER_STATS) -> DataFrame:
    """The partitioned fact table. The explicit schema keeps partition values at their types."""
    return spark.read.schema(schema).parquet(path)


def read_reference_table(spark: SparkSession, path: str) -> DataFrame:
    """The dimension, with the columns of all its files (they evolve)."""
    return spark.read.option("mergeSchema", True).parquet(current_folder(spark, path))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored dimension, or an empty frame when its path does not exist yet.

    Only a missing path means empty; every other failure is raised.
    """
    if path_exists(spark, current_folder(spark, path)):
        return read_reference_table(spark, path)
    return spark.createDataFrame([], schema)
