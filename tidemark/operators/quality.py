"""Assertions, key filters and row counts of the cleaning steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import is_blank


def require_nonblank(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which every named text column is present and not blank."""
    for column in columns:
        df = df.filter(~is_blank(F.col(column)))
    return df


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}; available: {df.columns}")
    return df


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def require_unique_columns(df: DataFrame) -> DataFrame:
    repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if repeated:
        raise ValueError(f"duplicate columns: {repeated}")
    return df


def quality_counts(df: DataFrame, nonblank: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows in, rows dropped by each key filter, and rows left after de-duplication, in one pass.

    Filters apply in the given order, so a row is counted at the first one it fails. Rows meet per
    key first and the totals are sums over keys: both steps combine on the map side.
    """
    failed = F.lit(None).cast("string")
    for column in reversed(list(nonblank)):
        failed = F.when(is_blank(F.col(column)), F.lit(column)).otherwise(failed)
    tagged = df.withColumn("__failed", failed)
    per_key = tagged.groupBy("__failed", *keys).agg(F.count(F.lit(1)).alias("n"))

    def total(value: Column, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("bigint")

    valid = F.col("__failed").isNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("input_rows"),
        *[total(F.col("n"), F.col("__failed") == c).alias(f"blank_{c}") for c in nonblank],
        total(F.col("n") - 1, valid).alias("duplicate_rows"),
        total(F.lit(1), valid).alias("output_rows"),
    )


def describe_stage(df: DataFrame) -> DataFrame:
    """One row per column: its position, name and type as text, the rows of the frame, and how many of them
    have a value there. One pass; top-level columns only, a nested one is described by its type."""
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    filled = [F.count(f"c{i}").alias(f"c{i}") for i in range(len(df.columns))]
    counts = numbered.agg(F.count(F.lit(1)).alias("rows"), *filled)
    columns = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f"c{i}").alias("filled"),
        )
        for i, f in enumerate(df.schema)
    ]
    return counts.select("rows", F.explode(F.array(*columns)).alias("x")).select("x.*", "rows")


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    """A few rows for the eye. Spark stops reading once it has them."""
    return df.limit(rows)
