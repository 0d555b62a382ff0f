"""Partitioned Parquet writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.keys import restrict_to
from tidemark.session import delete_folder, move_folder, path_exists, small_files

PARTITIONS_PER_STATEMENT = 500


Dealt = Callable[[DataFrame], DataFrame]


def _write(df: DataFrame, path: str, by: Sequence[str], mode: str, dealt: Dealt = lambda df: df) -> None:
    # Rebalancing gathers the rows of a partition into few files. Unlike a plain repartition it
    # splits a partition value that holds much of the data over several tasks.
    (
        dealt(df.hint("rebalance", *[F.col(c) for c in by]))
        .write.mode("overwrite")
        .options(**small_files(df.sparkSession))
        .option("partitionOverwriteMode", mode)
        .partitionBy(*by)
        .parquet(path)
    )


def write_partitions(df: DataFrame, path: str, by: Sequence[str], dealt: Dealt = lambda df: df) -> None:
    """Replace exactly the partitions that ``df`` has rows for; others stay untouched.

    Writing the same rows again gives the same table, so a failed or repeated run is harmless. ``dealt`` is
    applied to the rows after they have been dealt to the tasks that write them.
    """
    _write(df, path, by, "dynamic", dealt)


def replace_dataset(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the whole dataset, partitions without new rows included."""
    _write(df, path, by, "static")


def swap_dataset(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the whole dataset by a version that is complete before it takes the path.

    The new version is written beside the path, and the old one stays beside it until the next swap, so a
    query that has begun keeps its files. Between the two moves :func:`tidemark.session.current_folder`
    names the old version; a run that ends there is finished by the next swap.
    """
    spark, new, old = df.sparkSession, f"{path}.new", f"{path}.old"
    finish_swap(spark, path)
    _write(df, new, by, "static")
    delete_folder(spark, old)
    if path_exists(spark, path):
        move_folder(spark, path, old)
    move_folder(spark, new, path)


def finish_swap(spark: SparkSession, path: str) -> None:
    """Completes a swap that ended between its two moves; the new version was whole by then."""
    if not path_exists(spark, path) and path_exists(spark, f"{path}.old"):
        move_folder(spark, f"{path}.new", path)


def add_partitions(spark: SparkSession, table: str, by: Sequence[str], values: Sequence[Sequence]) -> None:
    """Make partitions known to the catalog, so many to a statement; known ones are left alone."""
    for first in range(0, len(values), PARTITIONS_PER_STATEMENT):
        specs = " ".join(f"PARTITION ({_spec(by, v)})" for v in values[first : first + PARTITIONS_PER_STATEMENT])
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {specs}")


def drop_partitions(spark: SparkSession, table: str, by: Sequence[str], values: Sequence[Sequence]) -> None:
    for first in range(0, len(values), PARTITIONS_PER_STATEMENT):
        specs = ", ".join(f"PARTITION ({_spec(by, v)})" for v in values[first : first + PARTITIONS_PER_STATEMENT])
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")


def replace_affected(df: DataFrame, affected: DataFrame, table: str, by: Sequence[str]) -> None:
    """Replace the affected partitions of a catalog table by ``df``.

    Partitions with output are swapped by a dynamic overwrite and added to the catalog. Affected
    partitions without output leave the catalog after it and lose their files then, so readers never meet
    a gap and a failure loses nothing. ``df`` is read twice: pass a small or staged frame. Only values of
    written and of emptied partitions reach the driver; other partitions cost nothing.
    """
    spark = df.sparkSession
    by = list(by)
    columns = spark.table(table).columns
    location = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Location'").first().data_type
    write_partitions(df.select(*columns), location, by)
    written = [tuple(r) for r in df.select(*[F.col(c).cast("string") for c in by]).distinct().toLocalIterator()]
    add_partitions(spark, table, by, written)
    spark.catalog.refreshTable(table)

    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")
    stored = spark.table(table).select(*by, folder)
    emptied = restrict_to(stored, affected, by).join(df.select(*by).distinct(), by, "left_anti").distinct()
    gone = emptied.collect()
    drop_partitions(spark, table, by, sorted({tuple(str(r[c]) for c in by) for r in gone}))
    for path in {r.folder for r in gone}:
        delete_folder(spark, unquote(path))  # file paths come as URIs
    spark.catalog.refreshTable(table)


def _spec(by: Sequence[str], values: Sequence) -> str:
    return ", ".join(f"{c} = {_literal(v)}" for c, v in zip(by, values, strict=True))


def _literal(value: object) -> str:
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"
