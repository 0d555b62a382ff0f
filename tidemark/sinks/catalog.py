"""External tables, partition discovery and the view over history and current facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.operators.keys import Batch, batch_slice
from tidemark.operators.merge import union_history
from tidemark.layout import Layout
from tidemark.schemas import (
    ALL_STATS,
    BRONZE_CSV,
    GOLD,
    SILVER_HISTORY,
    SILVER_HISTORY_PARTITIONS,
    SILVER_STATS,
    SILVER_STATS_PARTITIONS,
)
from tidemark.session import path_exists
from tidemark.sources.flat_csv import CSV_DIALECT


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def create_table(
    spark: SparkSession, name: str, schema: T.StructType, location: str, by: Sequence[str] = ()
) -> None:
    """Register an external Parquet table; an existing one is left alone."""
    partitioned = f"PARTITIONED BY ({', '.join(by)})" if by else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({_ddl(schema)}) USING parquet "
        f"{partitioned} LOCATION '{location}'"
    )


def create_csv_table(
    spark: SparkSession, name: str, location: str, schema: T.StructType = BRONZE_CSV, multi_line: bool = True
) -> None:
    """Register an external delimited-text table with a skipped header.

    Without line breaks inside quotes pass ``multi_line=False``: large files are then split over tasks.
    """
    options = {**CSV_DIALECT, "multiLine": str(multi_line).lower(), "recursiveFileLookup": "true"}
    listed = ", ".join(
        "'{}' = '{}'".format(k, v.replace("\\", "\\\\")) for k, v in options.items()
    )
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({_ddl(schema)}) USING csv "
        f"OPTIONS ({listed}) LOCATION '{location}'"
    )


def repair_table(spark: SparkSession, name: str) -> None:
    """Make partitions found at the location visible, and forget those that are gone."""
    spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")


def create_all_stats_view(
    spark: SparkSession, name: str, history: str, current: str, temporary: bool = False
) -> None:
    """A view over history and current facts; history has NULL batch columns."""
    if temporary:
        union_history(spark.table(history), spark.table(current)).createOrReplaceTempView(name)
        return

    def side(table: str) -> str:
        present = set(spark.table(table).columns)
        return ", ".join(
            f"{f.name if f.name in present else f'CAST(NULL AS {f.dataType.simpleString()})'} AS {f.name}"
            for f in ALL_STATS
        )

    spark.sql(
        f"CREATE OR REPLACE VIEW {name} AS SELECT {side(history)} FROM {history} "
        f"UNION ALL SELECT {side(current)} FROM {current}"
    )


def register_views(stats: DataFrame, reference: DataFrame, batch: Batch) -> None:
    """Temporary views for SQL: the facts, the dimension, and the rows of one batch."""
    stats.createOrReplaceTempView("video_statistics")
    reference.createOrReplaceTempView("clean_reference_data")
    batch_slice(stats, batch).createOrReplaceTempView("new_batch")


def register_evolving(spark: SparkSession, name: str, location: str) -> None:
    """Register a dataset whose columns evolve, under the columns its files have now.

    A table that exists only gains its new columns, so readers never miss it; it is defined anew when a
    column has another type or is gone.
    """
    now = spark.read.option("mergeSchema", True).parquet(location)
    if spark.catalog.tableExists(name):
        known = {f.name: f.dataType for f in spark.table(name).schema}
        found = {f.name: f.dataType for f in now.schema}
        if all(found.get(c) == kind for c, kind in known.items()):
            new = T.StructType([f for f in now.schema if f.name not in known])
            if new:
                spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({_ddl(new)})")
            repair_table(spark, name)
            return
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet OPTIONS (mergeSchema 'true') LOCATION '{location}'")
    repair_table(spark, name)


# Table name per stored dataset.
TABLE_NAMES = {
    "stats": "video_statistics_v2",
    "history": "video_statistics",
    "reference": "silver_reference_data",
    **{name: f"gold_{name}" for name in GOLD},
}


def register_tables(
    spark: SparkSession, layout: Layout, prefix: str = "", repair: bool = True
) -> dict[str, str]:
    """Create and repair the table of every dataset below a layout.

    Without ``repair`` only new tables look for their partitions; jobs add those they write themselves.
    Returns the table name per dataset, each with ``prefix``. The dimension is registered once it
    exists, since its columns come from its files.
    """
    tables = {
        "stats": (SILVER_STATS, SILVER_STATS_PARTITIONS, layout.stats),
        "history": (SILVER_HISTORY, SILVER_HISTORY_PARTITIONS, layout.history),
        **{name: (*GOLD[name], layout.gold(name)) for name in GOLD},
    }
    names = {key: prefix + name for key, name in TABLE_NAMES.items()}
    for key, (schema, by, location) in tables.items():
        known = spark.catalog.tableExists(names[key])
        create_table(spark, names[key], schema, location, by)
        if path_exists(spark, location) and (repair or not known):
            repair_table(spark, names[key])
    if path_exists(spark, layout.reference):
        register_evolving(spark, names["reference"], layout.reference)
    return names
