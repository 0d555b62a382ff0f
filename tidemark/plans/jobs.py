"""The whole run: newest batch to Silver, catalog, Gold."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import SparkSession

from tidemark.layout import Layout
from tidemark.operators.keys import Batch
from tidemark.plans.gold import silver_to_gold
from tidemark.plans.silver import bronze_json_to_silver
from tidemark.schemas import SILVER_STATS_PARTITIONS
from tidemark.session import glob_paths
from tidemark.sinks.catalog import create_all_stats_view, register_tables
from tidemark.sinks.partitions import add_partitions
from tidemark.sources.discovery import discover_latest_batch
from tidemark.sources.tables import read_reference_table


def _regions_of(spark: SparkSession, stats: str, batch: Batch) -> list[tuple]:
    """The partitions of a batch, from its folders."""
    day, hour = batch.date.isoformat(), str(batch.hour)
    folders = glob_paths(spark, f"{stats}/region=*/ingestion_date={day}/ingestion_hour={hour}")
    return [(unquote(f.split("/region=")[1].split("/")[0]), day, hour) for f in folders]


def run_latest(
    spark: SparkSession,
    layout: Layout,
    *,
    prefix: str = "",
    source: str = "stats",
    batch: Batch | None = None,
    include_previous: bool = False,
) -> dict:
    """Load the newest landed batch (or ``batch``), refresh the catalog and the Gold tables.

    ``source="all_stats"`` computes Gold over history and current facts together. Every step
    replaces whole partitions, so a repeated run gives the same tables. The catalog learns the partitions
    that the run writes; repair tables after writing around it. Documents and items that could not be
    read are counted in ``metrics`` and kept in the quarantine folder. Over current facts Gold keeps state
    from run to run (see :class:`tidemark.plans.state.GoldState`).
    """
    batch = batch or discover_latest_batch(spark, layout.raw_stats)
    metrics = bronze_json_to_silver(spark, layout.raw_stats, layout.stats, batch, layout.quarantine)
    names = register_tables(spark, layout, prefix, repair=False)
    add_partitions(spark, names["stats"], SILVER_STATS_PARTITIONS, _regions_of(spark, layout.stats, batch))
    view = f"{prefix}all_video_statistics"
    create_all_stats_view(spark, view, names["history"], names["stats"])
    stats = spark.table(view if source == "all_stats" else names["stats"])
    counts = silver_to_gold(
        stats,
        read_reference_table(spark, layout.reference),
        batch,
        names,
        include_previous=include_previous,
        state=layout.gold_state if source == "stats" else None,
    )
    return {"batch": batch, "metrics": metrics, "tables": {**names, "all_stats": view}, "gold": counts}
