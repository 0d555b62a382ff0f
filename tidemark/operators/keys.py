"""Batches, affected keys, and joins against key sets and dimensions.

No operator here forces a broadcast. The planner broadcasts a side when its measured size is
below ``spark.sql.autoBroadcastJoinThreshold`` (file sizes at planning time, shuffle sizes at run
time) and otherwise falls back to a shuffled join with skew handling.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import BATCH


class Batch(NamedTuple):
    date: dt.date
    hour: int


def as_batch(date: str | dt.date, hour: str | int) -> Batch:
    day = dt.date.fromisoformat(date) if isinstance(date, str) else date
    return Batch(day, int(hour))


def latest_batch_df(df: DataFrame, date: str = BATCH[0], hour: str = BATCH[1]) -> DataFrame:
    """The newest ``(date, hour)`` as one row; the row holds NULLs when ``df`` has no batch."""
    newest = F.max(F.when(F.col(date).isNotNull() & F.col(hour).isNotNull(), F.struct(date, hour)))
    return df.agg(newest.alias("b")).select("b.*")


def latest_batch(df: DataFrame, date: str = BATCH[0], hour: str = BATCH[1]) -> Batch:
    """The newest batch on the driver (one row travels); fails when there is none."""
    row = latest_batch_df(df, date, hour).first()
    if row is None or row[date] is None:
        raise ValueError("no valid batch found")
    return Batch(row[date], row[hour])


def batch_slice(df: DataFrame, batch: Batch) -> DataFrame:
    """Rows of one batch. Typed literals on partition columns, so the scan is pruned."""
    return df.filter(
        (F.col(BATCH[0]) == F.lit(batch.date)) & (F.col(BATCH[1]) == F.lit(batch.hour))
    )


def affected_keys(
    batch: DataFrame,
    keys: Sequence[str],
    history: DataFrame | None = None,
    entity: Sequence[str] = ("video_id", "region"),
) -> DataFrame:
    """Distinct non-NULL keys of a batch.

    With ``history``, keys which the batch's entities carried earlier are added: an entity that
    moved to another category changes its old category too.
    """
    keys = list(keys)
    out = batch.select(*keys)
    if history is not None:
        wanted = list(dict.fromkeys([*entity, *keys]))
        # Distinct first: it combines on the map side, so a hot entity reaches the join once
        # per category instead of once per snapshot.
        earlier = history.select(*wanted).distinct()
        entities = batch.select(*entity).distinct()
        out = out.unionByName(earlier.join(entities, list(entity), "left_semi").select(*keys))
    return out.dropna(subset=keys).distinct()


def restrict_to(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys`` (a semi-join, never multiplies rows).

    A key that holds much of ``df`` is split by Spark's skew handling.
    """
    return df.join(keys.select(*on), list(on), "left_semi")


def restrict_history(
    stats: DataFrame,
    affected: DataFrame,
    on: Sequence[str] = ("category_id",),
    entity: Sequence[str] = ("video_id", "region"),
) -> DataFrame:
    """Full history of every entity that was ever in an affected key.

    This is the safe cut below :func:`latest_by`. Filtering by category instead would drop newer
    rows of entities that moved, and an older row would pass for the latest.
    """
    entities = restrict_to(stats.select(*entity, *on).distinct(), affected, on)
    return restrict_to(stats, entities.select(*entity).distinct(), entity)


def lookup_dim(facts: DataFrame, dim: DataFrame, key: str = "category_id") -> DataFrame:
    """Inner join of facts to a key-unique dimension; facts without a dimension row drop out.

    The fact key becomes text, so a dimension key that is not a number cannot fail the join.
    Where facts are aggregated by the same key, aggregate first and look up the result.
    """
    return facts.withColumn(key, F.col(key).cast("string")).join(dim, key, "inner")


def keys_missing_from(facts: DataFrame, dim: DataFrame, key: str = "category_id") -> DataFrame:
    """Fact rows per key which has no dimension row (they never reach an inner-joined report)."""
    counts = (
        facts.dropna(subset=[key])
        .groupBy(F.col(key).cast("string").alias(key))
        .agg(F.count(F.lit(1)).alias("fact_rows"))
    )
    return counts.join(dim.select(key), key, "left_anti")
