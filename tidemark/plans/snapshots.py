"""The newest snapshot of each video and region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidemark.operators.ranking import latest_by
from tidemark.schemas import BATCH

ENTITY = ["video_id", "region"]
# What the reports need of a snapshot, besides its key.
MEASURES = ["title", "category_id", "views", "likes", "comment_count"]


def _order(stats: DataFrame) -> list[str]:
    return [c for c in (*BATCH, "trending_date", "_source_file") if c in stats.columns]


def latest_rows(stats: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """The newest snapshot per video and region: the columns the reports need, and those that order it.

    Two snapshots of one hour are ordered by source file, whose path holds the run time. Rows
    equal in all of that are ordered by their values, so the result never depends on row order.
    """
    order, values = _order(stats), [c for c in MEASURES if c in stats.columns]
    return latest_by(stats.select(*entity, *values, *order), entity, [*order, *values])


def latest_snapshots(stats: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """:func:`latest_rows` without the columns that order them."""
    return latest_rows(stats, entity).drop(*_order(stats))
