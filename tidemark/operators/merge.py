"""Unions of frames with differing columns, and the keyed upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import keep_last
from tidemark.operators.reshape import as_text, conform
from tidemark.schemas import ALL_STATS

_NEWER = "__newer"


def concat_evolving(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both. A column absent on one side is NULL there; where the two types of a
    column differ it is widened to text."""
    kinds = {f.name: f.dataType for f in second.schema}
    differing = {f.name for f in first.schema if f.name in kinds and kinds[f.name] != f.dataType}

    def widen(df: DataFrame) -> DataFrame:
        if not differing:
            return df
        return df.select(
            *[
                as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
                if f.name in differing
                else F.col(f"`{f.name}`")
                for f in df.schema
            ]
        )

    return widen(first).unionByName(widen(second), allowMissingColumns=True)


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = (),
    rival: Column | None = None,
) -> DataFrame:
    """Keyed upsert: an incoming row replaces the existing row of its key entirely, new keys are
    added, other existing rows stay.

    ``order`` names columns that order rows of one key within one side, most significant first. Existing
    rows for which ``rival`` holds are ordered as if they were incoming. One shuffle serves both the
    de-duplication of each side and the merge.
    """
    both = concat_evolving(
        existing.withColumn(_NEWER, F.lit(0) if rival is None else F.when(rival, 1).otherwise(0)),
        incoming.withColumn(_NEWER, F.lit(1)),
    )
    return keep_last(both, keys, [_NEWER, *order]).drop(_NEWER)


def union_history(history: DataFrame, current: DataFrame) -> DataFrame:
    """History without batch columns, then current facts, under one column contract."""
    return conform(history, ALL_STATS).unionAll(conform(current, ALL_STATS))
