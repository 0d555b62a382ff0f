"""Top-k per group, and the one-row-per-key operators built on it.

Every operator here is ``row_number`` plus a filter on it. Spark turns that shape into a group limit on
both sides of the shuffle: each map task forwards at most k rows per key, so a key that holds a third of
the input still sends only a few rows to its reducer. Spark does so up to a threshold for k, which
:func:`top_k` raises for the session where k is above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"
_LIMITED = "spark.sql.optimizer.windowGroupLimitThreshold"


def _rank_at_most(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str
) -> DataFrame:
    conf = df.sparkSession.conf
    if 0 <= int(conf.get(_LIMITED)) < k:  # a negative threshold switches the limit off on purpose
        conf.set(_LIMITED, str(k))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int = 1,
    rank: str | None = None,
) -> DataFrame:
    """The first ``k`` rows of each group by ``order``; ``rank`` names a BIGINT rank to keep.

    ``order`` should be total within a group, otherwise ties fall as Spark finds them.
    """
    out = _rank_at_most(df, keys, order, k, rank or _RANK)
    return out.withColumn(rank, F.col(rank).cast("bigint")) if rank else out.drop(_RANK)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the highest by ``order`` (columns, most significant first).

    NULL sorts below every value, so rows without a batch never beat rows with one.
    """
    return top_k(df, keys, [F.col(c).desc_nulls_last() for c in order])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in ``order``. The order stands for the position in the input."""
    return latest_by(df, keys, order)


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order``, so that the survivor is always the same."""
    return top_k(df, keys, [F.col(c).asc_nulls_last() for c in order])


def canonical_dim(
    reference: DataFrame,
    key: str = "id",
    name: str = "snippet_title",
    order: Sequence[str] = ("region",),
) -> DataFrame:
    """One ``(category_id, category_name)`` row per key: the name of the lowest ``order`` row.

    Two columns and the order travel, and a minimum per key combines on the map side.
    """
    first = F.min_by(F.col(name), F.struct(*order, F.coalesce(F.col(name), F.lit(""))))
    return (
        reference.groupBy(F.col(key).alias("category_id"))
        .agg(first.alias("category_name"))
        .filter(F.col("category_id").isNotNull())
    )
