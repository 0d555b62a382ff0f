"""Silver to Gold: four reports, recomputed only for the keys a batch touches.

All four aggregate or rank facts by category first and meet the dimension afterwards. A category
that holds a third of the facts therefore is combined on the map side and reaches every join as
one row (or k rows), and no join sees the fact table.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ratio import safe_pct
from tidemark.operators.keys import (
    Batch,
    affected_keys,
    batch_slice,
    keys_missing_from,
    lookup_dim,
    restrict_to,
)
from tidemark.operators.ranking import canonical_dim, top_k
from tidemark.operators.reshape import conform
from tidemark.plans.snapshots import latest_snapshots
from tidemark.plans.state import GoldState
from tidemark.schemas import (
    GOLD,
    GOLD_CATEGORY_ENGAGEMENT,
    GOLD_CATEGORY_PERFORMANCE,
    GOLD_CATEGORY_REGION,
    GOLD_VIDEO_RANKINGS,
)
from tidemark.session import drop_scratch, scratch, stage
from tidemark.sinks.partitions import replace_affected


def _sum(column: str, name: str) -> Column:
    return F.sum(column).alias(name)


def _touched(rows: DataFrame, affected: DataFrame | None, on: Sequence[str]) -> DataFrame:
    return rows if affected is None else restrict_to(rows, affected, on)


def category_engagement(
    facts: DataFrame, dim: DataFrame, affected: DataFrame | None = None
) -> DataFrame:
    """Sums and engagement rate per category over every snapshot in ``facts``.

    Pass the latest snapshots instead of all facts to count each video once.
    """
    totals = (
        facts.dropna(subset=["category_id"])
        .groupBy("category_id")
        .agg(
            _sum("views", "total_views"),
            _sum("likes", "total_likes"),
            _sum("comment_count", "total_comments"),
        )
    )
    rate = safe_pct(F.col("total_likes") + F.col("total_comments"), F.col("total_views"))
    rows = _touched(totals, affected, ["category_id"]).withColumn("engagement_rate", rate)
    return conform(lookup_dim(rows, dim), GOLD_CATEGORY_ENGAGEMENT)


def category_performance(
    latest: DataFrame, dim: DataFrame, affected: DataFrame | None = None
) -> DataFrame:
    """Count, totals and averages per category over the latest snapshots."""
    totals = (
        latest.dropna(subset=["category_id"])
        .groupBy("category_id")
        .agg(
            F.count("video_id").alias("video_count"),
            _sum("views", "total_views"),
            F.avg("views").alias("avg_views"),
            _sum("likes", "total_likes"),
            F.avg("likes").alias("avg_likes"),
            _sum("comment_count", "total_comments"),
            F.avg("comment_count").alias("avg_comments"),
        )
    )
    rows = _touched(totals, affected, ["category_id"])
    return conform(lookup_dim(rows, dim), GOLD_CATEGORY_PERFORMANCE)


def category_region(
    latest: DataFrame, dim: DataFrame, affected: DataFrame | None = None
) -> DataFrame:
    """Count, totals and average views per region and category over the latest snapshots."""
    totals = (
        latest.dropna(subset=["region", "category_id"])
        .groupBy("region", "category_id")
        .agg(
            F.count("video_id").alias("video_count"),
            _sum("views", "total_views"),
            F.avg("views").alias("avg_views"),
            _sum("likes", "total_likes"),
            _sum("comment_count", "total_comments"),
        )
    )
    rows = _touched(totals, affected, ["region", "category_id"])
    return conform(lookup_dim(rows, dim), GOLD_CATEGORY_REGION)


def video_rankings(
    latest: DataFrame, dim: DataFrame, affected: DataFrame | None = None, k: int = 3
) -> DataFrame:
    """The ``k`` most viewed videos per category over all regions; ties by video and region.

    A category either has a dimension row or not, so ranking before the lookup ranks the same.
    """
    order = [F.col("views").desc_nulls_last(), F.col("video_id").asc(), F.col("region").asc()]
    narrow = latest.select("video_id", "title", "region", "category_id", "views")
    ranked = top_k(narrow.dropna(subset=["category_id"]), ["category_id"], order, k, "video_rank")
    rows = _touched(ranked, affected, ["category_id"])
    return conform(lookup_dim(rows, dim), GOLD_VIDEO_RANKINGS)


def silver_to_gold(
    stats: DataFrame,
    reference: DataFrame,
    batch: Batch,
    tables: dict[str, str],
    *,
    k: int = 3,
    include_previous: bool = False,
    state: str | None = None,
) -> dict[str, int]:
    """Recompute what ``batch`` touches in the four Gold tables; returns the counts of the run: new rows,
    affected categories and pairs of region and category (0 when it touches nothing and stops), and the
    batch's facts whose category has no dimension row and so reaches no report.

    ``tables`` maps each report to a catalog table (see ``register_tables``).
    ``include_previous`` also refreshes categories that the batch's videos have left.

    With ``state``, a folder of this job's own (see :class:`tidemark.plans.state.GoldState`), a run reads its
    batch and what is stored there; one that ended early is made good by the next. Without it history is scanned twice: once for the sums over all snapshots and once for
    the latest snapshots, which three reports share through a written copy.
    """
    spark: SparkSession = stats.sparkSession
    work = scratch(spark)
    history = stats if include_previous and not state else None
    own = affected_keys(batch_slice(stats, batch), ["region", "category_id"], history)
    pairs, kept = own, GoldState(spark, state) if state else None
    if kept:
        keys = kept.update(stats, batch, work)
        pairs = keys.filter(~F.col("moved") | F.lit(include_previous)).drop("moved")
    pairs = stage(pairs.dropna(subset=["category_id"]).distinct(), f"{work}/pairs")
    categories = pairs.select("category_id").distinct()
    dim = stage(canonical_dim(reference), f"{work}/dim")
    new = batch_slice(stats, batch)
    counts = (
        new.agg(F.count(F.lit(1)).alias("new_rows"))
        .crossJoin(own.agg(F.countDistinct("category_id").alias("affected_categories"), F.count(F.lit(1)).alias("affected_pairs")))
        .crossJoin(keys_missing_from(new, dim).agg(F.coalesce(F.sum("fact_rows"), F.lit(0)).alias("facts_without_name")))
        .first()  # single rows
        .asDict()
    )
    if categories.isEmpty():
        if kept:
            kept.published()
        drop_scratch(spark, work)
        return counts

    latest = kept.latest() if kept else stage(latest_snapshots(stats), f"{work}/latest")
    results = {
        "category_engagement": category_engagement(kept.sums() if kept else stats, dim, categories),
        "category_performance": category_performance(latest, dim, categories),
        "category_region": category_region(latest, dim, pairs),
        "video_rankings": video_rankings(latest, dim, categories, k),
    }

    def publish(name: str) -> None:
        by = GOLD[name][1]
        keys = pairs.select(*[F.col(c).cast("string") for c in by]).dropna().distinct()
        replace_affected(stage(results[name], f"{work}/{name}"), keys, tables[name], by)

    # The four reports are independent: submitted together, small ones fill the gaps that the
    # last tasks of large ones leave.
    with ThreadPoolExecutor(len(results)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(publish), n) for n in results]:
            done.result()
    if kept:
        kept.published()
    drop_scratch(spark, work)
    return counts
