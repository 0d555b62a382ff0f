"""Bronze to Silver, from JSON envelopes and from CSV files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.casts import CSV_INSTANT, to_bool, to_day, to_instant, to_int, to_long
from tidemark.functions.paths import batch_date_from_path, batch_hour_from_path, region_from_path
from tidemark.functions.text import is_blank
from tidemark.operators.keys import Batch, batch_slice
from tidemark.operators.quality import quality_counts, require_nonblank
from tidemark.operators.ranking import dedupe
from tidemark.operators.reshape import conform, explode_items, extract_json
from tidemark.schemas import (
    CORRUPT,
    QUARANTINE,
    SILVER_HISTORY,
    SILVER_HISTORY_PARTITIONS,
    SILVER_STATS,
    SILVER_STATS_PARTITIONS,
)
from tidemark.session import delete_folder, drop_scratch, path_exists, scratch, setting, stage
from tidemark.sinks.partitions import replace_dataset, write_partitions
from tidemark.sources.envelopes import REJECTED, read_envelopes
from tidemark.sources.flat_csv import read_flat_csv

POSITION = "_pos"
# What opening a document counts for where Spark deals files to tasks: by its own 4 MB a task reads 32 of them.
OPEN_COST = "256k"
JSON_KEYS = ["video_id", "region", "_source_file"]
CSV_KEYS = ["video_id", "trending_date", "region"]

# Item fields as (JSON path, type), for documents read without a schema.
ITEM_PATHS = {
    "video_id": ("$.id", "string"),
    "title": ("$.snippet.title", "string"),
    "channel_title": ("$.snippet.channelTitle", "string"),
    "category_id": ("$.snippet.categoryId", "int"),
    "published": ("$.snippet.publishedAt", "string"),
    "tags": ("$.snippet.tags", "string"),
    "views": ("$.statistics.viewCount", "bigint"),
    "likes": ("$.statistics.likeCount", "bigint"),
    "dislikes": ("$.statistics.dislikeCount", "bigint"),
    "comment_count": ("$.statistics.commentCount", "bigint"),
    "thumbnail_link": ("$.snippet.thumbnails.default.url", "string"),
    "description": ("$.snippet.description", "string"),
}


def _tag(rows: DataFrame, batch: Batch | None) -> DataFrame:
    """Region from the path; the batch from the argument or, without one, from the path."""
    path = F.col("_source_file")
    date = batch_date_from_path(path) if batch is None else F.lit(batch.date)
    hour = batch_hour_from_path(path) if batch is None else F.lit(batch.hour)
    return (
        rows.withColumn("region", region_from_path(path))
        .withColumn("ingestion_date", date)
        .withColumn("ingestion_hour", hour)
    )


def first_per_video(envelopes: DataFrame) -> DataFrame:
    """Envelopes without later items of a video that the same document lists before.

    A document is one row, so its duplicates go without a shuffle. Items without an id stay.
    """
    numbered = F.transform(
        "items", lambda item, i: F.struct(F.trim(item["id"]).alias("id"), i.alias("pos"), item.alias("item"))
    )
    listed = envelopes.withColumn("__listed", F.array_sort(numbered))
    first = F.filter(
        "__listed",
        lambda x, i: is_blank(x["id"]) | (i == 0) | ~x["id"].eqNullSafe(F.get("__listed", i - 1)["id"]),
    )
    kept = F.array_sort(F.transform(first, lambda x: F.struct(x["pos"], x["item"])))
    return listed.withColumn("items", F.transform(kept, lambda x: x["item"])).drop("__listed")


def envelopes_to_rows(envelopes: DataFrame, batch: Batch | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Explode and shape envelopes: one typed row per item, nothing dropped yet; ``keep`` names columns of
    the document that its rows keep."""
    item = explode_items(envelopes.select("items", "_source_file", *keep), position=POSITION)
    snippet, statistics = F.col("item.snippet"), F.col("item.statistics")
    rows = item.select(
        F.trim("item.id").alias("video_id"),
        snippet["title"].alias("title"),
        snippet["channelTitle"].alias("channel_title"),
        to_int(snippet["categoryId"]).alias("category_id"),
        to_instant(snippet["publishedAt"]).alias("publish_time"),
        F.to_json(snippet["tags"]).alias("tags"),
        to_long(statistics["viewCount"]).alias("views"),
        to_long(statistics["likeCount"]).alias("likes"),
        to_long(statistics["dislikeCount"]).alias("dislikes"),
        to_long(statistics["commentCount"]).alias("comment_count"),
        snippet["thumbnails"]["default"]["url"].alias("thumbnail_link"),
        snippet["description"].alias("description"),
        "_source_file",
        POSITION,
        *keep,
    )
    return _tag(rows, batch)


def json_text_to_rows(items: DataFrame, batch: Batch | None = None) -> DataFrame:
    """The same rows from items held as JSON text, for documents of unknown schema."""
    rows = extract_json(items, "_item_json", ITEM_PATHS, "_source_file", POSITION)
    rows = (
        rows.withColumn("video_id", F.trim("video_id"))
        .withColumn("publish_time", to_instant(F.col("published")))
        .drop("published")
    )
    return _tag(rows, batch)


def silver_from_envelopes(rows: DataFrame) -> DataFrame:
    """Validate keys, keep the first item per video, region and file, fix the contract."""
    valid = require_nonblank(rows, "video_id", "region")
    return conform(dedupe(valid, JSON_KEYS, [POSITION]), SILVER_STATS)


def csv_to_rows(flat: DataFrame) -> DataFrame:
    """Typed rows of flat CSV text, nothing dropped yet."""
    return flat.select(
        F.trim("video_id").alias("video_id"),
        "title",
        "channel_title",
        to_day(F.col("trending_date")).alias("trending_date"),
        to_int(F.col("category_id")).alias("category_id"),
        to_instant(F.trim("publish_time"), CSV_INSTANT).alias("publish_time"),
        "tags",
        *[to_long(F.col(c)).alias(c) for c in ("views", "likes", "dislikes", "comment_count")],
        "thumbnail_link",
        *[
            to_bool(F.col(c)).alias(c)
            for c in ("comments_disabled", "ratings_disabled", "video_error_or_removed")
        ],
        "description",
        "_source_file",
        region_from_path(F.col("_source_file")).alias("region"),
    )


def silver_from_csv(rows: DataFrame) -> DataFrame:
    """Validate keys and keep one row per video, day and region.

    Duplicates have no order of their own, so the row whose values sort first survives.
    """
    valid = require_nonblank(rows, "video_id", "region")
    values = [c for c in rows.columns if c not in (*CSV_KEYS, "_source_file")]
    return conform(dedupe(valid, CSV_KEYS, [*values, "_source_file"]), SILVER_HISTORY)


def _watch(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows and blank keys as they pass, without another read of the sources."""
    seen = Observation(name)
    id_ok, region_ok = ~is_blank(F.col("video_id")), ~is_blank(F.col("region"))
    watched = rows.observe(
        seen,
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(~id_ok).alias("blank_video_id"),
        F.count_if(id_ok & ~region_ok).alias("blank_region"),
    )
    return watched, seen


def _observed(seen: Sequence[Observation], direct: Callable[[], DataFrame]) -> dict[str, int]:
    """Counters of a finished run; ``direct`` counts again where the run left no row, since Spark then
    drops them from its plan. Any other failure is one."""
    try:
        return {name: n for s in seen for name, n in s.get.items()}
    except Py4JJavaError as error:
        if "java.lang.AssertionError" not in error.java_exception.toString():
            raise
        return direct().first().asDict()


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("output_rows")), seen


def _document_counts(envelopes: DataFrame) -> Column:
    """What a document adds to the counts of a run, as a struct."""
    ids = F.transform(F.coalesce("items", F.array().cast(envelopes.schema["items"].dataType)), lambda i: F.trim(i["id"]))
    named = F.filter(ids, lambda i: ~is_blank(i))
    region = ~is_blank(region_from_path(F.col("_source_file")))
    distinct = F.when(region, F.size(F.array_distinct(named))).otherwise(0)
    return F.struct(
        F.lit(1).alias("files"),
        F.col(CORRUPT).isNotNull().cast("int").alias("unreadable_files"),
        F.size(REJECTED).alias("rejected_items"),
        F.size(ids).alias("input_rows"),
        (F.size(ids) - F.size(named)).alias("blank_video_id"),
        F.when(region, 0).otherwise(F.size(named)).alias("blank_region"),
        F.when(region, F.size(named) - distinct).otherwise(0).alias("duplicate_rows"),
        distinct.alias("output_rows"),
    )


_COUNTS = "__counts"


def _totals(df: DataFrame) -> list[Column]:
    """The counts of a run, over rows of which one per document holds its own."""
    names = df.schema[_COUNTS].dataType.names
    return [F.coalesce(F.sum(f"{_COUNTS}.{name}"), F.lit(0)).cast("bigint").alias(name) for name in names]


def _counted_rows(envelopes: DataFrame, batch: Batch | None) -> DataFrame:
    """Silver rows of counted documents, and before those of each document a row that holds its counts."""
    none = F.array(F.lit(None).cast(envelopes.schema["items"].dataType.elementType))
    firsts = first_per_video(envelopes)
    listed = firsts.withColumn("items", F.concat(none, F.coalesce("items", F.slice(none, 1, 0))))
    rows = envelopes_to_rows(listed, batch, [_COUNTS])
    rows = rows.withColumn(_COUNTS, F.when(F.col(POSITION) == 0, F.col(_COUNTS)))
    good = ~is_blank(F.col("video_id")) & ~is_blank(F.col("region"))
    return conform(rows.filter(F.col(_COUNTS).isNotNull() | good), T.StructType([*SILVER_STATS, rows.schema[_COUNTS]]))


def quarantined(envelopes: DataFrame, batch: Batch | None = None) -> DataFrame:
    """One row per unreadable document and per rejected item: its file, why, and its text."""
    whole = F.filter(
        F.array(F.struct(F.lit("unreadable document").alias("reason"), F.col(CORRUPT).alias("content"))),
        lambda x: x["content"].isNotNull(),
    )
    items = F.transform(REJECTED, lambda text: F.struct(F.lit("item is no object").alias("reason"), text.alias("content")))
    rows = envelopes.select("_source_file", F.explode(F.concat(whole, items)).alias("x"))
    return _tag(rows.select("_source_file", "x.reason", "x.content"), batch)


def _set_aside(rows: DataFrame, path: str, batch: Batch | None) -> None:
    """Makes ``rows`` all that the quarantine holds of a batch (of every batch for None)."""
    spark, work = rows.sparkSession, scratch(rows.sparkSession)
    bad = stage(rows, work)
    if batch is None:
        replace_dataset(bad, path, SILVER_STATS_PARTITIONS)
    else:
        emptied = []
        if path_exists(spark, path):
            folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")
            held = batch_slice(spark.read.schema(QUARANTINE).parquet(path), batch).select("region", folder).distinct()
            still = bad.select(F.col("region").alias("bad_region")).distinct()
            same = F.coalesce("region", F.lit("")) == F.coalesce("bad_region", F.lit(""))
            emptied = held.join(still, same, "left_anti").collect()  # folders of one batch
        write_partitions(bad, path, SILVER_STATS_PARTITIONS)
        for row in emptied:
            delete_folder(spark, unquote(row.folder))
    drop_scratch(spark, work)


def bronze_json_to_silver(
    spark: SparkSession, raw: str, target: str, batch: Batch | None, quarantine: str | None = None,
    pattern: str = "*.json",
) -> dict[str, int]:
    """Load one batch of envelopes (every batch for None) into the partitioned fact table.

    The sources are read once: a row with the counts of a document travels with its rows to the tasks that
    write, and is added up there. Spark takes each of those tasks into account once, so the counts are
    exact also when tasks are repeated after a lost executor. What could not be read is counted, and with
    ``quarantine`` written there, replacing what an earlier run of the batch left: a batch that has been
    repaired leaves nothing there.
    """
    envelopes = read_envelopes(spark, raw, batch, keep_corrupt=True, pattern=pattern)
    counted = envelopes.withColumn(_COUNTS, _document_counts(envelopes))
    seen, totals = Observation("documents"), _totals(counted)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.observe(seen, *totals).filter(F.col(_COUNTS).isNull()).drop(_COUNTS)

    with setting(spark, "spark.sql.files.openCostInBytes", OPEN_COST):
        write_partitions(_counted_rows(counted, batch), target, SILVER_STATS_PARTITIONS, dealt)
        counts = _observed([seen], lambda: counted.agg(*totals))
        if quarantine:
            bad = counts["unreadable_files"] + counts["rejected_items"]
            rows = quarantined(envelopes, batch) if bad else spark.createDataFrame([], QUARANTINE)
            _set_aside(conform(rows, QUARANTINE), quarantine, batch)
    return counts


def bronze_csv_to_silver(
    spark: SparkSession,
    raw: str,
    target: str,
    day: dt.date | None = None,
    replace_all: bool = True,
    multi_line: bool = True,
) -> dict[str, int]:
    """Load CSV files into the history table: the whole dataset, or only the regions present.

    ``day`` reads the files of one ``date=`` folder; without it every file below ``raw`` counts,
    those directly in a region folder included. Without line breaks inside quotes pass
    ``multi_line=False``: large files are then split over tasks.
    """
    path = raw if day is None else f"{raw.rstrip('/')}/region=*/date={day.isoformat()}"
    rows = csv_to_rows(read_flat_csv(spark, path, multi_line=multi_line))
    watched, before = _watch(rows, "bronze_csv")
    silver, after = _counted(silver_from_csv(watched), "silver_csv")
    (replace_dataset if replace_all else write_partitions)(silver, target, SILVER_HISTORY_PARTITIONS)
    counts = _observed([before, after], lambda: quality_counts(rows, ["video_id", "region"], CSV_KEYS))
    left = counts["input_rows"] - counts["blank_video_id"] - counts["blank_region"]
    return {**counts, "duplicate_rows": left - counts["output_rows"]}
