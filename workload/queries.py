"""One query per operator or job, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import operators as ops
from tidemark import plans, sinks, sources
from tidemark.functions import (
    decode_key,
    region_from_path,
    to_bool,
    to_day,
    to_instant,
    to_int,
    to_long,
)
from tidemark.functions.casts import CSV_INSTANT
from tidemark.operators.keys import Batch
from tidemark.plans.dimension import replace_regions
from tidemark.schemas import (
    GOLD,
    QUARANTINE,
    SILVER_HISTORY,
    SILVER_STATS,
)
from tidemark.session import scratch, stage
from tidemark.sources.reference import POS
from tidemark.streaming import stream_reference
from workload import adapter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def plain(df: DataFrame) -> DataFrame:
    """Days and instants as text, so that both engines compare the same values."""

    def text(field: T.StructField):
        if isinstance(field.dataType, T.DateType):
            return F.col(field.name).cast("string").alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            utc = F.to_utc_timestamp(field.name, F.current_timezone())
            return F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        return F.col(field.name)

    return df.select(*[text(f) for f in df.schema])


def _reference(spark: SparkSession, sf: str) -> DataFrame:
    return ops.keep_last(adapter.reference_rows(spark, sf, "customer"), ["region", "id"], ["pos"])


def _dim(spark: SparkSession, sf: str) -> DataFrame:
    return ops.canonical_dim(_reference(spark, sf))


def _newest(stats: DataFrame) -> DataFrame:
    return ops.batch_slice(stats, ops.latest_batch(stats))


def _affected(stats: DataFrame, *keys: str) -> DataFrame:
    return ops.affected_keys(_newest(stats), keys)


# --- Gold reports over the newest batch ---------------------------------------------------


@query
def category_engagement(spark: SparkSession, sf: str) -> DataFrame:
    stats = adapter.stats(spark, sf)
    return plans.category_engagement(stats, _dim(spark, sf), _affected(stats, "category_id"))


@query
def category_engagement_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Every category, each video counted once."""
    latest = plans.latest_snapshots(adapter.stats(spark, sf))
    return plans.category_engagement(latest, _dim(spark, sf))


@query
def category_performance(spark: SparkSession, sf: str) -> DataFrame:
    stats = adapter.stats(spark, sf)
    latest = plans.latest_snapshots(stats)
    return plans.category_performance(latest, _dim(spark, sf), _affected(stats, "category_id"))


@query
def category_region(spark: SparkSession, sf: str) -> DataFrame:
    stats = adapter.stats(spark, sf)
    latest = plans.latest_snapshots(stats)
    return plans.category_region(latest, _dim(spark, sf), _affected(stats, "region", "category_id"))


@query
def category_region_all(spark: SparkSession, sf: str) -> DataFrame:
    """Full recompute: every region and category."""
    return plans.category_region(plans.latest_snapshots(adapter.stats(spark, sf)), _dim(spark, sf))


@query
def video_rankings(spark: SparkSession, sf: str) -> DataFrame:
    stats = adapter.stats(spark, sf)
    latest = plans.latest_snapshots(stats)
    return plans.video_rankings(latest, _dim(spark, sf), _affected(stats, "category_id"))


@query
def video_rankings_all(spark: SparkSession, sf: str) -> DataFrame:
    """Full recompute, top 5 per category."""
    return plans.video_rankings(plans.latest_snapshots(adapter.stats(spark, sf)), _dim(spark, sf), k=5)


# --- Batches, keys, joins -----------------------------------------------------------------


@query
def latest_batch(spark: SparkSession, sf: str) -> DataFrame:
    return plain(ops.latest_batch_df(adapter.stats(spark, sf)))


@query
def batch_rows(spark: SparkSession, sf: str) -> DataFrame:
    return plain(_newest(adapter.stats(spark, sf)).drop("_source_file"))


@query
def affected_categories(spark: SparkSession, sf: str) -> DataFrame:
    return _affected(adapter.stats(spark, sf), "category_id")


@query
def affected_category_regions(spark: SparkSession, sf: str) -> DataFrame:
    return _affected(adapter.stats(spark, sf), "region", "category_id")


@query
def affected_with_previous(spark: SparkSession, sf: str) -> DataFrame:
    """Categories of the newest batch, and those its videos were in earlier."""
    stats = adapter.stats(spark, sf)
    return ops.affected_keys(_newest(stats), ["category_id"], history=stats)


@query
def restrict_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Latest snapshots of the region and category pairs of the newest batch."""
    stats = adapter.stats(spark, sf)
    pairs = _affected(stats, "region", "category_id")
    latest = plans.latest_snapshots(stats)
    return ops.restrict_to(latest, pairs, ["region", "category_id"])


@query
def restricted_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Latest snapshots in affected categories, from history cut to the videos concerned."""
    stats = adapter.stats(spark, sf)
    affected = _affected(stats, "category_id")
    latest = plans.latest_snapshots(ops.restrict_history(stats, affected))
    return ops.restrict_to(latest, affected, ["category_id"])


@query
def facts_with_names(spark: SparkSession, sf: str) -> DataFrame:
    named = ops.lookup_dim(adapter.stats(spark, sf), _dim(spark, sf))
    return named.select("event_id", "video_id", "category_id", "category_name")


@query
def facts_without_names(spark: SparkSession, sf: str) -> DataFrame:
    """Fact rows that inner joins drop because their category has no dimension row."""
    return ops.keys_missing_from(adapter.stats(spark, sf), _dim(spark, sf))


# --- One row per key, top-k ---------------------------------------------------------------


@query
def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return plans.latest_snapshots(adapter.stats(spark, sf))


@query
def canonical_categories(spark: SparkSession, sf: str) -> DataFrame:
    return _dim(spark, sf)


@query
def dedupe_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """The first snapshot per video, region and day."""
    keys = ["video_id", "region", "ingestion_date"]
    first = ops.dedupe(adapter.stats(spark, sf), keys, ["event_id"])
    return plain(first.select(*keys, "event_id", "views"))


@query
def keep_last_reference(spark: SparkSession, sf: str) -> DataFrame:
    return _reference(spark, sf)


@query
def top_videos_per_region(spark: SparkSession, sf: str) -> DataFrame:
    """The 1,500 most viewed snapshots per region."""
    stats = adapter.stats(spark, sf).select("region", "event_id", "views")
    order = [F.col("views").desc_nulls_last(), F.col("event_id").asc()]
    return ops.top_k(stats, ["region"], order, 1500, "view_rank")


# --- Unions and the upsert ----------------------------------------------------------------


@query
def upsert_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier rows stored, customer rows incoming with one more column."""
    stored = adapter.reference_rows(spark, sf, "supplier").drop("balance")
    incoming = adapter.reference_rows(spark, sf, "customer")
    return ops.upsert(stored, incoming, ["region", "id"], ["pos"])


@query
def concat_evolving(spark: SparkSession, sf: str) -> DataFrame:
    """Differing columns, and one column whose types differ."""
    first = adapter.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("code"), F.col("s_name").alias("name")
    )
    second = adapter.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("code"),
        F.col("c_mktsegment").alias("segment"),
    )
    return ops.concat_evolving(first, second)


@query
def union_history(spark: SparkSession, sf: str) -> DataFrame:
    """History and current facts under one contract, counted by region and batch presence."""
    rows = plans.csv_to_rows(_with_file(adapter.flat_text(spark, sf)))
    both = ops.union_history(rows, adapter.stats(spark, sf))
    return both.groupBy("region", F.col("ingestion_date").isNotNull().alias("has_batch")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("views").alias("views"),
        F.count("trending_date").alias("with_trending_date"),
    )


@query
def latest_over_history(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a batch never beat rows with one: half the snapshots lose their batch."""
    stats = adapter.stats(spark, sf)
    old = stats.filter(F.col("event_id") % 2 == 0).drop("ingestion_date", "ingestion_hour")
    new = stats.filter(F.col("event_id") % 2 == 1)
    both = new.unionByName(old, allowMissingColumns=True)
    return plans.latest_snapshots(both)


@query
def performance_over_history(spark: SparkSession, sf: str) -> DataFrame:
    """Category performance over flat history and current facts together."""
    history = plans.csv_to_rows(_with_file(adapter.flat_text(spark, sf)))
    both = ops.union_history(history, adapter.stats(spark, sf))
    return plans.category_performance(plans.latest_snapshots(both), _dim(spark, sf))


# --- Reshaping and casts ------------------------------------------------------------------


def _with_file(df: DataFrame) -> DataFrame:
    """A path per row, in place of the one a scan would report."""
    return df.withColumn("_source_file", F.concat(F.lit("raw/region="), "region", F.lit("/x")))


@query
def json_extract_cast(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of JSON text by path, with safe casts."""
    items = adapter.raw_items(spark, sf).select("event_id", F.to_json("item").alias("_item_json"))
    fields = {
        "video_id": ("$.id", "string"),
        "category_id": ("$.snippet.categoryId", "int"),
        "tags": ("$.snippet.tags", "string"),
        "url": ("$.snippet.thumbnails.default.url", "string"),
        "views": ("$.statistics.viewCount", "bigint"),
        "dislikes": ("$.statistics.dislikeCount", "bigint"),
        "description": ("$.snippet.description", "string"),
    }
    return ops.extract_json(items, "_item_json", fields, "event_id")


@query
def flatten_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Nested and odd column names; two columns meet under one name."""
    part = adapter.table(spark, sf, "part")
    nested = part.select(
        F.col("p_partkey").alias("id"),
        F.struct(
            F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("title"),
            F.col("p_brand").alias("channelId"),
            F.struct(F.col("p_type").alias("weird-type.name")).alias("inner"),
        ).alias("snippet"),
        F.concat(F.lit("alt "), F.col("p_name")).alias("snippet_title"),
        F.col("p_size").alias("__Size  (cm)__"),
    )
    return ops.normalize_columns(ops.flatten_structs(nested))


@query
def flatten_normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names with any characters and names that differ in case only, nested and at the top."""
    part = adapter.table(spark, sf, "part")
    nested = part.select(
        F.col("p_partkey").alias("ID"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("x y"),
        F.col("p_size").alias("X Y"),
        F.struct(
            F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("Title"),
            F.concat(F.lit("alt "), "p_name").alias("title"),
            F.struct(F.col("p_type").alias("we`ird, <name>")).alias("a.b"),
        ).alias("Snippet"),
    )
    return ops.normalize_columns(ops.flatten_structs(nested))


@query
def safe_parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    flat = adapter.flat_text(spark, sf)
    whole = F.replace(F.col("publish_time"), F.lit(".000Z"), F.lit("Z"))
    mixed = F.when(F.col("likes").cast("int") % 2 == 0, whole).otherwise(F.col("publish_time"))
    return plain(
        flat.select(
            "title",
            to_day(F.col("trending_date")).alias("trending_date"),
            to_instant(F.col("publish_time"), CSV_INSTANT).alias("publish_time"),
            to_instant(mixed).alias("other_format"),
        )
    )


@query
def safe_cast_flags(spark: SparkSession, sf: str) -> DataFrame:
    text = (
        F.when(F.col("l_returnflag") == "A", F.lit(" TRUE "))
        .when(F.col("l_returnflag") == "N", F.lit("no"))
        .otherwise(F.lit("maybe"))
    )
    lines = adapter.table(spark, sf, "lineitem")
    return (
        lines.groupBy("l_returnflag", to_bool(text).alias("flag"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def safe_cast_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Padded whole numbers parse; fractions, exponents, blanks and numbers out of range give NULL."""
    lines = adapter.table(spark, sf, "lineitem")
    padded = F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit(" "))
    number = F.col("l_linenumber").cast("string")
    odd = F.col("l_linenumber") % 2 == 1

    def mixed(bad):
        return F.when(odd, bad).otherwise(number)

    return lines.groupBy("l_returnflag").agg(
        F.sum(to_long(padded)).alias("keys"),
        F.sum(to_int(number)).alias("lines"),
        F.sum(to_long(mixed(F.concat(number, F.lit("e3"))))).alias("exponents"),
        F.sum(to_int(mixed(F.concat(number, F.lit(".5"))))).alias("fractions"),
        F.count(to_int(mixed(F.lit("")))).alias("blanks"),
        F.sum(to_int(mixed(F.concat(F.lit("9999999"), F.lpad(number, 4, "0"))))).alias("overflows"),
    )


@query
def nonblank_keys(spark: SparkSession, sf: str) -> DataFrame:
    raw = adapter.raw_items(spark, sf).select("event_id", "item.id", "region")
    blanked = raw.withColumn("region", F.when(F.col("event_id") % 7 != 0, F.col("region")))
    return ops.require_nonblank(blanked, "id", "region")


@query
def region_from_path_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Region of each page path, with the default where there is none."""
    segment = F.split("url", "/")[3]
    path = F.when(
        F.col("page_id") % 3 != 0, F.concat(F.lit("raw/region="), segment, F.lit("/x.json"))
    ).otherwise(F.concat(F.lit("raw/"), segment, F.lit("/x.json")))
    pages = adapter.table(spark, sf, "pages")
    return pages.select(
        "page_id",
        region_from_path(path).alias("region"),
        region_from_path(path, "unknown").alias("region_or_default"),
    )


@query
def decode_keys(spark: SparkSession, sf: str) -> DataFrame:
    pages = adapter.table(spark, sf, "pages")
    key = F.col("url")
    for plain_text, escaped in (("/", "%2F"), ("?", "%3F"), ("=", "%3D"), ("&", "%26")):
        key = F.replace(key, F.lit(plain_text), F.lit(escaped))
    return pages.select("page_id", decode_key(F.concat(key, F.lit("+end"))).alias("key"))


@query
def region_allow_list(spark: SparkSession, sf: str) -> DataFrame:
    """Envelopes of two allowed regions, whatever the case and padding of either side."""
    envelopes = adapter.fetched(spark, sf).withColumn(
        "region", F.concat(F.lit(" "), F.upper("region"), F.lit(" "))
    )
    root = scratch(spark)
    sinks.land_envelopes(
        envelopes, root, F.col("run"), adapter.SOURCE, run_id=F.col("run_id"), regions=["Asia ", "EUROPE"]
    )
    landed = sources.read_envelopes(spark, root)
    return landed.groupBy(F.col("_pipeline_metadata.region").alias("region")).agg(
        F.count(F.lit(1)).alias("envelopes"), F.sum(F.size("items")).alias("items")
    )


@query
def envelope_metadata(spark: SparkSession, sf: str) -> DataFrame:
    tagged = sinks.with_metadata(
        adapter.fetched(spark, sf), F.col("run"), adapter.SOURCE, F.col("run_id")
    )
    return tagged.select("_pipeline_metadata.*")


# --- Bronze and Silver through files ------------------------------------------------------


def _land(spark: SparkSession, sf: str) -> str:
    root = scratch(spark)
    sinks.land_envelopes(
        adapter.fetched(spark, sf), root, F.col("run"), adapter.SOURCE, run_id=F.col("run_id")
    )
    return root


@query
def envelope_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Land, read back, explode; region and batch come from the path."""
    envelopes = sources.read_envelopes(spark, _land(spark, sf))
    rows = plans.envelopes_to_rows(envelopes)
    return plain(
        rows.select("region", "ingestion_date", "ingestion_hour", "video_id", "title", "_pos")
    )


@query
def discover_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The newest landed batch from paths alone, and the number of landed files."""
    root = _land(spark, sf)
    batch = sources.discover_latest_batch(spark, root)
    return sources.list_files(spark, root).agg(
        F.lit(batch.date.isoformat()).alias("ingestion_date"),
        F.lit(batch.hour).alias("ingestion_hour"),
        F.count(F.lit(1)).alias("files"),
    )


@query
def silver_json(spark: SparkSession, sf: str) -> DataFrame:
    """Landed envelopes into the partitioned fact table, read back."""
    raw, target = _land(spark, sf), scratch(spark)
    plans.bronze_json_to_silver(spark, raw, target, None)
    return plain(sources.read_stats(spark, target).drop("_source_file"))


_RUN_FOLDERS = ["region", "date", "hour", "run"]


def _half_good(spark: SparkSession, sf: str) -> str:
    """Landed envelopes, one in three with a text element before its items and one in seven cut off."""
    root = scratch(spark)
    envelope = F.to_json(F.struct("kind", "etag", "items"))
    chunk = F.col("chunk")
    text = (
        F.when(chunk % 7 == 6, F.expr("left(envelope, length(envelope) - 2)"))
        .when(chunk % 3 == 1, F.regexp_replace("envelope", r'"items":\[', '"items":["text",'))
        .otherwise(F.col("envelope"))
    )
    damaged = (
        adapter.fetched(spark, sf)
        .withColumn("envelope", envelope)
        .select(
            "region",
            F.date_format("run", "yyyy-MM-dd").alias("date"),
            F.date_format("run", "HH").alias("hour"),
            F.col("run_id").alias("run"),
            text.alias("text"),
        )
    )
    sinks.write_documents(damaged, _RUN_FOLDERS, root, "text")
    return root


@query
def silver_json_damaged(spark: SparkSession, sf: str) -> DataFrame:
    """All good items of damaged files are stored."""
    target = scratch(spark)
    plans.bronze_json_to_silver(spark, _half_good(spark, sf), target, None, pattern=_ANY)
    return plain(sources.read_stats(spark, target).drop("_source_file"))


@query
def silver_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """What could not be read, by region and reason."""
    aside = scratch(spark)
    plans.bronze_json_to_silver(spark, _half_good(spark, sf), scratch(spark), None, aside, _ANY)
    return spark.read.parquet(aside).groupBy("region", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def quarantine_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Every batch is loaded with damaged files; then the newest batch that had any comes again, repaired:
    nothing of it stays aside, and what other batches left stays."""
    target, aside = scratch(spark), scratch(spark)
    plans.bronze_json_to_silver(spark, _half_good(spark, sf), target, None, aside, _ANY)
    newest = ops.latest_batch(sources.read_stats(spark, aside, QUARANTINE))
    plans.bronze_json_to_silver(spark, _land(spark, sf), target, newest, aside, _ANY)
    return spark.read.parquet(aside).groupBy("region", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def silver_run_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counts that the Silver job returns for damaged files."""
    counts = plans.bronze_json_to_silver(spark, _half_good(spark, sf), scratch(spark), None, pattern=_ANY)
    events = adapter.table(spark, sf, "events").agg(F.count(F.lit(1)).alias("events"))
    return events.select("events", *[F.lit(n).cast("bigint").alias(name) for name, n in counts.items()])


@query
def landing_twice(spark: SparkSession, sf: str) -> DataFrame:
    """The same runs landed twice, the second time only one region of them: nothing doubles or is lost."""
    root = _land(spark, sf)
    again = adapter.fetched(spark, sf).filter("region = 'asia'")
    sinks.land_envelopes(again, root, F.col("run"), adapter.SOURCE, run_id=F.col("run_id"))
    landed = sources.read_envelopes(spark, root)
    return landed.groupBy(F.col("_pipeline_metadata.region").alias("region")).agg(
        F.count(F.lit(1)).alias("envelopes"), F.sum(F.size("items")).alias("items")
    )


@query
def silver_json_schemaless(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows through JSON text and paths, without a declared schema."""
    items = sources.read_items_schemaless(spark, _land(spark, sf))
    rows = plans.json_text_to_rows(items)
    return plain(plans.silver_from_envelopes(rows).drop("_source_file"))


@query
def silver_batch_json(spark: SparkSession, sf: str) -> DataFrame:
    """Only the newest batch is listed, read and written."""
    raw, target = _land(spark, sf), scratch(spark)
    batch = sources.discover_latest_batch(spark, raw)
    plans.bronze_json_to_silver(spark, raw, target, batch)
    rows = sources.read_stats(spark, target)
    return plain(rows.select("video_id", "region", "ingestion_date", "ingestion_hour", "views"))


def _flat_files(spark: SparkSession, sf: str) -> str:
    root = scratch(spark)
    (
        adapter.flat_text(spark, sf)
        .write.partitionBy("region")
        .options(header=True, quote='"', escape="\\")
        .csv(root)
    )
    return root


@query
def silver_csv(spark: SparkSession, sf: str) -> DataFrame:
    target = scratch(spark)
    plans.bronze_csv_to_silver(spark, _flat_files(spark, sf), target)
    return plain(sources.read_stats(spark, target, SILVER_HISTORY).drop("_source_file"))


@query
def csv_table(spark: SparkSession, sf: str) -> DataFrame:
    """An external table over the CSV files."""
    name = _name("raw")
    sinks.create_csv_table(spark, name, _flat_files(spark, sf))
    return spark.table(name).groupBy("channel_title").agg(
        F.count("title").alias("n"), F.max("title").alias("last_title")
    )


@query
def stage_quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Rows lost at each cleaning step, exact and in one pass."""
    raw = adapter.raw_items(spark, sf).select(
        F.trim("item.id").alias("video_id"),
        F.when(F.col("event_id") % 7 != 0, F.col("region")).alias("region"),
        F.col("chunk").cast("string").alias("_source_file"),
    )
    return ops.quality_counts(raw, ["video_id", "region"], plans.silver.JSON_KEYS)


# --- Reports ------------------------------------------------------------------------------


def _damaged(spark: SparkSession, sf: str) -> str:
    """Landed envelopes of which some are empty and some are not envelopes at all."""
    root = scratch(spark)
    good = adapter.fetched(spark, sf)
    kind = F.col("chunk") % 7
    emptied = good.withColumn("items", F.filter("items", lambda _: kind != 5))
    sinks.land_envelopes(
        emptied.filter(kind != 3), root, F.col("run"), adapter.SOURCE, run_id=F.col("run_id")
    )
    oops = good.filter(kind == 3).select(
        "region",
        F.date_format("run", "yyyy-MM-dd").alias("date"),
        F.date_format("run", "HH").alias("hour"),
        F.col("run_id").alias("run"),
        F.lit("oops").alias("items"),
    )
    sinks.write_documents(oops, _RUN_FOLDERS, root)
    return root


@query
def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome per landed file; the file name is left out since Spark invents it."""
    report = sinks.envelope_report(
        sources.read_envelopes(spark, _damaged(spark, sf), keep_corrupt=True)
    )
    run = F.regexp_extract("key", r"/run=([^/]+)/", 1)
    return report.select(run.alias("run_id"), "region", "incoming_rows", "final_rows", "error")


@query
def ingest_summary_json(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes per region as JSON documents."""
    envelopes = sources.read_envelopes(spark, _damaged(spark, sf), keep_corrupt=True)
    return sinks.report_json(sinks.run_summary(sinks.envelope_report(envelopes)))


# --- Reference dimension through files ----------------------------------------------------


def _land_reference(spark: SparkSession, sf: str, name: str, root: str) -> str:
    sinks.land_reference(
        adapter.reference_documents(spark, sf, name),
        root,
        F.to_timestamp(F.lit("2024-01-01T00:00:00Z")),
        adapter.SOURCE,
        run_id=F.col("run_id"),
    )
    return root


_STAMP = "2024-01-01T00:00:00.000000+00:00"
_DIM_COLUMNS = ["region", "id", "snippet_title", "snippet_channelid", "ingestion_timestamp"]


@query
def reference_job(spark: SparkSession, sf: str) -> DataFrame:
    """Two sets of category files upserted into the dimension, supplier files first."""
    target = scratch(spark)
    for name in ("supplier", "customer"):
        raw = _land_reference(spark, sf, name, scratch(spark))
        plans.upsert_reference(spark, raw, target, _STAMP)
    return sources.read_reference_table(spark, target).select(*_DIM_COLUMNS)


@query
def reference_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows found per file, and dimension rows of its region afterwards."""
    raw = _land_reference(spark, sf, "customer", scratch(spark))
    report = plans.upsert_reference(spark, raw, scratch(spark), _STAMP)
    run = F.regexp_extract("key", r"/run=([^/]+)/", 1)
    return report.select(
        run.alias("run_id"), "region", "incoming_rows", "distinct_rows", "final_rows", "dimension_rows", "error"
    )


def _texts(rows: DataFrame, root: str) -> None:
    """One file per row of (region, text), whatever the text is."""
    sinks.write_documents(rows, ["region"], root, form="text")


_ANY = "part-*"


def _damaged_reference(spark: SparkSession, sf: str, root: str) -> None:
    """A file per supplier: text for the list, a text element, a text snippet, broken JSON, a half-good list."""
    key = F.col("s_suppkey").cast("string")
    text = (
        F.when(F.col("s_suppkey") % 5 == 0, F.lit('{"items": "text"}'))
        .when(F.col("s_suppkey") % 5 == 1, F.lit('{"items": ["text"]}'))
        .when(F.col("s_suppkey") % 5 == 2, F.concat(F.lit('{"items": [{"id": "'), key, F.lit('", "snippet": "text"}]}')))
        .when(F.col("s_suppkey") % 5 == 3, F.concat(F.lit('{"items": [{"id": "'), key))
        .otherwise(F.concat(F.lit('{"items": ["text", {"id": "s'), key, F.lit('", "snippet": {"title": "half", "channelId": 1}}]}')))
    )
    _texts(adapter.table(spark, sf, "supplier").select(F.lit("damaged").alias("region"), text.alias("text")), root)


@query
def reference_job_damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Good files beside damaged ones: the upsert of all that is good."""
    raw, target = _land_reference(spark, sf, "customer", scratch(spark)), scratch(spark)
    _damaged_reference(spark, sf, raw)
    plans.upsert_reference(spark, raw, target, _STAMP, pattern=_ANY)
    return sources.read_reference_table(spark, target).select(*_DIM_COLUMNS)


@query
def reference_report_damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of good and damaged files: files, elements found and rows by error."""
    raw = _land_reference(spark, sf, "customer", scratch(spark))
    _damaged_reference(spark, sf, raw)
    report = plans.upsert_reference(spark, raw, scratch(spark), _STAMP, pattern=_ANY)
    return report.groupBy("error").agg(
        F.count(F.lit(1)).alias("files"), F.sum("incoming_rows").alias("found"), F.sum("distinct_rows").alias("rows")
    )


@query
def stream_upsert_damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Damaged files arrive together with good ones; none of the good is lost."""
    target, checkpoint, raw = scratch(spark), scratch(spark), scratch(spark)
    for name in ("supplier", "customer"):
        _land_reference(spark, sf, name, f"{raw}/{name}")
        _damaged_reference(spark, sf, f"{raw}/damaged_{name}")
        stream_reference(
            spark, raw, target, checkpoint, ingestion_timestamp=_STAMP, pattern=_ANY
        ).awaitTermination()
    return sources.read_reference_table(spark, target).select(*_DIM_COLUMNS)


def _named_reference(spark: SparkSession, sf: str, root: str) -> None:
    """A file per supplier with names of all kinds: signs, spaces, the library's own, and pairs that differ in case."""
    key, kind = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 3
    titles = (
        F.when(kind == 0, F.concat(F.lit('{"Title": "'), "s_name", F.lit('", "title": "second"}')))
        .when(kind == 1, F.lit('{"Title": null, "title": "second"}'))
        .otherwise(F.lit('{"title": "low", "Title": "high"}'))
    )
    text = F.concat(
        F.lit('{"items": [{"id": "n'), key, F.lit('", "a`b": '), key, F.lit(', "ID": "other", "__file": "f'), key,
        F.lit('", "x, <y> z": [1, 2], "snippet": '), titles, F.lit("}]}"),
    )
    _texts(adapter.table(spark, sf, "supplier").select(F.lit("named").alias("region"), text.alias("text")), root)


def _named_columns(spark: SparkSession, target: str) -> DataFrame:
    dim = sources.read_reference_table(spark, target)
    return dim.select(*_DIM_COLUMNS, "a_b", "file", F.to_json("x_y_z").alias("listed"))


@query
def reference_job_names(spark: SparkSession, sf: str) -> DataFrame:
    """Files with names of all kinds beside plain ones: names are normalised, colliding ones merged."""
    raw, target = _land_reference(spark, sf, "customer", scratch(spark)), scratch(spark)
    _named_reference(spark, sf, raw)
    plans.upsert_reference(spark, raw, target, _STAMP, pattern=_ANY)
    return _named_columns(spark, target)


@query
def stream_upsert_names(spark: SparkSession, sf: str) -> DataFrame:
    """The same files as a stream, in two waves, the second with damaged files beside them."""
    target, checkpoint, raw = scratch(spark), scratch(spark), scratch(spark)
    waves = (
        lambda: _land_reference(spark, sf, "customer", f"{raw}/customer"),
        lambda: (_named_reference(spark, sf, f"{raw}/named"), _damaged_reference(spark, sf, f"{raw}/damaged")),
    )
    for land in waves:
        land()
        stream_reference(spark, raw, target, checkpoint, ingestion_timestamp=_STAMP, pattern=_ANY).awaitTermination()
    return _named_columns(spark, target).filter("region <> 'damaged'")


@query
def reference_region_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Older load: customer rows replace the regions they cover, the others keep supplier rows."""
    target = scratch(spark)
    replace_regions(adapter.reference_rows(spark, sf, "supplier").withColumnRenamed("pos", POS), target)
    incoming = adapter.reference_rows(spark, sf, "customer").withColumnRenamed("pos", POS)
    replace_regions(incoming.filter(F.col("region").isin("asia", "europe")), target)
    return sources.read_reference_table(spark, target).select("region", "id", "snippet_title")


@query
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Files arrive in two waves; the second run of the stream sees only the new ones."""
    target, checkpoint, raw = scratch(spark), scratch(spark), scratch(spark)
    for name in ("supplier", "customer"):
        _land_reference(spark, sf, name, f"{raw}/{name}")
        stream_reference(
            spark, raw, target, checkpoint, ingestion_timestamp=_STAMP
        ).awaitTermination()
    return sources.read_reference_table(spark, target).select(*_DIM_COLUMNS)


# --- Table maintenance --------------------------------------------------------------------


def _name(kind: str) -> str:
    return f"tidemark_{kind}_{uuid.uuid4().hex[:12]}"


def _counts(df: DataFrame) -> DataFrame:
    return df.groupBy("region", F.col("category_id").cast("string").alias("category_id")).agg(
        F.count(F.lit(1)).alias("n")
    )


_COUNT_SCHEMA = T.StructType().add("n", "long").add("region", "string").add("category_id", "string")
_COUNT_KEYS = ["region", "category_id"]


@query
def incremental_replace(spark: SparkSession, sf: str) -> DataFrame:
    """First and second half of the events; the second run touches categories 0 to 9, of which
    category 3 ends without output. Its partitions disappear, the others are replaced."""
    stats = adapter.stats(spark, sf).withColumn("first_half", F.col("ingestion_date") < "2024-01-16")
    name, path = _name("counts"), scratch(spark)
    sinks.write_partitions(_counts(stats.filter("first_half")), path, _COUNT_KEYS)
    sinks.create_table(spark, name, _COUNT_SCHEMA, path, _COUNT_KEYS)
    sinks.repair_table(spark, name)
    touched = stats.filter("category_id < 10")
    affected = _counts(touched).drop("n")
    sinks.replace_affected(_counts(touched.filter("category_id <> 3")), affected, name, _COUNT_KEYS)
    return spark.read.schema(_COUNT_SCHEMA).parquet(path)


@query
def evolving_table(spark: SparkSession, sf: str) -> DataFrame:
    """The registered dimension shows columns that only newer files have."""
    target, name = scratch(spark), _name("dim")
    old = adapter.reference_rows(spark, sf, "supplier").drop("balance")
    sinks.write_partitions(ops.keep_last(old, ["region", "id"], ["pos"]), target, ["region"])
    sinks.register_evolving(spark, name, target)
    new = _reference(spark, sf).filter("region in ('asia', 'europe')")
    sinks.write_partitions(new, target, ["region"])
    sinks.register_evolving(spark, name, target)
    return spark.table(name).select("region", "id", "snippet_title", "balance", "pos")


@query
def overwrite_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Dynamic overwrite leaves other partitions alone, static overwrite does not."""
    counts = _counts(adapter.stats(spark, sf))
    some = counts.filter("category_id in ('1', '2')").withColumn("n", -F.col("n"))
    dynamic, static = scratch(spark), scratch(spark)
    for path, write in ((dynamic, sinks.write_partitions), (static, sinks.replace_dataset)):
        sinks.write_partitions(counts, path, _COUNT_KEYS)
        write(some, path, _COUNT_KEYS)
    read = spark.read.schema(_COUNT_SCHEMA)
    return read.parquet(dynamic).withColumn("mode", F.lit("dynamic")).unionByName(
        read.parquet(static).withColumn("mode", F.lit("static"))
    )


@query
def external_table(spark: SparkSession, sf: str) -> DataFrame:
    """A partitioned external table shows its rows once its partitions are repaired."""
    name, path = _name("stats"), scratch(spark)
    rows, by = ops.conform(adapter.stats(spark, sf), SILVER_STATS), ["region", "ingestion_date"]
    sinks.write_partitions(rows, path, by)
    sinks.create_table(spark, name, SILVER_STATS, path, by)
    before = spark.table(name).agg(F.count(F.lit(1)).alias("n")).first().n
    sinks.repair_table(spark, name)
    sinks.create_table(spark, name, SILVER_STATS, path, by)
    out = spark.table(name).groupBy("region", "ingestion_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("views").alias("views")
    )
    return plain(out.withColumn("rows_before_repair", F.lit(before)))


@query
def all_stats_view(spark: SparkSession, sf: str) -> DataFrame:
    """The stored view over history and current facts; two files of an hour keep their order in it."""
    stats = adapter.stats(spark, sf)
    current, path, old = _name("stats"), scratch(spark), scratch(spark)
    sinks.write_partitions(ops.conform(stats, SILVER_STATS), path, ["region", "ingestion_date"])
    sinks.create_table(spark, current, SILVER_STATS, path, ["region", "ingestion_date"])
    sinks.repair_table(spark, current)
    history = _name("history")
    flat = plans.silver_from_csv(plans.csv_to_rows(_with_file(adapter.flat_text(spark, sf))))
    sinks.replace_dataset(flat, old, ["region"])
    sinks.create_table(spark, history, SILVER_HISTORY, old, ["region"])
    sinks.repair_table(spark, history)
    view = _name("view")
    sinks.create_all_stats_view(spark, view, history, current)
    latest = plans.latest_snapshots(spark.table(view))
    return latest.filter("video_id like 'v%'")


@query
def guards(spark: SparkSession, sf: str) -> DataFrame:
    """Assertions over the tables: which of them stop a run, and what they say."""
    orders = adapter.table(spark, sf, "orders")
    twice = orders.select("o_orderkey", F.col("o_custkey").alias("o_orderkey"))
    checks = {
        "columns": lambda: ops.require_columns(orders, ["o_orderkey", "absent"]),
        "columns_present": lambda: ops.require_columns(orders, ["o_orderkey"]),
        "rows": lambda: ops.require_rows(orders.filter("o_orderkey < 0"), "orders"),
        "rows_present": lambda: ops.require_rows(orders, "orders"),
        "unique_columns": lambda: ops.require_unique_columns(twice),
        "unique_columns_present": lambda: ops.require_unique_columns(orders),
    }
    seen = []
    for name, check in checks.items():
        try:
            check()
            seen.append((name, "ok"))
        except ValueError as error:
            seen.append((name, str(error).split(";")[0]))
    shown = orders.agg(F.count(F.lit(1)).alias("orders"))
    outcome = F.explode(F.array(*[F.struct(F.lit(n).alias("guard"), F.lit(m).alias("says")) for n, m in seen]))
    sample = ops.preview(orders, 10).count()
    return shown.select("orders", outcome.alias("x")).select(
        "orders", F.col("x.guard").alias("guard"), F.col("x.says").alias("says"), F.lit(sample).alias("sampled")
    )


@query
def sampled_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a preview are rows of the table, each once."""
    orders = adapter.table(spark, sf, "orders")
    seen = ops.preview(orders, 10)
    found = seen.join(orders, orders.columns, "left_semi")
    return found.agg(F.count(F.lit(1)).alias("found"), F.countDistinct("o_orderkey").alias("orders"))


@query
def describe_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of the facts as a stage shows them: names, types, rows, and rows with a value."""
    return ops.describe_stage(adapter.stats(spark, sf).drop("event_id", "_source_file"))


@query
def describe_gold(spark: SparkSession, sf: str) -> DataFrame:
    """The same of the Gold tables after a run: every report's columns and row counts."""
    layout = plans.Layout(scratch(spark))
    stats = stage(ops.conform(adapter.stats(spark, sf), SILVER_STATS), layout.stats)
    names = sinks.register_tables(spark, plans.Layout(f"{layout.root}/tables"), _name("shown") + "_", repair=False)
    plans.silver_to_gold(stats, _reference(spark, sf), ops.latest_batch(stats), names)
    shown = [ops.describe_stage(spark.table(names[report])).withColumn("report", F.lit(report)) for report in GOLD]
    out = shown[0]
    for frame in shown[1:]:
        out = out.unionByName(frame)
    return out.select("report", "position", "column", "type", "filled", "rows")


@query
def gold_untouched(spark: SparkSession, sf: str) -> DataFrame:
    """After a run, one whose batch holds no facts: it stops, counts nothing and leaves the tables alone."""
    layout = plans.Layout(scratch(spark))
    stats = stage(ops.conform(adapter.stats(spark, sf), SILVER_STATS), layout.stats)
    tables = plans.Layout(f"{layout.root}/tables")
    names = sinks.register_tables(spark, tables, _name("untouched") + "_", repair=False)
    newest = ops.latest_batch(stats)
    for state in (None, layout.gold_state):
        plans.silver_to_gold(stats, _reference(spark, sf), newest, names, state=state)
        counts = plans.silver_to_gold(stats, _reference(spark, sf), Batch(newest.date, 99), names, state=state)
    return _long_form(spark, tables).groupBy("report").agg(
        F.count(F.lit(1)).alias("rows"), *[F.lit(n).cast("bigint").alias(name) for name, n in counts.items()]
    )


@query
def gold_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counts that a Gold run returns for the newest batch."""
    stats = stage(ops.conform(adapter.stats(spark, sf), SILVER_STATS), scratch(spark))
    names = sinks.register_tables(spark, plans.Layout(scratch(spark)), _name("counts") + "_")
    some = _reference(spark, sf).filter("id < '2'")
    counts = plans.silver_to_gold(stats, some, ops.latest_batch(stats), names)
    return stats.agg(F.count(F.lit(1)).alias("facts")).select(
        "facts", *[F.lit(n).cast("bigint").alias(name) for name, n in counts.items()]
    )


@query
def sql_over_views(spark: SparkSession, sf: str) -> DataFrame:
    """Plain SQL over the registered views."""
    stats = adapter.stats(spark, sf)
    sinks.register_views(stats, _reference(spark, sf), ops.latest_batch(stats))
    return spark.sql("""
        SELECT s.region, count(*) AS fact_rows, count(b.event_id) AS batch_rows,
               count(DISTINCT r.snippet_title) AS names
        FROM video_statistics s
        LEFT JOIN new_batch b ON b.event_id = s.event_id
        LEFT JOIN clean_reference_data r
          ON r.region = s.region AND r.id = CAST(s.category_id AS STRING)
        GROUP BY s.region""")


# --- The whole run ------------------------------------------------------------------------


def _column_or_null(df: DataFrame, name: str, kind: str):
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


_LONG = {
    "category_name": "string",
    "region": "string",
    "video_rank": "bigint",
    "video_id": "string",
    "title": "string",
    "views": "bigint",
    "video_count": "bigint",
    "total_views": "bigint",
    "total_likes": "bigint",
    "total_comments": "bigint",
    "engagement_rate": "double",
    "avg_views": "double",
    "avg_likes": "double",
    "avg_comments": "double",
}


def _long_form(spark: SparkSession, layout: plans.Layout) -> DataFrame:
    """The four Gold tables as one, with all their columns."""
    frames = []
    for name, (schema, _) in GOLD.items():
        df = spark.read.schema(schema).parquet(layout.gold(name))
        columns = [_column_or_null(df, c, kind) for c, kind in _LONG.items()]
        frames.append(df.select(F.lit(name).alias("report"), "category_id", *columns))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@query
def full_run(spark: SparkSession, sf: str) -> DataFrame:
    """Land every batch, load Silver, upsert the dimension, then run the newest batch to Gold."""
    layout = plans.Layout(scratch(spark))
    sinks.land_envelopes(
        adapter.fetched(spark, sf), layout.raw_stats, F.col("run"), adapter.SOURCE, run_id=F.col("run_id")
    )
    plans.bronze_json_to_silver(spark, layout.raw_stats, layout.stats, None)
    _land_reference(spark, sf, "customer", layout.raw_reference)
    plans.upsert_reference(spark, layout.raw_reference, layout.reference, _STAMP)
    plans.run_latest(spark, layout, prefix=_name("run") + "_")
    return _long_form(spark, layout)


@query
def gold_with_state(spark: SparkSession, sf: str) -> DataFrame:
    """The two newest batches run one after the other with stored state, the last of them twice; what they
    leave for the categories of the newest batch."""
    layout = plans.Layout(scratch(spark))
    stats = stage(ops.conform(adapter.stats(spark, sf), SILVER_STATS), layout.stats)
    names = sinks.register_tables(spark, plans.Layout(f"{layout.root}/tables"), _name("state") + "_", repair=False)
    newest = stats.select("ingestion_date", "ingestion_hour").distinct().orderBy(F.desc("ingestion_date"), F.desc("ingestion_hour"))
    batches = [Batch(*row) for row in newest.limit(2).collect()]
    for batch in [*reversed(batches), batches[0]]:
        later = (F.col("ingestion_date") > F.lit(batch.date)) | (
            (F.col("ingestion_date") == F.lit(batch.date)) & (F.col("ingestion_hour") > batch.hour)
        )
        plans.silver_to_gold(stats.filter(~later), _reference(spark, sf), batch, names, state=layout.gold_state)
    affected = ops.affected_keys(ops.batch_slice(stats, batches[0]), ["region", "category_id"])
    long = _long_form(spark, plans.Layout(f"{layout.root}/tables"))
    pairs = affected.select("region", F.col("category_id").cast("string").alias("category_id"))
    regional = F.col("report") == "category_region"
    return long.filter(~regional).join(pairs.select("category_id").distinct(), "category_id", "left_semi").unionByName(
        long.filter(regional).join(pairs, ["region", "category_id"], "left_semi"), allowMissingColumns=True
    )
