"""Maps the given tables to the engine's domain.

events, region   -> video statistics: snapshots, and envelopes of at most 50 items
customer, region -> incoming reference rows;  supplier, region -> stored reference rows
orders, region   -> flat CSV history

Odd values (blank keys, padded text, unreadable numbers) are made from row ids in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# 250 consecutive events spread over 5 regions: at most 50 items per envelope.
CHUNK = 250
REGIONS = 5
SOURCE = "sample"


# Columns of the given tables: reading them from the file footers would cost a job per table.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _with_region(spark: SparkSession, sf: str, df: DataFrame, key: str) -> DataFrame:
    region = table(spark, sf, "region").select("r_regionkey", F.lower("r_name").alias("region"))
    number = (F.col(key) % REGIONS).cast("int")
    return df.join(region, number == F.col("r_regionkey")).drop("r_regionkey")


def _padded(value: Column | str, width: int = 20) -> Column:
    return F.lpad(F.col(value).cast("string") if isinstance(value, str) else value, width, "0")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return _with_region(spark, sf, events.drop("props"), "event_id")


def _category() -> Column:
    moved = F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    return ((F.col("user_id") + moved) % 27).cast("int")


def stats(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots: one per event. A video changes category now and then."""
    rows = _events(spark, sf)
    user = F.col("user_id").cast("string")
    return rows.select(
        F.concat(F.lit("v"), user).alias("video_id"),
        F.concat_ws(" ", F.lit("title"), user, F.col("event_id").cast("string")).alias("title"),
        _category().alias("category_id"),
        F.floor(F.col("value") * 100).cast("bigint").alias("views"),
        F.when(F.col("event_type") != "signup", F.col("k")).alias("likes"),
        (F.col("k") % 7).alias("comment_count"),
        "region",
        F.to_date("ts").alias("ingestion_date"),
        F.hour("ts").alias("ingestion_hour"),
        _padded("event_id").alias("_source_file"),
        "event_id",
    )


def raw_items(spark: SparkSession, sf: str) -> DataFrame:
    """Fetched items before grouping, as text; ``chunk`` is the run that fetched them."""
    rows = _events(spark, sf)
    event, user = F.col("event_id"), F.col("user_id").cast("string")
    video = F.concat(F.lit("v"), user)
    return rows.select(
        "region",
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("instant"),
        F.floor(event / CHUNK).cast("bigint").alias("chunk"),
        F.struct(
            "event_id",
            F.when(event % 97 == 0, F.lit("  "))
            .when(event % 13 == 0, F.concat(F.lit(" "), video, F.lit(" ")))
            .otherwise(video)
            .alias("id"),
            F.struct(
                F.concat(F.lit('title "'), event.cast("string"), F.lit('", é')).alias("title"),
                F.col("event_type").alias("channelTitle"),
                F.when(event % 37 == 0, F.lit("x"))
                .otherwise(_category().cast("string"))
                .alias("categoryId"),
                F.when(event % 31 == 0, F.lit("not a time"))
                .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
                .alias("publishedAt"),
                F.when(
                    F.col("event_type") != "signup",
                    F.array(F.concat(F.lit("k"), F.col("k").cast("string")), F.col("event_type")),
                ).alias("tags"),
                F.when(event % 2 == 0, F.concat(F.lit("about "), video)).alias("description"),
                F.struct(
                    F.struct(F.concat(F.lit("http://img/"), event.cast("string")).alias("url"))
                    .alias("default")
                ).alias("thumbnails"),
            ).alias("snippet"),
            F.struct(
                F.when(event % 41 == 0, F.lit("1.5"))
                .otherwise(F.floor(F.col("value") * 100).cast("string"))
                .alias("viewCount"),
                F.when(F.col("event_type") != "signup", F.col("k").cast("string")).alias("likeCount"),
                F.when(event % 3 == 0, F.lit(" 7 ")).alias("dislikeCount"),
                (F.col("k") % 7).cast("string").alias("commentCount"),
            ).alias("statistics"),
        ).alias("item"),
    )


def fetched(spark: SparkSession, sf: str) -> DataFrame:
    """Envelopes as fetched: one row per region and chunk, at most 50 items each.

    The clock of a run is that of its first item.
    """
    first = F.min("instant")
    run_id = F.concat_ws(
        "_", F.regexp_replace(F.replace(first, F.lit("T"), F.lit("_")), "[-:Z]", ""),
        _padded(F.col("chunk").cast("string"), 12),
    )
    items = F.transform(
        F.array_sort(F.collect_list("item")),
        lambda item: F.struct(*[item[c].alias(c) for c in ("id", "snippet", "statistics")]),
    )
    return (
        raw_items(spark, sf)
        .groupBy("region", "chunk")
        .agg(items.alias("items"), F.to_timestamp(first).alias("run"), run_id.alias("run_id"))
        .withColumn("kind", F.lit("sample#list"))
        .withColumn("etag", F.col("run_id"))
    )


def reference_rows(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Reference rows with repeats per (region, id), ordered by ``pos``."""
    prefix = {"customer": "c", "supplier": "s"}[name]
    key = {"customer": "c_custkey", "supplier": "s_suppkey"}[name]
    rows = _with_region(spark, sf, table(spark, sf, name), key)
    return rows.select(
        "region",
        F.col(f"{prefix}_nationkey").cast("string").alias("id"),
        F.col(f"{prefix}_name").alias("snippet_title"),
        F.col(f"{prefix}_acctbal").alias("balance"),
        F.col(key).alias("pos"),
    )


def reference_documents(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Category envelopes of at most 50 items, to be landed; ``run_id`` orders them."""
    rows = reference_rows(spark, sf, name)
    chunk = F.floor(F.col("pos") / CHUNK).cast("bigint")
    item = F.struct(
        "pos",
        "id",
        F.struct(
            F.col("snippet_title").alias("title"), F.col("balance").cast("string").alias("channelId")
        ).alias("snippet"),
    )
    items = F.transform(
        F.array_sort(F.collect_list(item)),
        lambda i: F.struct(i["id"].alias("id"), i["snippet"].alias("snippet")),
    )
    return (
        rows.groupBy("region", chunk.alias("chunk"))
        .agg(items.alias("items"))
        .withColumn("run_id", F.concat(F.lit("20240101_000000_"), _padded(F.col("chunk").cast("string"), 12)))
        .drop("chunk")
    )


def flat_text(spark: SparkSession, sf: str) -> DataFrame:
    """Flat history records, all text, with commas, quotes and line breaks in the titles."""
    rows = _with_region(spark, sf, table(spark, sf, "orders"), "o_custkey")
    order, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    video = F.concat(F.lit("o"), customer)
    return rows.select(
        F.when(order % 89 == 0, F.lit(" "))
        .when(order % 17 == 0, F.concat(F.lit(" "), video, F.lit(" ")))
        .otherwise(video)
        .alias("video_id"),
        F.when(order % 53 == 0, F.lit("99.99.99"))
        .otherwise(F.date_format("o_orderdate", "yy.dd.MM"))
        .alias("trending_date"),
        F.concat(
            F.lit("order "), _padded("o_orderkey"), F.lit(', "'), F.col("o_orderstatus"), F.lit('"\nline two')
        ).alias("title"),
        F.col("o_orderpriority").alias("channel_title"),
        F.when(order % 61 == 0, F.lit("n/a"))
        .otherwise((F.col("o_custkey") % 30).cast("string"))
        .alias("category_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("publish_time"),
        F.lit("a|b").alias("tags"),
        F.floor("o_totalprice").cast("string").alias("views"),
        (order % 100).cast("string").alias("likes"),
        F.lit("1e3").alias("dislikes"),
        F.concat(F.lit(" "), (order % 9).cast("string"), F.lit(" ")).alias("comment_count"),
        F.concat(F.lit("http://img/"), order.cast("string")).alias("thumbnail_link"),
        F.when(F.col("o_orderstatus") == "F", F.lit("True"))
        .when(F.col("o_orderstatus") == "O", F.lit("FALSE"))
        .otherwise(F.lit("maybe"))
        .alias("comments_disabled"),
        F.lit("no").alias("ratings_disabled"),
        F.lit(None).cast("string").alias("video_error_or_removed"),
        F.when(order % 2 == 0, F.lit("about, it")).alias("description"),
        "region",
    )
