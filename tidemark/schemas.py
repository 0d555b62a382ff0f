"""Column contracts of every layer.

These are fixed values: names, types and order of stored tables and documents, which other systems read.
Each contract is a plain ``StructType``; readers pass it to Spark so that no layer except the
evolving reference data depends on inference.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _columns(**types: str) -> T.StructType:
    out = T.StructType()
    for name, kind in types.items():
        out.add(name, kind)
    return out


# --- Bronze -------------------------------------------------------------------------------

ENVELOPE_METADATA = _columns(
    ingestion_id="string",
    region="string",
    ingestion_timestamp="string",
    video_count="integer",
    source="string",
)

ITEM = (
    T.StructType()
    .add("id", "string")
    .add(
        "snippet",
        T.StructType()
        .add("title", "string")
        .add("channelTitle", "string")
        .add("categoryId", "string")
        .add("publishedAt", "string")
        .add("tags", T.ArrayType(T.StringType()))
        .add("description", "string")
        .add("thumbnails", T.StructType().add("default", _columns(url="string"))),
    )
    .add(
        "statistics",
        _columns(
            viewCount="string",
            likeCount="string",
            dislikeCount="string",
            commentCount="string",
        ),
    )
)

ENVELOPE = (
    T.StructType()
    .add("kind", "string")
    .add("etag", "string")
    .add("items", T.ArrayType(ITEM))
    .add("_pipeline_metadata", ENVELOPE_METADATA)
)

CORRUPT = "_corrupt_record"

# What could not be read, by the batch it came with.
QUARANTINE = (
    _columns(_source_file="string", reason="string", content="string", region="string")
    .add("ingestion_date", "date")
    .add("ingestion_hour", "integer")
)

BRONZE_CSV = _columns(
    video_id="string",
    trending_date="string",
    title="string",
    channel_title="string",
    category_id="string",
    publish_time="string",
    tags="string",
    views="string",
    likes="string",
    dislikes="string",
    comment_count="string",
    thumbnail_link="string",
    comments_disabled="string",
    ratings_disabled="string",
    video_error_or_removed="string",
    description="string",
)

# --- Silver -------------------------------------------------------------------------------

_STATS = dict(
    video_id="string",
    title="string",
    channel_title="string",
    trending_date="date",
    category_id="integer",
    publish_time="timestamp",
    tags="string",
    views="long",
    likes="long",
    dislikes="long",
    comment_count="long",
    thumbnail_link="string",
    comments_disabled="boolean",
    ratings_disabled="boolean",
    video_error_or_removed="boolean",
    description="string",
)

BATCH = ["ingestion_date", "ingestion_hour"]

SILVER_STATS = _columns(
    **_STATS,
    _source_file="string",
    region="string",
    ingestion_date="date",
    ingestion_hour="integer",
)
SILVER_STATS_PARTITIONS = ["region", *BATCH]

SILVER_HISTORY = _columns(**_STATS, _source_file="string", region="string")
SILVER_HISTORY_PARTITIONS = ["region"]

# Columns of the view over history and current facts, in order.
ALL_STATS = _columns(
    **_STATS, _source_file="string", region="string", ingestion_date="date", ingestion_hour="integer"
)

# Only the fixed part: reference data may carry any further flattened column.
REFERENCE_KEYS = ["region", "id"]
REFERENCE_REQUIRED = ["id", "snippet_title"]
REFERENCE_PARTITIONS = ["region"]
REFERENCE = _columns(
    id="string",
    snippet_title="string",
    ingestion_timestamp="string",
    source_file="string",
    region="string",
)

# --- Gold ---------------------------------------------------------------------------------

GOLD_CATEGORY_ENGAGEMENT = _columns(
    category_name="string",
    total_views="long",
    total_likes="long",
    total_comments="long",
    engagement_rate="double",
    category_id="string",
)

GOLD_CATEGORY_PERFORMANCE = _columns(
    category_name="string",
    video_count="long",
    total_views="long",
    avg_views="double",
    total_likes="long",
    avg_likes="double",
    total_comments="long",
    avg_comments="double",
    category_id="string",
)

GOLD_CATEGORY_REGION = _columns(
    category_name="string",
    video_count="long",
    total_views="long",
    avg_views="double",
    total_likes="long",
    total_comments="long",
    region="string",
    category_id="string",
)

GOLD_VIDEO_RANKINGS = _columns(
    video_id="string",
    title="string",
    category_name="string",
    region="string",
    views="long",
    video_rank="long",
    category_id="string",
)

# table name -> (columns, partition columns)
GOLD = {
    "category_engagement": (GOLD_CATEGORY_ENGAGEMENT, ["category_id"]),
    "category_performance": (GOLD_CATEGORY_PERFORMANCE, ["category_id"]),
    "category_region": (GOLD_CATEGORY_REGION, ["region", "category_id"]),
    "video_rankings": (GOLD_VIDEO_RANKINGS, ["category_id"]),
}
