"""The same results in SQL over the same tables, for DuckDB."""

from __future__ import annotations

STATS = """
stats AS (
  SELECT 'v' || user_id AS video_id,
         'title ' || user_id || ' ' || event_id AS title,
         CAST((user_id + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) % 27 AS INTEGER) AS category_id,
         CAST(floor(value * 100) AS BIGINT) AS views,
         CASE WHEN event_type <> 'signup' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS likes,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS comment_count,
         lower(r_name) AS region,
         CAST(ts AS DATE) AS ingestion_date,
         CAST(hour(ts) AS INTEGER) AS ingestion_hour,
         event_id
  FROM events JOIN region ON r_regionkey = event_id % 5
),
newest AS (
  SELECT ingestion_date, ingestion_hour FROM stats
  ORDER BY ingestion_date DESC, ingestion_hour DESC LIMIT 1
),
batch AS (SELECT * FROM stats SEMI JOIN newest USING (ingestion_date, ingestion_hour)),
affected AS (SELECT DISTINCT category_id FROM batch WHERE category_id IS NOT NULL),
pairs AS (SELECT DISTINCT region, category_id FROM batch WHERE category_id IS NOT NULL AND region IS NOT NULL),
latest AS (
  SELECT video_id, region, title, category_id, views, likes, comment_count FROM stats
  QUALIFY row_number() OVER (
    PARTITION BY video_id, region
    ORDER BY ingestion_date DESC, ingestion_hour DESC, event_id DESC) = 1
)"""

REFERENCE = """
customer_ref AS (
  SELECT lower(r_name) AS region, CAST(c_nationkey AS VARCHAR) AS id, c_name AS snippet_title,
         c_acctbal AS balance, c_custkey AS pos
  FROM customer JOIN region ON r_regionkey = c_custkey % 5
),
supplier_ref AS (
  SELECT lower(r_name) AS region, CAST(s_nationkey AS VARCHAR) AS id, s_name AS snippet_title,
         s_acctbal AS balance, s_suppkey AS pos
  FROM supplier JOIN region ON r_regionkey = s_suppkey % 5
),
reference AS (
  SELECT * FROM customer_ref
  QUALIFY row_number() OVER (PARTITION BY region, id ORDER BY pos DESC) = 1
),
dim AS (
  SELECT id AS category_id, snippet_title AS category_name FROM reference
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY region) = 1
)"""

# Fetched items before and after shaping. A run fetches 250 events, at the clock of the first one.
ITEMS = """
runs AS (
  SELECT event_id % 5 AS r_regionkey, event_id // 250 AS chunk, date_trunc('second', min(ts)) AS run
  FROM events GROUP BY 1, 2
),
raw AS (
  SELECT lower(r_name) AS region, event_id, chunk, run,
         CAST(run AS DATE) AS ingestion_date, CAST(hour(run) AS INTEGER) AS ingestion_hour,
         strftime(run, '%Y%m%d_%H%M%S') || '_' || lpad(CAST(chunk AS VARCHAR), 12, '0') AS run_id,
         CASE WHEN event_id % 97 = 0 THEN '  '
              WHEN event_id % 13 = 0 THEN ' v' || user_id || ' '
              ELSE 'v' || user_id END AS raw_id,
         'title "' || event_id || '", é' AS title,
         event_type AS channel_title,
         CASE WHEN event_id % 37 <> 0 THEN
           CAST((user_id + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) % 27 AS INTEGER) END AS category_id,
         CASE WHEN event_id % 31 <> 0 THEN date_trunc('second', ts) END AS publish_time,
         CASE WHEN event_type <> 'signup'
              THEN '["k' || json_extract_string(props, '$.k') || '","' || event_type || '"]' END AS tags,
         CASE WHEN event_id % 41 <> 0 THEN CAST(floor(value * 100) AS BIGINT) END AS views,
         CASE WHEN event_type <> 'signup' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS likes,
         CASE WHEN event_id % 3 = 0 THEN CAST(7 AS BIGINT) END AS dislikes,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS comment_count,
         'http://img/' || event_id AS thumbnail_link,
         CASE WHEN event_id % 2 = 0 THEN 'about v' || user_id END AS description
  FROM events JOIN region ON r_regionkey = event_id % 5
  JOIN runs ON runs.r_regionkey = event_id % 5 AND chunk = event_id // 250
),
silver AS (
  SELECT trim(raw_id) AS video_id, * EXCLUDE (raw_id) FROM raw WHERE trim(raw_id) <> ''
  QUALIFY row_number() OVER (
    PARTITION BY trim(raw_id), region, ingestion_date, ingestion_hour, chunk ORDER BY event_id) = 1
)"""

SILVER_COLUMNS = """
  video_id, title, channel_title, CAST(NULL AS VARCHAR) AS trending_date, category_id,
  strftime(publish_time, '%Y-%m-%d %H:%M:%S') AS publish_time, tags, views, likes, dislikes,
  comment_count, thumbnail_link, CAST(NULL AS BOOLEAN) AS comments_disabled,
  CAST(NULL AS BOOLEAN) AS ratings_disabled, CAST(NULL AS BOOLEAN) AS video_error_or_removed,
  description, region, CAST(ingestion_date AS VARCHAR) AS ingestion_date, ingestion_hour"""

# Two-digit years are read as 20xx.
FLAT = """
flat AS (
  SELECT o_orderkey, trim(CASE WHEN o_orderkey % 89 = 0 THEN ' ' ELSE 'o' || o_custkey END) AS video_id,
         'order ' || lpad(CAST(o_orderkey AS VARCHAR), 20, '0') || ', "' || o_orderstatus || '"' || chr(10) || 'line two' AS title,
         o_orderpriority AS channel_title,
         CASE WHEN o_orderkey % 53 <> 0 THEN CAST(
           CASE WHEN year(o_orderdate) < 2000 THEN o_orderdate + INTERVAL 100 YEAR ELSE o_orderdate END AS DATE) END AS trending_date,
         CASE WHEN o_orderkey % 61 <> 0 THEN CAST(o_custkey % 30 AS INTEGER) END AS category_id,
         o_orderdate AS publish_time, 'a|b' AS tags,
         CAST(floor(o_totalprice) AS BIGINT) AS views, o_orderkey % 100 AS likes,
         CAST(NULL AS BIGINT) AS dislikes, o_orderkey % 9 AS comment_count,
         'http://img/' || o_orderkey AS thumbnail_link,
         CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS comments_disabled,
         false AS ratings_disabled, CAST(NULL AS BOOLEAN) AS video_error_or_removed,
         CASE WHEN o_orderkey % 2 = 0 THEN 'about, it' END AS description,
         lower(r_name) AS region
  FROM orders JOIN region ON r_regionkey = o_custkey % 5
)"""


def _rate(part: str, whole: str) -> str:
    """Percentage to two places, half up, in exact integer arithmetic."""
    p, w = f"CAST({part} AS HUGEINT)", f"CAST({whole} AS HUGEINT)"
    return f"CASE WHEN {w} <> 0 THEN (({p} * 20000 + {w}) // (2 * {w})) / 100.0 END"


def _engagement(source: str, restrict: str = "") -> str:
    return f"""
  SELECT category_name, total_views, total_likes, total_comments,
         {_rate('total_likes + total_comments', 'total_views')} AS engagement_rate,
         dim.category_id
  FROM (SELECT category_id, CAST(sum(views) AS BIGINT) AS total_views,
               CAST(sum(likes) AS BIGINT) AS total_likes,
               CAST(sum(comment_count) AS BIGINT) AS total_comments
        FROM {source} {restrict} GROUP BY category_id) s
  JOIN dim ON dim.category_id = CAST(s.category_id AS VARCHAR)"""


def _performance(restrict: str) -> str:
    return f"""
  SELECT category_name, count(video_id) AS video_count,
         CAST(sum(views) AS BIGINT) AS total_views, avg(views) AS avg_views,
         CAST(sum(likes) AS BIGINT) AS total_likes, avg(likes) AS avg_likes,
         CAST(sum(comment_count) AS BIGINT) AS total_comments, avg(comment_count) AS avg_comments,
         dim.category_id
  FROM latest JOIN dim ON dim.category_id = CAST(latest.category_id AS VARCHAR)
  {restrict} GROUP BY dim.category_id, category_name"""


def _region(restrict: str) -> str:
    return f"""
  SELECT category_name, count(video_id) AS video_count,
         CAST(sum(views) AS BIGINT) AS total_views, avg(views) AS avg_views,
         CAST(sum(likes) AS BIGINT) AS total_likes, CAST(sum(comment_count) AS BIGINT) AS total_comments,
         region, dim.category_id
  FROM latest JOIN dim ON dim.category_id = CAST(latest.category_id AS VARCHAR)
  {restrict} GROUP BY region, dim.category_id, category_name"""


def _rankings(restrict: str, k: int) -> str:
    return f"""
  SELECT video_id, title, category_name, region, views,
         row_number() OVER (PARTITION BY latest.category_id
           ORDER BY views DESC NULLS LAST, video_id, region) AS video_rank,
         dim.category_id
  FROM latest JOIN dim ON dim.category_id = CAST(latest.category_id AS VARCHAR)
  {restrict} QUALIFY video_rank <= {k}"""


_IN_CATEGORIES = "WHERE latest.category_id IN (SELECT category_id FROM affected)"
_IN_PAIRS = "WHERE (latest.region, latest.category_id) IN (SELECT (region, category_id) FROM pairs)"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_GOLD = _with(STATS, REFERENCE)

# Envelope outcomes of the damaged landing zone: chunk % 7 = 3 is unreadable, 5 is empty.
_REPORT = f"""
report AS (
  SELECT run_id, region,
         CASE WHEN chunk % 7 IN (3, 5) THEN 0 ELSE count(*) END AS incoming_rows,
         CASE WHEN chunk % 7 IN (3, 5) THEN 0
              ELSE count(DISTINCT CASE WHEN trim(raw_id) <> '' THEN trim(raw_id) END) END AS final_rows,
         CASE chunk % 7 WHEN 3 THEN 'unreadable document' WHEN 5 THEN 'no items' END AS error
  FROM raw GROUP BY run_id, region, chunk
)"""

_UPSERTED = """
  SELECT region, id, snippet_title, balance, pos FROM (
    SELECT *, 1 AS newer FROM customer_ref
    UNION ALL BY NAME
    SELECT region, id, snippet_title, pos, 0 AS newer FROM supplier_ref)
  QUALIFY row_number() OVER (PARTITION BY region, id ORDER BY newer DESC, pos DESC) = 1"""

_DIMENSION = """
  SELECT region, id, snippet_title, balance_text AS snippet_channelid,
         '2024-01-01T00:00:00.000000+00:00' AS ingestion_timestamp
  FROM (
    SELECT region, id, snippet_title, CAST(balance AS VARCHAR) AS balance_text, pos, 1 AS newer FROM customer_ref
    UNION ALL
    SELECT region, id, snippet_title, CAST(balance AS VARCHAR), pos, 0 FROM supplier_ref)
  QUALIFY row_number() OVER (PARTITION BY region, id ORDER BY newer DESC, pos DESC) = 1"""

_LONG = """SELECT 'category_engagement' AS report, category_id, category_name, CAST(NULL AS VARCHAR) AS region,
       CAST(NULL AS BIGINT) AS video_rank, CAST(NULL AS VARCHAR) AS video_id, CAST(NULL AS VARCHAR) AS title,
       CAST(NULL AS BIGINT) AS views, CAST(NULL AS BIGINT) AS video_count, total_views, total_likes, total_comments,
       CAST(engagement_rate AS DOUBLE) AS engagement_rate, CAST(NULL AS DOUBLE) AS avg_views,
       CAST(NULL AS DOUBLE) AS avg_likes, CAST(NULL AS DOUBLE) AS avg_comments FROM engagement
UNION ALL SELECT 'category_performance', category_id, category_name, NULL, NULL, NULL, NULL, NULL, video_count, total_views,
       total_likes, total_comments, NULL, avg_views, avg_likes, avg_comments FROM performance
UNION ALL SELECT 'category_region', category_id, category_name, region, NULL, NULL, NULL, NULL, video_count, total_views,
       total_likes, total_comments, NULL, avg_views, NULL, NULL FROM regional
UNION ALL SELECT 'video_rankings', category_id, category_name, region, video_rank, video_id, title, views, NULL, NULL, NULL,
       NULL, NULL, NULL, NULL, NULL FROM rankings"""

_STAMPED = "'2024-01-01T00:00:00.000000+00:00'"

_NAMED = f""" SELECT region, id, snippet_title, CAST(balance AS VARCHAR) AS snippet_channelid, {_STAMPED} AS ingestion_timestamp,
         CAST(NULL AS BIGINT) AS a_b, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS VARCHAR) AS listed FROM reference
  UNION ALL SELECT 'named', 'n' || s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'second' ELSE 'low' END,
         NULL, {_STAMPED}, s_suppkey, 'f' || s_suppkey, '[1,2]' FROM supplier"""

# The four reports of a run for the newest batch.
_RUN = (
    _GOLD
    + ", engagement AS ("
    + _engagement("stats", "WHERE category_id IN (SELECT category_id FROM affected)")
    + f"), performance AS ({_performance(_IN_CATEGORIES)}), regional AS ({_region(_IN_PAIRS)}), "
    + f"rankings AS ({_rankings(_IN_CATEGORIES, 3)}) "
)


def _described(table: str, columns: str) -> str:
    """A row per column: position, name, type, values and rows."""
    named = [c.split() for c in columns.split(", ")]
    return " UNION ALL ".join(
        f"""SELECT {i} AS position, '{name}' AS "column", '{kind}' AS type, count({name}) AS filled, count(*) AS rows FROM {table}"""
        for i, (name, kind) in enumerate(named)
    )


ORACLE: dict[str, str] = {
    "category_engagement": _GOLD
    + _engagement("stats", "WHERE category_id IN (SELECT category_id FROM affected)"),
    "category_engagement_latest": _GOLD + _engagement("latest"),
    "category_performance": _GOLD + _performance(_IN_CATEGORIES),
    "category_region": _GOLD + _region(_IN_PAIRS),
    "category_region_all": _GOLD + _region(""),
    "video_rankings": _GOLD + _rankings(_IN_CATEGORIES, 3),
    "video_rankings_all": _GOLD + _rankings("", 5),
    "latest_batch": _with(STATS)
    + " SELECT CAST(ingestion_date AS VARCHAR) AS ingestion_date, ingestion_hour FROM newest",
    "batch_rows": _with(STATS)
    + " SELECT * REPLACE (CAST(ingestion_date AS VARCHAR) AS ingestion_date) FROM batch",
    "affected_categories": _with(STATS) + " SELECT * FROM affected",
    "affected_category_regions": _with(STATS) + " SELECT * FROM pairs",
    "affected_with_previous": _with(STATS)
    + """ SELECT DISTINCT category_id FROM stats
          WHERE (video_id, region) IN (SELECT (video_id, region) FROM batch)""",
    "restrict_facts": _with(STATS) + f" SELECT * FROM latest {_IN_PAIRS}",
    "restricted_latest": _with(STATS) + f" SELECT * FROM latest {_IN_CATEGORIES}",
    "facts_with_names": _GOLD
    + """ SELECT event_id, video_id, dim.category_id, category_name
          FROM stats JOIN dim ON dim.category_id = CAST(stats.category_id AS VARCHAR)""",
    "facts_without_names": _GOLD
    + """ SELECT CAST(category_id AS VARCHAR) AS category_id, count(*) AS fact_rows FROM stats
          WHERE CAST(category_id AS VARCHAR) NOT IN (SELECT category_id FROM dim) GROUP BY 1""",
    "latest_snapshot": _with(STATS) + " SELECT * FROM latest",
    "canonical_categories": _with(REFERENCE) + " SELECT * FROM dim",
    "dedupe_snapshots": _with(STATS)
    + """ SELECT video_id, region, CAST(ingestion_date AS VARCHAR) AS ingestion_date, event_id, views FROM stats
          QUALIFY row_number() OVER (PARTITION BY video_id, region, stats.ingestion_date ORDER BY event_id) = 1""",
    "keep_last_reference": _with(REFERENCE) + " SELECT * FROM reference",
    "top_videos_per_region": _with(STATS)
    + """ SELECT region, event_id, views,
                 row_number() OVER (PARTITION BY region ORDER BY views DESC NULLS LAST, event_id) AS view_rank
          FROM stats QUALIFY view_rank <= 1500""",
    "upsert_reference": _with(REFERENCE) + _UPSERTED,
    "concat_evolving": """
        SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier
        UNION ALL SELECT 'c' || c_custkey, NULL, c_mktsegment FROM customer""",
    "union_history": _with(STATS, FLAT)
    + """ SELECT region, has_batch, count(*) AS n, CAST(sum(views) AS BIGINT) AS views,
                 count(trending_date) AS with_trending_date
          FROM (SELECT region, false AS has_batch, views, trending_date FROM flat
                UNION ALL SELECT region, true, views, NULL FROM stats) GROUP BY region, has_batch""",
    "latest_over_history": _with(STATS)
    + """ SELECT video_id, region, title, category_id, views, likes, comment_count FROM stats
          QUALIFY row_number() OVER (
            PARTITION BY video_id, region
            ORDER BY CASE WHEN event_id % 2 = 1 THEN ingestion_date END DESC NULLS LAST,
                     CASE WHEN event_id % 2 = 1 THEN ingestion_hour END DESC NULLS LAST,
                     event_id DESC) = 1""",
    "performance_over_history": _with(
        STATS.replace("latest AS (", "latest_stats AS ("),
        FLAT,
        REFERENCE,
        """
latest AS (
  SELECT * FROM (
    SELECT video_id, region, title, category_id, views, likes, comment_count,
           CAST(NULL AS DATE) AS trending_date, ingestion_date, ingestion_hour FROM stats
    UNION ALL
    SELECT video_id, region, title, category_id, views, likes, comment_count, trending_date, NULL, NULL FROM flat)
  QUALIFY row_number() OVER (
    PARTITION BY video_id, region
    ORDER BY ingestion_date DESC NULLS LAST, ingestion_hour DESC NULLS LAST,
             trending_date DESC NULLS LAST, title DESC) = 1
)""",
    )
    + _performance(""),
    "json_extract_cast": _with(ITEMS)
    + """ SELECT event_id, raw_id AS video_id, category_id, tags, thumbnail_link AS url, views, dislikes,
                 description FROM raw""",
    "flatten_normalize": """
        SELECT p_partkey AS id, p_brand AS snippet_channelid, p_type AS snippet_inner_weird_type_name,
               p_size AS size_cm,
               CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'alt ' || p_name END AS snippet_title
        FROM part""",
    "flatten_normalize_names": """
        SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS x_y,
               CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'alt ' || p_name END AS snippet_title,
               p_type AS snippet_a_b_we_ird_name
        FROM part""",
    "safe_parse_dates": _with(FLAT)
    + """ SELECT title, CAST(trending_date AS VARCHAR) AS trending_date,
                 strftime(publish_time, '%Y-%m-%d %H:%M:%S') AS publish_time,
                 CASE WHEN likes % 2 = 0 THEN strftime(publish_time, '%Y-%m-%d %H:%M:%S') END AS other_format FROM flat""",
    "safe_cast_flags": """
        SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS flag, count(*) AS n
        FROM lineitem GROUP BY 1, 2""",
    "safe_cast_numbers": """
        SELECT l_returnflag, CAST(sum(l_orderkey) AS BIGINT) AS keys, CAST(sum(l_linenumber) AS BIGINT) AS lines,
               CAST(sum(l_linenumber) FILTER (WHERE l_linenumber % 2 = 0) AS BIGINT) AS exponents,
               CAST(sum(l_linenumber) FILTER (WHERE l_linenumber % 2 = 0) AS BIGINT) AS fractions,
               count(*) FILTER (WHERE l_linenumber % 2 = 0) AS blanks,
               CAST(sum(l_linenumber) FILTER (WHERE l_linenumber % 2 = 0) AS BIGINT) AS overflows
        FROM lineitem GROUP BY 1""",
    "nonblank_keys": _with(ITEMS)
    + " SELECT event_id, raw_id AS id, region FROM raw WHERE trim(raw_id) <> '' AND event_id % 7 <> 0",
    "region_from_path_segments": """
        SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN split_part(url, '/', 4) ELSE '' END AS region,
               CASE WHEN page_id % 3 <> 0 AND split_part(url, '/', 4) <> '' THEN split_part(url, '/', 4)
                    ELSE 'unknown' END AS region_or_default
        FROM pages""",
    "decode_keys": """
        SELECT page_id, url_decode(replace(
          replace(replace(replace(replace(url, '/', '%2F'), '?', '%3F'), '=', '%3D'), '&', '%26') || '+end',
          '+', '%20')) AS key FROM pages""",
    "region_allow_list": _with(ITEMS)
    + """ SELECT region, count(DISTINCT chunk) AS envelopes, count(*) AS items
          FROM raw WHERE region IN ('asia', 'europe') GROUP BY region""",
    "envelope_metadata": _with(ITEMS)
    + """ SELECT run_id AS ingestion_id, region,
                 strftime(run, '%Y-%m-%dT%H:%M:%S.000000+00:00') AS ingestion_timestamp,
                 CAST(count(*) AS INTEGER) AS video_count, 'sample' AS source
          FROM raw GROUP BY run_id, region, run""",
    "envelope_roundtrip": _with(ITEMS)
    + """ SELECT region, CAST(ingestion_date AS VARCHAR) AS ingestion_date, ingestion_hour, trim(raw_id) AS video_id,
                 title, CAST(row_number() OVER (PARTITION BY region, run_id ORDER BY event_id) - 1 AS INTEGER) AS _pos
          FROM raw""",
    "discover_batch": _with(ITEMS)
    + """ SELECT CAST(ingestion_date AS VARCHAR) AS ingestion_date, ingestion_hour,
                 (SELECT count(DISTINCT (region, chunk)) FROM raw) AS files FROM raw
          ORDER BY raw.ingestion_date DESC, ingestion_hour DESC LIMIT 1""",
    "silver_json": _with(ITEMS) + f" SELECT {SILVER_COLUMNS} FROM silver",
    "silver_json_damaged": _with(ITEMS) + f" SELECT {SILVER_COLUMNS} FROM silver WHERE chunk % 7 <> 6",
    "silver_quarantine": _with(ITEMS)
    + """ SELECT region, CASE WHEN chunk % 7 = 6 THEN 'unreadable document' ELSE 'item is no object' END AS reason,
                 count(DISTINCT chunk) AS n FROM raw WHERE chunk % 7 = 6 OR chunk % 3 = 1 GROUP BY 1, 2""",
    "quarantine_repaired": _with(ITEMS)
    + """ , bad AS (SELECT * FROM raw WHERE chunk % 7 = 6 OR chunk % 3 = 1)
          SELECT region, CASE WHEN chunk % 7 = 6 THEN 'unreadable document' ELSE 'item is no object' END AS reason,
                 count(DISTINCT chunk) AS n FROM bad
          WHERE (bad.ingestion_date, ingestion_hour) <> (SELECT max((ingestion_date, ingestion_hour)) FROM bad) GROUP BY 1, 2""",
    "silver_run_counts": _with(ITEMS)
    + """ , good AS (SELECT * FROM raw WHERE chunk % 7 <> 6),
          kept AS (SELECT DISTINCT trim(raw_id), region, run_id FROM good WHERE trim(raw_id) <> '')
          SELECT (SELECT count(*) FROM events) AS events,
                 (SELECT count(DISTINCT (region, chunk)) FROM raw) AS files,
                 (SELECT count(DISTINCT (region, chunk)) FROM raw WHERE chunk % 7 = 6) AS unreadable_files,
                 (SELECT count(DISTINCT (region, chunk)) FROM good WHERE chunk % 3 = 1) AS rejected_items,
                 count(*) AS input_rows,
                 count(*) FILTER (WHERE trim(raw_id) = '') AS blank_video_id, 0::BIGINT AS blank_region,
                 count(*) FILTER (WHERE trim(raw_id) <> '') - (SELECT count(*) FROM kept) AS duplicate_rows,
                 (SELECT count(*) FROM kept) AS output_rows
          FROM good""",
    "landing_twice": _with(ITEMS)
    + " SELECT region, count(DISTINCT chunk) AS envelopes, count(*) AS items FROM raw GROUP BY region",
    "all_stats_view": _with(STATS) + " SELECT * FROM latest",
    "guards": """
        SELECT (SELECT count(*) FROM orders) AS orders, guard, says,
               CAST(least(10, (SELECT count(*) FROM orders)) AS INTEGER) AS sampled
        FROM (VALUES ('columns', 'missing required columns: [''absent'']'), ('columns_present', 'ok'),
                     ('rows', 'orders is empty'), ('rows_present', 'ok'),
                     ('unique_columns', 'duplicate columns: [''o_orderkey'']'), ('unique_columns_present', 'ok')) t(guard, says)""",
    "sampled_rows": """
        SELECT least(10, count(*)) AS found, least(10, count(*)) AS orders FROM orders""",
    "describe_stats": _GOLD
    + _described(
        "stats",
        "video_id string, title string, category_id int, views bigint, likes bigint, comment_count bigint, "
        "region string, ingestion_date date, ingestion_hour int",
    ),
    "describe_gold": _RUN
    + " UNION ALL ".join(
        f"SELECT '{report}' AS report, * FROM ({_described(table, columns)})"
        for report, table, columns in (
            (
                "category_engagement",
                "engagement",
                "category_name string, total_views bigint, total_likes bigint, total_comments bigint, engagement_rate double, "
                "category_id string",
            ),
            (
                "category_performance",
                "performance",
                "category_name string, video_count bigint, total_views bigint, avg_views double, total_likes bigint, "
                "avg_likes double, total_comments bigint, avg_comments double, category_id string",
            ),
            (
                "category_region",
                "regional",
                "category_name string, video_count bigint, total_views bigint, avg_views double, total_likes bigint, "
                "total_comments bigint, region string, category_id string",
            ),
            (
                "video_rankings",
                "rankings",
                "video_id string, title string, category_name string, region string, views bigint, video_rank bigint, "
                "category_id string",
            ),
        )
    ),
    "gold_untouched": _RUN
    + f"""SELECT report, count(*) AS rows, 0::BIGINT AS new_rows, 0::BIGINT AS affected_categories,
                  0::BIGINT AS affected_pairs, 0::BIGINT AS facts_without_name FROM ({_LONG}) GROUP BY report""",
    "gold_counts": _GOLD
    + """ SELECT (SELECT count(*) FROM stats) AS facts, count(*) AS new_rows,
                 (SELECT count(*) FROM affected) AS affected_categories, (SELECT count(*) FROM pairs) AS affected_pairs,
                 count(*) FILTER (WHERE category_id IS NOT NULL AND CAST(category_id AS VARCHAR) NOT IN (
                   SELECT category_id FROM dim WHERE category_id < '2')) AS facts_without_name
          FROM batch""",
    "silver_json_schemaless": _with(ITEMS) + f" SELECT {SILVER_COLUMNS} FROM silver",
    "silver_batch_json": _with(ITEMS)
    + """ SELECT video_id, region, CAST(ingestion_date AS VARCHAR) AS ingestion_date, ingestion_hour, views
          FROM silver WHERE (silver.ingestion_date, ingestion_hour) = (
            SELECT max((ingestion_date, ingestion_hour)) FROM raw)""",
    "silver_csv": _with(FLAT)
    + """ SELECT * EXCLUDE (o_orderkey) REPLACE (CAST(trending_date AS VARCHAR) AS trending_date,
                 strftime(publish_time, '%Y-%m-%d %H:%M:%S') AS publish_time)
          FROM flat WHERE video_id <> ''
          QUALIFY row_number() OVER (PARTITION BY video_id, flat.trending_date, region ORDER BY o_orderkey) = 1""",
    "csv_table": _with(FLAT)
    + " SELECT channel_title, count(title) AS n, max(title) AS last_title FROM flat GROUP BY channel_title",
    "stage_quality_metrics": _with(ITEMS)
    + """ , kept AS (SELECT DISTINCT trim(raw_id), region, run_id FROM raw
                     WHERE trim(raw_id) <> '' AND event_id % 7 <> 0)
          SELECT count(*) AS input_rows,
                 count(*) FILTER (WHERE trim(raw_id) = '') AS blank_video_id,
                 count(*) FILTER (WHERE trim(raw_id) <> '' AND event_id % 7 = 0) AS blank_region,
                 count(*) FILTER (WHERE trim(raw_id) <> '' AND event_id % 7 <> 0)
                   - (SELECT count(*) FROM kept) AS duplicate_rows,
                 (SELECT count(*) FROM kept) AS output_rows
          FROM raw""",
    "ingest_report": _with(ITEMS, _REPORT) + " SELECT * FROM report",
    "ingest_summary_json": _with(ITEMS, _REPORT)
    + """ SELECT '{"region":"' || region || '","status":"' || CASE WHEN error IS NULL THEN 'success' ELSE 'failed' END
                 || '"' || CASE WHEN error IS NULL THEN '' ELSE ',"error":"' || error || '"' END
                 || ',"files":' || count(*) || ',"incoming_rows":' || sum(incoming_rows) || '}' AS document
          FROM report GROUP BY region, error""",
    "reference_job": _with(REFERENCE) + _DIMENSION,
    "reference_job_names": _with(REFERENCE) + _NAMED,
    "stream_upsert_names": _with(REFERENCE) + _NAMED,
    "stream_upsert": _with(REFERENCE) + _DIMENSION,
    "reference_report": _with(REFERENCE)
    + """ SELECT '20240101_000000_' || lpad(CAST(pos // 250 AS VARCHAR), 12, '0') AS run_id, region,
                 count(*) AS incoming_rows, count(DISTINCT id) AS distinct_rows,
                 (SELECT count(DISTINCT id) FROM customer_ref r WHERE r.region = customer_ref.region) AS final_rows,
                 (SELECT count(*) FROM reference) AS dimension_rows,
                 CAST(NULL AS VARCHAR) AS error
          FROM customer_ref GROUP BY pos // 250, region""",
    "reference_job_damaged": _with(REFERENCE)
    + " SELECT region, id, snippet_title, CAST(balance AS VARCHAR) AS snippet_channelid, "
    + f"{_STAMPED} AS ingestion_timestamp FROM reference UNION ALL SELECT 'damaged', 's' || s_suppkey, 'half', '1', {_STAMPED} "
    + "FROM supplier WHERE s_suppkey % 5 = 4",
    "stream_upsert_damaged": _with(REFERENCE)
    + _DIMENSION
    + f" UNION ALL SELECT 'damaged', 's' || s_suppkey, 'half', '1', {_STAMPED} FROM supplier WHERE s_suppkey % 5 = 4",
    "reference_report_damaged": _with(REFERENCE)
    + """ SELECT error, count(*) AS files, CAST(sum(n) AS BIGINT) AS found, CAST(sum(d) AS BIGINT) AS rows FROM (
            SELECT CAST(NULL AS VARCHAR) AS error, count(*) AS n, count(DISTINCT id) AS d
            FROM customer_ref GROUP BY pos // 250, region
            UNION ALL SELECT CASE s_suppkey % 5 WHEN 3 THEN 'unreadable document' WHEN 4 THEN NULL
                      ELSE 'missing required column id' END,
                    CASE s_suppkey % 5 WHEN 3 THEN 0 WHEN 4 THEN 2 ELSE 1 END, CASE s_suppkey % 5 WHEN 4 THEN 1 ELSE 0 END
            FROM supplier) GROUP BY error""",
    "reference_region_replace": _with(REFERENCE)
    + """ SELECT region, id, snippet_title FROM (
            SELECT * FROM customer_ref WHERE region IN ('asia', 'europe')
            UNION ALL SELECT * FROM supplier_ref WHERE region NOT IN ('asia', 'europe'))
          QUALIFY row_number() OVER (PARTITION BY region, id ORDER BY pos DESC) = 1""",
    "incremental_replace": _with(STATS)
    + """ SELECT region, CAST(category_id AS VARCHAR) AS category_id, count(*) AS n FROM stats
          WHERE (category_id < 10 AND category_id <> 3) OR (category_id >= 10 AND ingestion_date < DATE '2024-01-16')
          GROUP BY region, category_id""",
    "evolving_table": _with(REFERENCE)
    + """ SELECT region, id, snippet_title, balance, pos FROM reference WHERE region IN ('asia', 'europe')
          UNION ALL
          SELECT region, id, snippet_title, NULL, pos FROM supplier_ref WHERE region NOT IN ('asia', 'europe')
          QUALIFY row_number() OVER (PARTITION BY region, id ORDER BY pos DESC) = 1""",
    "overwrite_modes": _with(STATS)
    + """ , counts AS (SELECT region, CAST(category_id AS VARCHAR) AS category_id, count(*) AS n
                       FROM stats GROUP BY region, category_id)
          SELECT region, category_id, CASE WHEN category_id IN ('1', '2') THEN -n ELSE n END AS n,
                 'dynamic' AS mode FROM counts
          UNION ALL SELECT region, category_id, -n, 'static' FROM counts WHERE category_id IN ('1', '2')""",
    "external_table": _with(STATS)
    + """ SELECT region, CAST(ingestion_date AS VARCHAR) AS ingestion_date, count(*) AS n,
                 CAST(sum(views) AS BIGINT) AS views, CAST(0 AS INTEGER) AS rows_before_repair
          FROM stats GROUP BY 1, 2""",
    "sql_over_views": _GOLD
    + """ SELECT s.region, count(*) AS fact_rows, count(b.event_id) AS batch_rows,
                 count(DISTINCT r.snippet_title) AS names
          FROM stats s LEFT JOIN batch b ON b.event_id = s.event_id
          LEFT JOIN reference r ON r.region = s.region AND r.id = CAST(s.category_id AS VARCHAR)
          GROUP BY s.region""",
    "gold_with_state": _GOLD
    + ", engagement AS ("
    + _engagement("stats", "WHERE category_id IN (SELECT category_id FROM affected)")
    + f"), performance AS ({_performance(_IN_CATEGORIES)}), regional AS ({_region(_IN_PAIRS)}), "
    + f"rankings AS ({_rankings(_IN_CATEGORIES, 3)}) "
    + _LONG,
    "full_run": _with(
        ITEMS.replace("silver AS (", "stats AS ("),
        """
newest AS (SELECT max((ingestion_date, ingestion_hour)) AS b FROM stats),
batch AS (SELECT * FROM stats WHERE (ingestion_date, ingestion_hour) = (SELECT b FROM newest)),
affected AS (SELECT DISTINCT category_id FROM batch WHERE category_id IS NOT NULL),
pairs AS (SELECT DISTINCT region, category_id FROM batch WHERE category_id IS NOT NULL),
latest AS (
  SELECT video_id, region, title, category_id, views, likes, comment_count FROM stats
  QUALIFY row_number() OVER (
    PARTITION BY video_id, region ORDER BY ingestion_date DESC, ingestion_hour DESC, chunk DESC) = 1
)""",
        REFERENCE,
        "engagement AS ("
        + _engagement("stats", "WHERE category_id IN (SELECT category_id FROM affected)")
        + ")",
        f"performance AS ({_performance(_IN_CATEGORIES)})",
        f"regional AS ({_region(_IN_PAIRS)})",
        f"rankings AS ({_rankings(_IN_CATEGORIES, 3)})",
    )
    + """
"""
    + _LONG,
}
