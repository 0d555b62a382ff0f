import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark import operators as ops
from tidemark.operators.keys import Batch
from tidemark.operators.reshape import normal_name
from tidemark.schemas import ALL_STATS

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def facts(spark, data):
    return spark.createDataFrame(
        data, "video_id string, region string, category_id int, ingestion_date date, ingestion_hour int, n int"
    )


HISTORY = [
    ("a", "us", 1, D1, 5, 1),
    ("a", "us", 2, D2, 3, 2),
    ("a", "in", 1, D1, 9, 3),
    ("b", "us", 2, D1, 5, 4),
    ("b", "us", None, D2, 3, 5),
    ("c", "us", 3, D2, 3, 6),
]


# --- one row per key ----------------------------------------------------------------------


def test_a_stage_is_described_in_one_pass(spark):
    df = spark.createDataFrame([(1, None, [1]), (2, "x", None)], "id long, `a``b` string, l array<int>").withColumn("s", F.struct("id"))
    got = [tuple(r) for r in ops.describe_stage(df).orderBy("position").collect()]
    assert got == [(0, "id", "bigint", 2, 2), (1, "a`b", "string", 1, 2), (2, "l", "array<int>", 1, 2), (3, "s", "struct<id:bigint>", 2, 2)]


def test_latest_by_takes_the_newest_batch_and_nulls_lose(spark, rows):
    df = facts(spark, [*HISTORY, ("c", "us", 9, None, None, 7)])
    latest = ops.latest_by(df, ["video_id", "region"], ["ingestion_date", "ingestion_hour"])
    assert rows(latest, "video_id", "region", "n") == [("a", "in", 3), ("a", "us", 2), ("b", "us", 5), ("c", "us", 6)]


def test_latest_by_does_not_depend_on_row_order(spark, rows):
    data = [("k", "r", i % 5, D1, i % 3, i) for i in range(60)]
    results = []
    for seed in range(3):
        shuffled = data[:]
        random.Random(seed).shuffle(shuffled)
        df = facts(spark, shuffled).repartition(5)
        results.append(rows(ops.latest_by(df, ["video_id"], ["ingestion_hour", "n"])))
    assert results[0] == results[1] == results[2]


def test_dedupe_keeps_the_first_and_keep_last_the_last(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, pos int")
    assert rows(ops.dedupe(df, ["k"], ["pos"])) == [("a", 1), ("b", 3)]
    assert rows(ops.keep_last(df, ["k"], ["pos"])) == [("a", 2), ("b", 3)]


def test_top_k_ranks_with_ties_and_null_values_last(spark, rows):
    df = spark.createDataFrame([("x", 5), ("y", 5), ("z", None), ("w", 9)], "id string, v int")
    out = ops.top_k(df.withColumn("g", F.lit(1)), ["g"], [F.col("v").desc_nulls_last(), F.col("id")], 4, "r")
    assert rows(out, "id", "r") == [("w", 1), ("x", 2), ("y", 3), ("z", 4)]
    assert dict(out.dtypes)["r"] == "bigint"


def test_top_k_beyond_the_pushed_limit_is_exact(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id", F.lit(1).alias("v"))
    out = ops.top_k(df, ["g"], [F.col("v").desc(), F.col("id").desc()], 1200, "r")
    got = {(r.g, r.r): r.id for r in out.collect()}
    assert len(got) == 2400
    assert all(got[g, r] == 4998 + g - 2 * (r - 1) for g, r in got)


def test_canonical_dim_takes_the_lowest_region(spark, rows):
    df = spark.createDataFrame(
        [("10", "us", "B"), ("10", "in", "A"), ("abc", "us", "C"), (None, "us", "D")],
        "id string, region string, snippet_title string",
    )
    assert rows(ops.canonical_dim(df)) == [("10", "A"), ("abc", "C")]


# --- batches, keys, joins -----------------------------------------------------------------


def test_latest_batch_compares_date_before_hour(spark):
    assert ops.latest_batch(facts(spark, HISTORY)) == Batch(D2, 3)


def test_latest_batch_fails_without_a_batch(spark):
    with pytest.raises(ValueError):
        ops.latest_batch(facts(spark, [("a", "us", 1, None, None, 1)]))


def test_affected_keys_drop_nulls(spark, rows):
    batch = ops.batch_slice(facts(spark, HISTORY), Batch(D2, 3))
    assert rows(ops.affected_keys(batch, ["category_id"])) == [(2,), (3,)]
    assert rows(ops.affected_keys(batch, ["region", "category_id"])) == [("us", 2), ("us", 3)]


def test_affected_keys_with_history_add_left_categories(spark, rows):
    df = facts(spark, HISTORY)
    batch = ops.batch_slice(df, Batch(D2, 3))
    assert rows(ops.affected_keys(batch, ["category_id"], history=df)) == [(1,), (2,), (3,)]
    pairs = ops.affected_keys(batch, ["region", "category_id"], history=df)
    assert rows(pairs) == [("us", 1), ("us", 2), ("us", 3)]


def test_restricted_history_gives_the_same_latest_rows(spark, rows):
    df = facts(spark, HISTORY)
    order = ["ingestion_date", "ingestion_hour"]
    affected = spark.createDataFrame([(1,)], "category_id int")
    full = ops.restrict_to(ops.latest_by(df, ["video_id", "region"], order), affected, ["category_id"])
    cut = ops.restrict_history(df, affected)
    narrow = ops.restrict_to(ops.latest_by(cut, ["video_id", "region"], order), affected, ["category_id"])
    assert rows(narrow) == rows(full) and len(rows(full)) == 1
    wrong = ops.latest_by(df.filter("category_id = 1"), ["video_id", "region"], order)
    assert len(rows(wrong)) == 2


def test_restrict_to_keeps_every_row_once(spark, rows):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), "id")
    keys = spark.createDataFrame([(0,), (2,), (2,)], "k long")
    assert rows(ops.restrict_to(df, keys, ["k"])) == rows(df.filter("k <> 1"))


def test_lookup_drops_unknown_keys_and_accepts_text_ids(spark, rows):
    dim = spark.createDataFrame([("1", "one"), ("abc", "text")], "category_id string, category_name string")
    df = facts(spark, HISTORY)
    assert rows(ops.lookup_dim(df, dim), "n", "category_name") == [(1, "one"), (3, "one")]
    assert rows(ops.keys_missing_from(df, dim)) == [("2", 2), ("3", 1)]


# --- reshaping ----------------------------------------------------------------------------


def test_explode_skips_empty_and_null_arrays(spark, rows):
    df = spark.createDataFrame([(1, [7, 8]), (2, []), (3, None)], "k int, items array<int>")
    assert rows(ops.explode_items(df)) == [(1, 0, 7), (1, 1, 8)]


def test_extract_json(spark, rows):
    df = spark.createDataFrame(
        [(1, '{"a":{"n":" 5 ","tags":["m","o"]}}'), (2, "{broken"), (3, None)], "k int, j string"
    )
    out = ops.extract_json(df, "j", {"n": ("$.a.n", "bigint"), "tags": ("$.a.tags", "string")}, "k")
    assert rows(out) == [(1, 5, '["m","o"]'), (2, None, None), (3, None, None)]


def test_extract_json_mixes_paths(spark):
    df = spark.createDataFrame([('{"a":{"b":1,"c":[5,6]},"d":"x"}',)], "j string")
    fields = {"a": ("$.a", "string"), "b": ("$.a.b", "int"), "second": ("$.a.c[1]", "bigint"), "d": ("$.d", "string"), "no": ("$.d.e", "string")}
    assert tuple(ops.extract_json(df, "j", fields).first()) == ('{"b":1,"c":[5,6]}', 1, 6, "x", None)


def test_conform_adds_casts_and_orders(spark):
    out = ops.conform(spark.createDataFrame([("5", "v")], "views string, video_id string"), ALL_STATS)
    assert out.columns == ALL_STATS.names
    assert out.first().views == 5 and out.first().ingestion_date is None


@pytest.mark.parametrize(
    "name, expected",
    [
        ("snippet.title", "snippet_title"),
        ("snippet.channelId", "snippet_channelid"),
        ("weird-column.name", "weird_column_name"),
        ("__A  b__", "a_b"),
    ],
)
def test_normal_name(name, expected):
    assert normal_name(name) == expected


def test_flatten_and_normalize_merge_colliding_names(spark):
    df = spark.sql(
        "SELECT named_struct('b', CAST(NULL AS STRING), 'c', named_struct('d', 1)) AS a, 'x' AS a_b, array(1) AS l"
    )
    out = ops.normalize_columns(ops.flatten_structs(df))
    assert out.columns == ["a_c_d", "l", "a_b"]
    assert tuple(out.first()) == (1, [1], "x")


def test_normalize_prefers_the_leftmost_value_and_widens_types(spark):
    df = spark.sql("SELECT 1 AS `a.b`, 'x' AS `a_b`, 2 AS `c`")
    out = ops.normalize_columns(df)
    assert out.columns == ["c", "a_b"] and out.first().a_b == "1"


# --- unions and upserts -------------------------------------------------------------------


def test_concat_fills_missing_columns_and_widens_types(spark, rows):
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    b = spark.createDataFrame([("2", 3)], "id string, extra int")
    out = ops.concat_evolving(a, b)
    assert rows(out, "id", "name", "extra") == [("1", "x", None), ("2", None, 3)]


def test_upsert_replaces_whole_rows_and_is_idempotent(spark, rows):
    a = spark.createDataFrame([("us", "1", "A", "old"), ("us", "2", "B", "old")], "region string, id string, t string, x string")
    b = spark.createDataFrame([("us", "1", None, 5), ("in", "1", "C", 6)], "region string, id string, t string, y int")
    once = ops.upsert(a, b, ["region", "id"])
    expected = [("in", "1", "C", None, 6), ("us", "1", None, None, 5), ("us", "2", "B", "old", None)]
    assert rows(once, "region", "id", "t", "x", "y") == expected
    assert rows(ops.upsert(once, b, ["region", "id"]), "region", "id", "t", "x", "y") == expected


# --- quality ------------------------------------------------------------------------------


def test_require_nonblank(spark, rows):
    df = spark.createDataFrame([("a", "us"), (" ", "us"), (None, "us"), ("b", "")], "id string, region string")
    assert rows(ops.require_nonblank(df, "id", "region")) == [("a", "us")]


def test_quality_counts(spark):
    df = spark.createDataFrame(
        [("a", "us"), ("a", "us"), (" ", "us"), ("", ""), ("b", None), ("c", "in")], "id string, region string"
    )
    counts = ops.quality_counts(df, ["id", "region"], ["id", "region"]).first().asDict()
    assert counts == {"input_rows": 6, "blank_id": 2, "blank_region": 1, "duplicate_rows": 1, "output_rows": 2}
    empty = ops.quality_counts(df.filter("false"), ["id"], ["id"]).first().asDict()
    assert set(empty.values()) == {0}


def test_assertions(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert ops.require_columns(df, ["a"]) is df and ops.require_rows(df) is df
    with pytest.raises(ValueError, match="missing required columns"):
        ops.require_columns(df, ["a", "z"])
    with pytest.raises(ValueError, match="empty"):
        ops.require_rows(df.filter("false"))
    with pytest.raises(ValueError, match="duplicate columns"):
        ops.require_unique_columns(df.select("a", "a"))
    assert ops.preview(df.union(df), 1).count() == 1
