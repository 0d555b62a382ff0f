"""The physical plans that the operators are meant to get."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from workload.oracle import ORACLE
from workload.queries import QUERIES
from tidemark import operators as ops
from tidemark import plans, sinks, sources
from tidemark.operators.keys import as_batch
from tidemark.schemas import SILVER_STATS, SILVER_STATS_PARTITIONS
from workload import adapter


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stats"))
    stats = adapter.stats(spark, "/root/testdata/sf0.001").filter("ingestion_date < '2024-01-03'")
    sinks.write_partitions(ops.conform(stats, SILVER_STATS), path, SILVER_STATS_PARTITIONS)
    return sources.read_stats(spark, path)


def test_a_large_k_is_limited_on_the_map_side_too(spark):
    """Whatever k: a task sends at most k rows of a key, and the result is that of a full sort."""
    rows = spark.range(0, 20_000, numPartitions=4).selectExpr("id", "id % 2 AS key", "id * 7919 % 20011 AS v")
    got = ops.top_k(rows, ["key"], [F.desc("v"), F.asc("id")], k=1500, rank="place")
    got.collect()
    tree = got._jdf.queryExecution().executedPlan().toString()
    assert tree.count("WindowGroupLimit") >= 2
    best = sorted((r.key, -r.v, r.id) for r in rows.collect())
    want = [x for k in (0, 1) for x in [b for b in best if b[0] == k][:1500]]
    assert sorted((r.key, -r.v, r.id) for r in got.collect()) == want


def test_a_batch_is_pruned_by_partition(stored):
    text = plan(ops.batch_slice(stored, as_batch("2024-01-02", 5)))
    filters = text[text.index("PartitionFilters"):]
    assert "ingestion_date" in filters and "ingestion_hour" in filters


def test_one_row_per_key_is_limited_before_the_shuffle(stored):
    text = plan(plans.latest_snapshots(stored))
    assert "WindowGroupLimit" in text and ", Partial" in text and text.count("Exchange") == 1


def test_scans_read_only_what_is_needed(stored):
    text = plan(plans.latest_snapshots(stored).groupBy("category_id").agg(F.sum("views")))
    schema = text[text.index("ReadSchema"):]
    assert "description" not in schema and "thumbnail_link" not in schema


def test_facts_are_combined_before_they_meet_the_dimension(stored, spark):
    dim = spark.createDataFrame([("1", "One")], "category_id string, category_name string")
    text = plan(plans.category_engagement(stored, dim))
    assert "partial_sum" in text
    assert text.index("Join") < text.index("partial_sum")


def test_top_k_is_limited_before_the_shuffle(stored, spark):
    dim = spark.createDataFrame([("1", "One")], "category_id string, category_name string")
    assert plan(plans.video_rankings(plans.latest_snapshots(stored), dim)).count(", Partial") == 2


def test_no_python_in_any_plan(stored):
    for df in (plans.latest_snapshots(stored), ops.quality_counts(stored, ["video_id"], ["video_id"])):
        assert "Python" not in plan(df) and "Arrow" not in plan(df)


def test_no_broadcast_is_forced(stored, spark):
    """Beyond the size limit every join falls back to a shuffled one."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dim = ops.canonical_dim(adapter.reference_rows(spark, "/root/testdata/sf0.001", "customer"))
        affected = ops.affected_keys(stored, ["category_id"])
        df = plans.category_performance(plans.latest_snapshots(stored), dim, affected)
        assert "Broadcast" not in plan(df) and df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_hot_partition_is_written_by_several_tasks(spark, tmp_path):
    """Rebalancing splits a partition value that holds most of the rows, and keeps them all."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    old = {k: spark.conf.get(k) for k in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        df = spark.range(60000, numPartitions=8).select(
            F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(7).cast("string").alias("region"),
            F.sha2(F.col("id").cast("string"), 256).alias("text"),
        )
        sinks.write_partitions(df, str(tmp_path / "out"), ["region"])
        files = list((tmp_path / "out" / "region=7").glob("*.parquet"))
        assert len(files) > 1
        assert spark.read.parquet(str(tmp_path / "out")).count() == 60000
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def shuffled_rows(spark, df):
    """Rows written to shuffles while ``df`` runs."""
    sc = spark.sparkContext

    def written():
        none = sc._gateway.new_array(sc._gateway.jvm.double, 0)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    df.write.format("noop").mode("overwrite").save()
    # Stage totals arrive through a listener.
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(rows for stage, rows in written().items() if stage not in before)


def test_a_hot_key_crosses_the_shuffle_as_a_few_rows(spark):
    """A third of 30,000 rows in one key: each of 8 map tasks forwards k rows per key."""
    df = spark.range(30000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 10).alias("key"), "id"
    )
    keys, tasks = 10, 8
    assert 0 < shuffled_rows(spark, ops.latest_by(df, ["key"], ["id"])) <= keys * tasks
    assert 0 < shuffled_rows(spark, ops.top_k(df, ["key"], [F.col("id").desc()], 3)) <= 3 * keys * tasks
    assert 0 < shuffled_rows(spark, ops.quality_counts(df.selectExpr("cast(key as string) k"), ["k"], ["k"])) <= 2 * keys * tasks


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[-1] == "category_id" and df.count() == 3


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
