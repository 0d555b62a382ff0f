from types import SimpleNamespace

import pytest

from tidemark.session import drop_scratch, path_exists, scratch, shared_dir, stage


def cluster(setting):
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    conf = SimpleNamespace(get=lambda key, default: setting if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_the_shared_folder_is_the_configured_one():
    assert shared_dir(cluster("s3a://bucket/tmp/")) == "s3a://bucket/tmp"


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(cluster(None))


def test_staged_rows_and_cleaning_up(spark, rows):
    work = scratch(spark)
    df = spark.range(5)
    assert rows(stage(df, f"{work}/x")) == rows(df)
    assert path_exists(spark, work)
    drop_scratch(spark, work)
    assert not path_exists(spark, work)
    with pytest.raises(ValueError):
        drop_scratch(spark, "/tmp/elsewhere")
