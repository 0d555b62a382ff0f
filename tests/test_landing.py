"""Landing and listing of very many small documents."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import sinks
from tidemark.plans import silver
from tidemark.session import small_files
from tidemark.sinks import landing
from tidemark.sources import discovery


def _landed(spark, root, docs, run_id=None):
    df = spark.createDataFrame(docs, "region string, run_id string, items array<struct<id:string>>")
    sinks.land_envelopes(df, str(root), dt.datetime(2024, 1, 1, 5, tzinfo=dt.timezone.utc), "test", run_id=F.col("run_id") if run_id is None else run_id)
    return sorted(p.relative_to(root) for p in root.rglob("*.json"))


def test_tasks_write_whole_run_folders_and_share_a_full_one(spark, tmp_path):
    root = tmp_path / "raw"
    few = [("us", f"r{run:03d}", [(f"{run}-{n}",)]) for run in range(40) for n in range(8)]
    many = [("us", "r900", [(f"x{n}",)]) for n in range(320)]
    files = _landed(spark, root, few + many)
    assert len(files) == 640
    tasks = {}
    for path in files:
        tasks.setdefault(path.parts[3], set()).add(path.name.split("-")[1])
    full = tasks.pop("run=r900")
    assert len(full) > 2
    # A range ends within a folder at most once for each task.
    assert sum(map(len, tasks.values())) <= len(tasks) + len(set().union(*tasks.values()))


def test_first_landing_leaves_nothing_beside_the_root_and_a_later_one_replaces_its_runs(spark, tmp_path):
    root = tmp_path / "raw"
    first = _landed(spark, root, [("us", "a", [("1",)]), ("us", "b", [("2",)]), ("us", "b", [("2",)]), (None, "c", None)])
    assert [p.parts[3] for p in first if p.parts[0] == "region=us"] == ["run=a", "run=b", "run=b"]
    assert len(first) == 4
    second = _landed(spark, root, [("us", "b", [("3",)])])
    assert len(second) == 3 and len(set(first) & set(second)) == 2
    assert [p.name for p in tmp_path.iterdir()] == ["raw"]


def test_a_failed_first_landing_leaves_no_root(spark, tmp_path):
    root = tmp_path / "raw"
    with pytest.raises(Exception):
        _landed(spark, root, [("us", "a", [("1",)])], F.raise_error(F.lit("no run")))
    assert not root.exists() and list(tmp_path.iterdir()) == []


def test_listing_asks_for_no_block_locations_and_leaves_the_settings(spark, tmp_path, monkeypatch):
    _landed(spark, tmp_path / "raw", [("us", "a", [("1",)])])
    key, seen = "spark.sql.sources.ignoreDataLocality", []
    inner = discovery._listing_folders
    monkeypatch.setattr(discovery, "_listing_folders", lambda *a: seen.append(spark.conf.get(key)) or inner(*a))
    assert discovery.list_files(spark, str(tmp_path / "raw")).count() == 1
    assert seen == ["true"] and spark.conf.get(key) == "false"


def test_options_of_small_files_keep_the_session_s_file_system(spark):
    conf = spark._jsc.hadoopConfiguration()
    own = conf.get("fs.file.impl")
    assert own and small_files(spark) == {}
    conf.unset("fs.file.impl")
    try:
        assert small_files(spark)["fs.file.impl"].endswith("RawLocalFileSystem")
    finally:
        conf.set("fs.file.impl", own)


ODD = [("a/b=c %", "r:1", "x", [1]), ("é'", "r 2", None, None), (None, "", "y\nz", []), ("", "r1", "y", [2]), ("é'", "r 2", None, None)]


@pytest.mark.parametrize("form", ["json", "text"])
def test_tasks_create_what_spark_s_writer_creates(spark, tmp_path, monkeypatch, form):
    df = spark.createDataFrame(ODD, "region string, run string, text string, n array<int>")
    df = df if form == "json" else df.drop("n")
    landing.document_writer(df, ["region", "run"]).format(form).save(str(tmp_path / "spark"))
    monkeypatch.setattr(landing, "document_writer", None)  # not needed on a local disk, where it starts processes
    sinks.write_documents(df, ["region", "run"], str(tmp_path / "raw"), form)

    def found(root):
        files = [p for p in root.rglob("*") if p.is_file()]
        return sorted((str(p.parent.relative_to(root)), p.suffix, p.read_bytes()) for p in files if p.suffix != ".crc")

    assert found(tmp_path / "raw") == found(tmp_path / "spark") and len(found(tmp_path / "raw")) == 6
    assert sorted(p.name for p in tmp_path.iterdir()) == ["raw", "spark"]


@pytest.mark.parametrize("local", [True, False])
@pytest.mark.parametrize("replace", [True, False])
def test_documents_below_a_root_that_exists(spark, tmp_path, monkeypatch, local, replace):
    if not local:
        monkeypatch.setattr(landing, "local_path", lambda *_: None)
    root = tmp_path / "raw"
    for docs in ([("us", "1"), ("us", "2"), ("de", "3")], [("us", "4"), ("fr", "5")], []):
        df = spark.createDataFrame(docs, "region string, text string")
        sinks.write_documents(df, ["region"], f"{root}/", "text", replace=replace)
    texts = {region: sorted(p.read_text() for p in root.glob(f"region={region}/*.txt")) for region in ("us", "de", "fr")}
    assert texts == {"us": ["4\n"] if replace else ["1\n", "2\n", "4\n"], "de": ["3\n"], "fr": ["5\n"]}
    assert [p.name for p in tmp_path.iterdir()] == ["raw"]


def test_attempts_that_did_not_end_add_nothing(tmp_path):
    """What a lost attempt wrote stays in its own folder; moved together are those named by their results."""
    for attempt, name in (("00000-a", "1"), ("00000-b", "1"), ("00001-c", "2")):
        folder = tmp_path / "attempts" / attempt / "region=us" / "run=1"
        folder.mkdir(parents=True)
        (folder / f"{attempt}-{name}.json").touch()
    for attempt in ("00000-b", "00001-c"):
        landing._merge(str(tmp_path / "attempts" / attempt), str(tmp_path / "whole"))
    assert sorted(p.name for p in tmp_path.glob("whole/*/*/*")) == ["00000-b-1.json", "00001-c-2.json"]


def test_a_task_of_the_silver_job_reads_many_small_documents(spark, tmp_path, monkeypatch):
    key = "spark.sql.files.openCostInBytes"
    before, seen = spark.conf.get(key), []
    _landed(spark, tmp_path / "raw", [("us", f"r{n}", [(f"{n}",)]) for n in range(240)])
    write = silver.write_partitions
    monkeypatch.setattr(silver, "write_partitions", lambda df, *a: seen.append(df.rdd.getNumPartitions()) or write(df, *a))
    counts = silver.bronze_json_to_silver(spark, str(tmp_path / "raw"), str(tmp_path / "silver"), None)
    assert counts["files"] == counts["output_rows"] == 240
    assert seen[0] <= 5 and spark.conf.get(key) == before
