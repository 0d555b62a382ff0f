import json
import os

import pytest

from tidemark import plans, sources
from tidemark.plans.dimension import replace_regions
from tidemark.session import path_exists
from tidemark.sources.discovery import scan_files
from tidemark.streaming import stream_reference
from workload.queries import _texts

STAMP = "2026-08-15T00:00:00+00:00"


def put(root, region, items=None, name="a.json", date="2026-08-15", document=None):
    folder = root / (f"region={region}" if region else "other") / f"date={date}"
    folder.mkdir(parents=True, exist_ok=True)
    text = document if isinstance(document, str) else json.dumps(document or {"kind": "k", "items": items}, indent=2)
    (folder / name).write_text(text)


def category(id, title, **snippet):
    return {"id": id, "snippet": {"title": title, "channelId": "c", **snippet}}


@pytest.fixture
def raw(tmp_path):
    return tmp_path / "raw"


@pytest.fixture
def target(tmp_path):
    return str(tmp_path / "dim")


def table(spark, target):
    df = sources.read_reference_table(spark, target)
    return {(r.region, r.id): r.asDict() for r in df.collect()}


def test_flattened_tagged_rows(spark, raw, target):
    put(raw, "US", [category(" 1 ", "Film"), category("2", "Music")])
    report = plans.upsert_reference(spark, str(raw), target, STAMP)
    rows = table(spark, target)
    assert set(rows) == {("us", "1"), ("us", "2")}
    row = rows["us", "1"]
    assert row["snippet_title"] == "Film" and row["snippet_channelid"] == "c"
    assert row["ingestion_timestamp"] == "2026-08-15T00:00:00+00:00"
    assert row["source_file"].endswith("region=US/date=2026-08-15/a.json")
    assert [tuple(r)[1:] for r in report.collect()] == [("us", 2, 2, 2, 2, None)]


def test_last_position_and_last_file_win(spark, raw, target):
    put(raw, "us", [category("1", "A"), category("1", "B")], date="2026-08-14")
    put(raw, "in", [category("1", "old")], date="2026-08-14")
    put(raw, "in", [category("1", "new")], date="2026-08-15")
    plans.upsert_reference(spark, str(raw), target, STAMP)
    rows = table(spark, target)
    assert rows["us", "1"]["snippet_title"] == "B" and rows["in", "1"]["snippet_title"] == "new"


def test_upsert_replaces_keeps_inserts_and_evolves(spark, raw, tmp_path, target):
    put(raw, "us", [category("1", "A"), category("2", "B")])
    put(raw, "in", [category("1", "I")])
    plans.upsert_reference(spark, str(raw), target, STAMP)
    later = tmp_path / "later"
    put(later, "us", [category("1", "A2", assignable=True), category("3", "C")])
    for _ in range(2):
        plans.upsert_reference(spark, str(later), target, STAMP)
        rows = table(spark, target)
        titles = {k: v["snippet_title"] for k, v in rows.items()}
        assert titles == {("us", "1"): "A2", ("us", "2"): "B", ("us", "3"): "C", ("in", "1"): "I"}
        assert rows["us", "1"]["snippet_assignable"] is True
        assert rows["us", "2"]["snippet_assignable"] is None and rows["in", "1"]["snippet_assignable"] is None


def test_a_changed_type_is_widened_in_every_region(spark, raw, tmp_path, target):
    put(raw, "us", [category("1", "A", level=1)])
    put(raw, "in", [category("1", "I", level=2)])
    plans.upsert_reference(spark, str(raw), target, STAMP)
    later = tmp_path / "later"
    put(later, "us", [category("1", "A", level="high")])
    plans.upsert_reference(spark, str(later), target, STAMP)
    rows = table(spark, target)
    assert rows["us", "1"]["snippet_level"] == "high" and rows["in", "1"]["snippet_level"] == "2"


def test_a_rewrite_of_everything_is_swapped_in(spark, raw, tmp_path, target, monkeypatch):
    """A reader sees the old or the new dimension at any time, and a rerun finishes what was left."""
    from tidemark.sinks import partitions

    put(raw, "us", [category("1", "A", level=1)])
    put(raw, "in", [category("1", "I", level=2)])
    plans.upsert_reference(spark, str(raw), target, STAMP)
    begun = sources.read_reference_table(spark, target)
    later = tmp_path / "later"
    put(later, "us", [category("1", "A2", level="high")])
    plain, moves = partitions.move_folder, []

    def second_fails(spark, path, to):
        moves.append(to)
        if len(moves) == 2:
            raise OSError("killed")
        plain(spark, path, to)

    monkeypatch.setattr(partitions, "move_folder", second_fails)
    with pytest.raises(OSError):
        plans.upsert_reference(spark, str(later), target, STAMP)
    monkeypatch.undo()
    assert not path_exists(spark, target)
    assert {k: v["snippet_title"] for k, v in table(spark, target).items()} == {("us", "1"): "A", ("in", "1"): "I"}
    plans.upsert_reference(spark, str(later), target, STAMP)
    rows = table(spark, target)
    assert {k: (v["snippet_title"], v["snippet_level"]) for k, v in rows.items()} == {("us", "1"): ("A2", "high"), ("in", "1"): ("I", "2")}
    assert begun.schema["snippet_level"].dataType.simpleString() == "bigint"


def test_stored_regions_of_another_form_are_merged(spark, raw, target):
    old = spark.createDataFrame([("1", "Old", "US"), ("2", "Kept", "US")], "id string, snippet_title string, region string")
    old.write.partitionBy("region").parquet(target)
    put(raw, "us", [category("1", "New")])
    plans.upsert_reference(spark, str(raw), target, STAMP)
    titles = {k: v["snippet_title"] for k, v in table(spark, target).items()}
    assert titles == {("us", "1"): "New", ("us", "2"): "Kept"}


def test_stored_names_of_another_form_are_merged(spark, raw, target):
    old = spark.createDataFrame(
        [("1", "Old", "k1", "us"), ("2", "Kept", "k2", "in")],
        "id string, snippet_title string, `_source_file` string, region string",
    )
    old.write.partitionBy("region").parquet(target)
    put(raw, "us", [category("1", "New")])
    plans.upsert_reference(spark, str(raw), target, STAMP)
    rows = table(spark, target)
    assert {k: v["snippet_title"] for k, v in rows.items()} == {("us", "1"): "New", ("in", "2"): "Kept"}
    assert rows["in", "2"]["source_file"] == "k2" and "_source_file" not in rows["in", "2"]


def test_bare_objects_and_unknown_region(spark, raw, target):
    put(raw, "us", [category("1", "A")])
    put(raw, None, document={"id": "9", "snippet": {"title": "Bare"}})
    plans.upsert_reference(spark, str(raw), target, STAMP)
    titles = {k: v["snippet_title"] for k, v in table(spark, target).items()}
    assert titles == {("us", "1"): "A", ("unknown", "9"): "Bare"}


def test_unusable_files_are_reported_and_the_rest_is_loaded(spark, raw, target):
    put(raw, "us", [category("1", "A"), {"snippet": {"title": "no id"}}])
    put(raw, "in", [])
    put(raw, "fr", document='{"items": [{"id"')
    put(raw, "jp", [{"id": "1", "snippet": {"channelId": "c"}}])
    put(raw, "kr", [{"snippet": {"title": "x"}}])
    report = plans.upsert_reference(spark, str(raw), target, STAMP)
    assert sorted(tuple(r)[1:] for r in report.collect()) == [
        ("fr", 0, 0, 0, 1, "unreadable document"),
        ("in", 0, 0, 0, 1, "no items"),
        ("jp", 1, 0, 0, 1, "missing required column snippet_title"),
        ("kr", 1, 0, 0, 1, "missing required column id"),
        ("us", 2, 1, 1, 1, None),
    ]
    assert set(table(spark, target)) == {("us", "1")}


@pytest.mark.parametrize(
    "document",
    [
        '{"items": "text"}',
        '{"items": ["text"]}',
        '{"items": [{"id": "7", "snippet": "text"}]}',
        '{"items": [{"id"',
        "[1, 2]",
        '{"items": {"id": "7"}}',
    ],
)
def test_a_damaged_file_changes_nothing_for_the_others(spark, raw, target, document):
    put(raw, "us", [category("1", "A", level=1), category("2", "B")])
    put(raw, "in", [category("1", "I", level="high"), "text", {"id": "3", "snippet": "text"}])
    put(raw, "fr", document=document)
    report = {r.region: r.error for r in plans.upsert_reference(spark, str(raw), target, STAMP).collect()}
    assert report["us"] is None and report["in"] is None and report["fr"] is not None
    rows = table(spark, target)
    assert set(rows) == {("us", "1"), ("us", "2"), ("in", "1")}
    assert rows["us", "1"]["snippet_level"] == "1" and rows["in", "1"]["snippet_level"] == "high"


@pytest.mark.parametrize("document", ['{"items": [{"id"', '{"items": []}', '{"a": 1}'])
def test_a_set_without_a_usable_file_leaves_the_target_alone(spark, raw, target, document):
    put(raw, "us", document=document)
    report = plans.upsert_reference(spark, str(raw), target, STAMP)
    assert report.filter("error is not null").count() == 1
    assert not path_exists(spark, target)


def test_only_a_missing_path_counts_as_empty(spark, raw, tmp_path):
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("not parquet")
    put(raw, "us", [category("1", "A")])
    with pytest.raises(Exception):
        plans.upsert_reference(spark, str(raw), str(broken), STAMP)
    assert (broken / "part-0.parquet").read_text() == "not parquet"


def test_older_load_replaces_regions(spark, target):
    schema = "region string, id string, snippet_title string, __pos int"
    replace_regions(spark.createDataFrame([("us", "1", "A", 0), ("us", "1", "B", 1), ("in", "1", "I", 0)], schema), target)
    replace_regions(spark.createDataFrame([("us", "2", "C", 0)], schema), target)
    df = sources.read_reference_table(spark, target)
    assert sorted((r.region, r.id, r.snippet_title) for r in df.collect()) == [("in", "1", "I"), ("us", "2", "C")]


def test_stream_sees_each_file_once(spark, raw, tmp_path, target):
    report, checkpoint = str(tmp_path / "report"), str(tmp_path / "checkpoint")
    run = lambda: stream_reference(spark, str(raw), target, checkpoint, ingestion_timestamp=STAMP, report=report).awaitTermination()
    put(raw, "us", [category("1", "A"), category("2", "B")])
    run()
    put(raw, "us", [category("1", "A2", extra="new field")], name="b.json")
    put(raw, "in", document='{"items": [{"id"')
    run()
    run()
    titles = {k: v["snippet_title"] for k, v in table(spark, target).items()}
    assert titles == {("us", "1"): "A2", ("us", "2"): "B"}
    assert spark.read.parquet(report).count() == 3


ODD = {"id": "5", "a`b": 1, "ID": "other", "x y, <z>": 2.5, "": True, "kind": "k", "snippet": {"title": "Odd", "Title": "T", "deep": {"er": {"`": "q", "list": [{"a": 1}, "t"]}}}}


def test_names_of_any_kind(spark, raw, target):
    """Odd names, names that differ in case, and names that the library uses itself stop nothing."""
    put(raw, "us", [category("1", "A"), {"Kind": "K", "id": "2", "snippet": {"Title": "Only", "title": None}}])
    put(raw, "in", [ODD, {**ODD, "id": "6", "__file": "f", "__pos": 9, "region": "r", "source_file": "s"}])
    put(raw, "fr", document='{"items": [{"id": "1", "id": "7", "snippet": {"title": "twice"}}]}')
    report = plans.upsert_reference(spark, str(raw), target, STAMP).collect()
    assert [r.error for r in report] == [None] * 3
    rows = table(spark, target)
    assert set(rows) == {("us", "1"), ("us", "2"), ("in", "5"), ("in", "6"), ("fr", "7")}
    odd, more = rows["in", "5"], rows["in", "6"]
    assert (odd["a_b"], odd["x_y_z"], odd["kind"], odd["snippet_title"]) == (1, 2.5, "k", "Odd")
    assert odd["snippet_deep_er_list"] == ['{"a":1}', "t"] and odd["snippet_deep_er"] == "q"
    assert (more["file"], more["pos"], more["region"]) == ("f", 9, "in") and more["source_file"].endswith("a.json")
    assert rows["us", "2"]["snippet_title"] == "Only" and rows["us", "2"]["kind"] == "K"


def test_colliding_names_merge_in_the_order_of_the_file(spark, raw, target):
    put(raw, "us", [{"zz": 1, "id": "1", "ZZ": 2, "snippet": {"title": "t"}}, {"ZZ": 3, "id": "2"}, {"ZZ": 5, "id": "3", "zz": 4}])
    put(raw, "in", [{"ZZ": 2, "id": "1", "zz": 1, "snippet": {"title": "t"}}])
    plans.upsert_reference(spark, str(raw), target, STAMP)
    assert {k: v["zz"] for k, v in table(spark, target).items()} == {("us", "1"): 1, ("us", "2"): 3, ("us", "3"): 4, ("in", "1"): 2}


def test_a_failing_file_is_set_aside(spark, raw, tmp_path, target, monkeypatch):
    """Whatever makes a file fail: the others of its micro-batch are merged, and the stream ends well."""
    from tidemark.plans import dimension

    whole, calls = dimension._upsert, []

    def fragile(spark, paths, *rest):
        calls.append(len(paths))
        if any("poison" in p for p in paths):
            raise RuntimeError("cannot read\nthis")
        return whole(spark, paths, *rest)

    monkeypatch.setattr(dimension, "_upsert", fragile)
    for i in range(4):
        put(raw, "us", [category(str(i), f"T{i}")], name=f"{i}.json")
    put(raw, "us", [category("9", "bad")], name="2-poison.json")
    report = str(tmp_path / "report")
    for _ in range(2):
        stream_reference(spark, str(raw), target, str(tmp_path / "checkpoint"), ingestion_timestamp=STAMP, report=report).awaitTermination()
    assert set(table(spark, target)) == {("us", str(i)) for i in range(4)}
    errors = {r.key.rsplit("/", 1)[1]: r.error for r in spark.read.parquet(report).collect()}
    assert errors == {"0.json": None, "1.json": None, "2.json": None, "3.json": None, "2-poison.json": "RuntimeError: cannot read"}
    with pytest.raises(RuntimeError):
        dimension.upsert_each(spark, ["poison1", "poison2"], target)


def test_files_of_a_small_table_are_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(40).coalesce(1).selectExpr("'us' AS region", "concat('{\"items\": ', id, '}') AS text")
    _texts(rows, str(tmp_path / "raw"))
    files = [f.name for f in (tmp_path / "raw" / "region=us").iterdir() if f.name.startswith("part-")]
    assert len(files) == 40
    assert len({name.split("-")[1] for name in files}) > 1


def test_files_of_one_stream_run_merge_by_name_wherever_it_is_cut(spark, raw, tmp_path, target):
    run = lambda: stream_reference(spark, str(raw), target, str(tmp_path / "checkpoint"), ingestion_timestamp=STAMP, files_per_batch=1).awaitTermination()
    for i in range(4):
        put(raw, "us", [category("1", f"T{i}"), category(f"own{i}", "x")], name=f"{i}.json")
        os.utime(raw / "region=us" / "date=2026-08-15" / f"{i}.json", (1000 - i, 1000 - i))
    run()
    assert {k[1]: v["snippet_title"] for k, v in table(spark, target).items()} == {"1": "T3"} | {f"own{i}": "x" for i in range(4)}
    put(raw, "us", [category("1", "later")], name="0-later.json")
    run()
    assert table(spark, target)["us", "1"]["snippet_title"] == "later"


def test_few_tasks_look_up_a_list_of_files(spark, raw):
    for i in range(60):
        put(raw, "us", [category(str(i), "T")], name=f"{i}.json")
    files = [str(p) for p in raw.rglob("*.json")]
    spark.sparkContext.setJobGroup("lookup", "")
    try:
        assert len(scan_files(spark, files).inputFiles()) == 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup("lookup") for s in tracker.getJobInfo(job).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) < 60


def test_depth_is_found_at_every_level(spark, raw, target):
    put(raw, "us", [category("1", "A", deep={"a": {"b": {"c": {"d": 5}}}}), category("2", "B")])
    put(raw, "in", [{"id": "1", "snippet.title": "flat"}, category("3", "C", x={"y": "z"})])
    plans.upsert_reference(spark, str(raw), target, STAMP)
    rows = table(spark, target)
    assert rows["us", "1"]["snippet_deep_a_b_c_d"] == 5 and rows["in", "3"]["snippet_x_y"] == "z"


def test_a_narrower_type_than_the_stored_text_rewrites_its_region_only(spark, raw, tmp_path, target):
    put(raw, "us", [category("1", "A", level="high"), category("2", "B", level="low")])
    put(raw, "in", [category("1", "I", level="mid")])
    plans.upsert_reference(spark, str(raw), target, STAMP)
    later = tmp_path / "later"
    put(later, "us", [category("1", "A", level=5)])
    plans.upsert_reference(spark, str(later), target, STAMP)
    assert {k: v["snippet_level"] for k, v in table(spark, target).items()} == {("us", "1"): "5", ("us", "2"): "low", ("in", "1"): "mid"}
    assert not path_exists(spark, f"{target}.old")
