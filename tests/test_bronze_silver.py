import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import plans, sinks, sources
from tidemark.operators.keys import Batch
from tidemark.schemas import SILVER_HISTORY, SILVER_STATS

BATCH = Batch(dt.date(2026, 8, 15), 5)


def item(id="v1", **changes):
    base = {
        "id": id,
        "snippet": {
            "title": "T",
            "channelTitle": "C",
            "categoryId": "10",
            "publishedAt": "2026-08-13T17:42:06Z",
            "tags": ["m", "o"],
            "description": "two\nlines",
            "thumbnails": {"default": {"url": "http://u"}},
        },
        "statistics": {"viewCount": "100", "likeCount": "7", "commentCount": " 3 "},
    }
    for key, value in changes.items():
        section = "snippet" if key in base["snippet"] else "statistics"
        base[section][key] = value
    return base


def put(root, items, region="us", hour="05", name="20260815_050000.json", text=None):
    folder = root / f"region={region}" / "date=2026-08-15" / f"hour={hour}"
    folder.mkdir(parents=True, exist_ok=True)
    content = text if text is not None else json.dumps({"kind": "k", "items": items}, indent=2)
    (folder / name).write_text(content)


@pytest.fixture
def raw(tmp_path):
    return tmp_path / "raw"


def load(spark, raw, tmp_path, batch=BATCH):
    metrics = plans.bronze_json_to_silver(spark, str(raw), str(tmp_path / "silver"), batch)
    return sources.read_stats(spark, str(tmp_path / "silver")), metrics


def test_fields_types_and_partitions(spark, raw, tmp_path):
    put(raw, [item(" v1 ")])
    silver, _ = load(spark, raw, tmp_path)
    assert silver.schema == SILVER_STATS
    row = silver.first()
    assert (row.video_id, row.category_id, row.views, row.comment_count) == ("v1", 10, 100, 3)
    assert (row.tags, row.dislikes, row.trending_date, row.comments_disabled) == ('["m","o"]', None, None, None)
    assert (row.description, row.thumbnail_link) == ("two\nlines", "http://u")
    assert (row.region, row.ingestion_date, row.ingestion_hour) == ("us", BATCH.date, 5)
    assert row._source_file.endswith("region=us/date=2026-08-15/hour=05/20260815_050000.json")
    assert (tmp_path / "silver" / "region=us" / "ingestion_date=2026-08-15" / "ingestion_hour=5").exists()


def test_bad_values_become_null(spark, raw, tmp_path):
    put(raw, [item("a", viewCount="1.5"), item("b", viewCount="1e3"), item("c", viewCount="", publishedAt="x", categoryId="y")])
    silver, _ = load(spark, raw, tmp_path)
    assert {r.video_id: r.views for r in silver.collect()} == {"a": None, "b": None, "c": None}
    row = silver.filter("video_id = 'c'").first()
    assert row.publish_time is None and row.category_id is None


def test_blank_ids_go_and_duplicates_keep_the_first(spark, raw, tmp_path):
    put(raw, [item("a", title="first"), item("a", title="second"), item(""), item(" "), item(None)])
    silver, metrics = load(spark, raw, tmp_path)
    assert [(r.video_id, r.title) for r in silver.collect()] == [("a", "first")]
    counts = {"input_rows": 5, "blank_video_id": 3, "blank_region": 0, "duplicate_rows": 1, "output_rows": 1}
    assert metrics == {"files": 1, "unreadable_files": 0, "rejected_items": 0, **counts}


def test_good_items_of_damaged_files_stay_and_the_rest_is_kept_apart(spark, raw, tmp_path):
    put(raw, [item("a"), "text", item("b")], name="1.json")
    put(raw, None, name="2.json", text='{"items": "text"}')
    put(raw, None, name="3.json", text='{"items": [{"id"')
    put(raw, [{"id": "c", "statistics": "none", "snippet": {"title": 7}}], name="4.json")
    aside = str(tmp_path / "aside")
    for _ in range(2):
        counts = plans.bronze_json_to_silver(spark, str(raw), str(tmp_path / "silver"), BATCH, aside)
    assert (counts["files"], counts["unreadable_files"], counts["rejected_items"], counts["output_rows"]) == (4, 2, 1, 3)
    stored = sources.read_stats(spark, str(tmp_path / "silver")).collect()
    assert {(r.video_id, r.title if r.video_id == "c" else None, r.views is None) for r in stored} >= {("c", "7", True)}
    assert {r.video_id for r in stored} == {"a", "b", "c"}
    rows = spark.read.parquet(aside).collect()
    assert sorted((r.reason, r.content) for r in rows) == [
        ("item is no object", "text"),
        ("unreadable document", '{"items": "text"}'),
        ("unreadable document", '{"items": [{"id"'),
    ]
    report = sinks.envelope_report(sources.read_envelopes(spark, str(raw), keep_corrupt=True)).collect()
    assert sum(r.final_rows for r in report) == 3 and sum(r.incoming_rows for r in report) == 4


def test_counts_are_taken_where_each_task_counts_once(spark, raw, tmp_path):
    """Above the shuffle, in the tasks that write: repeated tasks below it change nothing."""
    from tidemark.plans import silver

    put(raw, [item("a"), item("a"), item(""), "text"], name="1.json")
    put(raw, [], name="2.json")
    envelopes = sources.read_envelopes(spark, str(raw), BATCH, keep_corrupt=True)
    counted = envelopes.withColumn(silver._COUNTS, silver._document_counts(envelopes))
    rows = silver._counted_rows(counted, BATCH).hint("rebalance", F.col("region")).observe("seen", *silver._totals(counted))
    lines = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = next(i for i, line in enumerate(lines) if "CollectMetrics" in line)
    assert above < next(i for i, line in enumerate(lines) if "RebalancePartitions" in line)
    _, metrics = load(spark, raw, tmp_path)
    assert metrics == {"files": 2, "unreadable_files": 0, "rejected_items": 1, "input_rows": 3, "blank_video_id": 1, "blank_region": 0, "duplicate_rows": 1, "output_rows": 1}


def test_a_repaired_batch_leaves_the_quarantine(spark, raw, tmp_path):
    aside, load_ = str(tmp_path / "aside"), lambda batch: plans.bronze_json_to_silver(spark, str(raw), str(tmp_path / "silver"), batch, aside)
    put(raw, None, name="1.json", text='{"items": [{"id"')
    put(raw, [item("a"), "text"], name="2.json", region="in")
    put(raw, None, name="3.json", text="nothing", hour="04")
    load_(BATCH)
    load_(Batch(BATCH.date, 4))
    reasons = lambda: sorted((r.ingestion_hour, r.content) for r in spark.read.parquet(aside).collect())
    assert reasons() == [(4, "nothing"), (5, "text"), (5, '{"items": [{"id"')]
    put(raw, [item("b")], name="1.json")
    load_(BATCH)
    assert reasons() == [(4, "nothing"), (5, "text")]
    put(raw, [item("a")], name="2.json", region="in")
    load_(BATCH)
    assert reasons() == [(4, "nothing")]
    put(raw, [item("c")], name="3.json", hour="04")
    load_(None)
    assert spark.read.schema("content string").parquet(aside).isEmpty()


def test_duplicates_go_without_a_second_shuffle(spark, raw):
    put(raw, [item("a"), item("a")])
    rows = plans.envelopes_to_rows(plans.silver.first_per_video(sources.read_envelopes(spark, str(raw), BATCH)), BATCH)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and rows.count() == 1


def test_two_files_of_one_hour_stay_apart_and_the_later_is_latest(spark, raw, tmp_path):
    put(raw, [item("a", viewCount="1")], name="20260815_050000.json")
    put(raw, [item("a", viewCount="2")], name="20260815_053000.json")
    silver, _ = load(spark, raw, tmp_path)
    assert silver.count() == 2
    assert [r.views for r in plans.latest_snapshots(silver).collect()] == [2]


def test_only_the_batch_is_read_and_other_partitions_survive(spark, raw, tmp_path):
    put(raw, [item("a")], hour="04")
    put(raw, [item("b")], hour="05")
    silver, _ = load(spark, raw, tmp_path, Batch(BATCH.date, 4))
    assert silver.count() == 1
    for _ in range(2):
        silver, _ = load(spark, raw, tmp_path)
    assert sorted((r.video_id, r.ingestion_hour) for r in silver.collect()) == [("a", 4), ("b", 5)]


@pytest.mark.parametrize("items, blank", [([], 0), ([item(" "), item("")], 2)])
def test_a_batch_without_valid_rows_writes_nothing(spark, raw, tmp_path, items, blank):
    put(raw, items)
    metrics = plans.bronze_json_to_silver(spark, str(raw), str(tmp_path / "s"), BATCH)
    assert metrics["input_rows"] == metrics["blank_video_id"] == blank
    assert metrics["output_rows"] == metrics["duplicate_rows"] == 0


def test_schemaless_reading_gives_the_same_rows(spark, raw, rows):
    put(raw, [item("a"), item("b", viewCount="x"), item("a")])
    put(raw, [item("c", tags=None)], region="in")
    typed = plans.silver_from_envelopes(plans.envelopes_to_rows(sources.read_envelopes(spark, str(raw), BATCH), BATCH))
    text = plans.silver_from_envelopes(plans.json_text_to_rows(sources.read_items_schemaless(spark, str(raw), BATCH), BATCH))
    assert rows(typed) == rows(text) and len(rows(typed)) == 3


def test_newest_batch_by_folder(spark, raw):
    put(raw, [item()], hour="04")
    put(raw, [item()], hour="05", region="in")
    (raw / "region=us" / "date=2026-08-16" / "hour=01").mkdir(parents=True)
    (raw / "region=us" / "date=later" / "hour=99").mkdir(parents=True)
    assert sources.discover_latest_batch(spark, str(raw)) == BATCH


def jobs_of(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_hours_of_many_runs_are_listed_by_one_job(spark, raw):
    for hour in ("05", "06", "07"):
        for run in range(40):
            put(raw, [item()], hour=f"{hour}/run={run}", name="part-0.json")
    seen = []
    jobs = jobs_of(spark, "listing", lambda: seen.append(sources.list_files(spark, str(raw))))
    assert jobs == 1
    assert seen[0].count() == 120
    assert jobs_of(spark, "reading", lambda: seen.append(sources.read_envelopes(spark, str(raw)))) == 1
    assert seen[1].count() == 120


def test_files_are_listed_at_any_depth_and_hidden_ones_are_not(spark, raw, rows):
    put(raw, [item()], region="a{b", hour="05/run=1")
    put(raw, [item()], region="us")
    put(raw, [item()], region="us", hour="05/run=1")
    for name in ("_SUCCESS", ".hidden.json", "_aside/x.json", "top.json"):
        (raw / name).parent.mkdir(exist_ok=True)
        (raw / name).write_text("{}")
    paths = [r.path.split("/raw/")[1] for r in sources.list_files(spark, str(raw)).collect()]
    inner = "date=2026-08-15/hour=05"
    name = "20260815_050000.json"
    assert sorted(paths) == [f"region=a{{b/{inner}/run=1/{name}", f"region=us/{inner}/{name}", f"region=us/{inner}/run=1/{name}", "top.json"]
    (raw / "top.json").unlink()
    assert sources.list_files(spark, str(raw)).count() == 3


def test_no_batch_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no valid batch"):
        sources.discover_latest_batch(spark, str(tmp_path))


def test_report_lists_empty_and_broken_files(spark, raw, rows):
    put(raw, [item("a"), item("a"), item("")], region="us")
    put(raw, [], region="in")
    put(raw, None, region="fr", text='{"items": [{"id"')
    report = sinks.envelope_report(sources.read_envelopes(spark, str(raw), keep_corrupt=True))
    assert rows(report, "region", "incoming_rows", "final_rows", "error") == [
        ("fr", 0, 0, "unreadable document"),
        ("in", 0, 0, "no items"),
        ("us", 3, 1, None),
    ]
    summary = sinks.run_summary(report)
    assert rows(summary, "region", "status", "files") == [("fr", "failed", 1), ("in", "failed", 1), ("us", "success", 1)]
    assert len(sinks.report_json(report).collect()) == 3


def test_landing_adds_metadata_and_filters_regions(spark, raw, rows):
    run = dt.datetime(2026, 8, 15, 5, 1, 2, tzinfo=dt.timezone.utc)
    df = spark.createDataFrame([(" US ", [("a",)]), ("in", []), ("xx", [("b",)])], "region string, items array<struct<id:string>>")
    sinks.land_envelopes(df, str(raw), run, "test", regions=["us", " IN"])
    envelopes = sources.read_envelopes(spark, str(raw), BATCH)
    meta = envelopes.select("_pipeline_metadata.*")
    assert rows(meta) == [
        ("20260815_050102", "in", "2026-08-15T05:01:02.000000+00:00", 0, "test"),
        ("20260815_050102", "us", "2026-08-15T05:01:02.000000+00:00", 1, "test"),
    ]
    assert sources.discover_latest_batch(spark, str(raw)) == BATCH


# --- CSV ----------------------------------------------------------------------------------

HEADER = (
    "video_id,trending_date,title,channel_title,category_id,publish_time,tags,views,likes,dislikes,"
    "comment_count,thumbnail_link,comments_disabled,ratings_disabled,video_error_or_removed,description\n"
)


def csv_line(id="a", day="17.14.11", title="T", flag="TRUE", description='"one\ntwo, \\"x\\""'):
    return f"{id},{day},{title},C,10,2017-11-13T17:13:01.000Z,a|b,5,4,3,2,http://u,{flag},False,maybe,{description}\n"


def put_csv(root, text, folder):
    path = root / folder
    path.mkdir(parents=True, exist_ok=True)
    (path / "x.csv").write_text(HEADER + text)


def test_csv_fields_and_quoted_line_breaks(spark, tmp_path):
    put_csv(tmp_path / "raw", csv_line() + csv_line("b", day="99.99.99"), "region=ca/date=2026-08-15")
    metrics = plans.bronze_csv_to_silver(spark, str(tmp_path / "raw"), str(tmp_path / "out"), BATCH.date)
    table = sources.read_stats(spark, str(tmp_path / "out"), SILVER_HISTORY)
    row = table.filter("video_id = 'a'").first()
    assert metrics["output_rows"] == 2 and table.count() == 2
    assert row.description == 'one\ntwo, "x"' and row.trending_date == dt.date(2017, 11, 14)
    assert (row.comments_disabled, row.ratings_disabled, row.video_error_or_removed) == (True, False, None)
    assert row.publish_time == dt.datetime(2017, 11, 13, 17, 13, 1)
    assert table.filter("video_id = 'b'").first().trending_date is None


def test_csv_accepts_both_folder_layouts_and_dedupes_per_day(spark, tmp_path, rows):
    put_csv(tmp_path / "raw", csv_line("a", title="Z") + csv_line("a", title="A") + csv_line(" "), "region=ca")
    put_csv(tmp_path / "raw", csv_line("a"), "region=us/date=2026-08-15")
    plans.bronze_csv_to_silver(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    table = sources.read_stats(spark, str(tmp_path / "out"), SILVER_HISTORY)
    assert rows(table, "video_id", "region", "title") == [("a", "ca", "A"), ("a", "us", "T")]


def test_csv_replaces_everything_or_only_its_regions(spark, tmp_path):
    out = str(tmp_path / "out")
    put_csv(tmp_path / "one", csv_line("a"), "region=ca")
    put_csv(tmp_path / "two", csv_line("b"), "region=us")
    plans.bronze_csv_to_silver(spark, str(tmp_path / "one"), out)
    plans.bronze_csv_to_silver(spark, str(tmp_path / "two"), out, replace_all=False)
    regions = lambda: {r.region for r in sources.read_stats(spark, out, SILVER_HISTORY).collect()}
    assert regions() == {"ca", "us"}
    plans.bronze_csv_to_silver(spark, str(tmp_path / "two"), out)
    assert regions() == {"us"}


def test_csv_external_table(spark, tmp_path):
    put_csv(tmp_path / "raw", csv_line("a") + csv_line("b"), "region=ca")
    sinks.create_csv_table(spark, "raw_csv_test", str(tmp_path / "raw"))
    assert spark.table("raw_csv_test").agg(F.count("*")).first()[0] == 2
    assert spark.table("raw_csv_test").filter("video_id = 'a'").first().description == 'one\ntwo, "x"'
