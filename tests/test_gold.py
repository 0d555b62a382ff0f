import datetime as dt
import random

import pytest
from pyspark.sql import types as T
from pyspark.sql import functions as F

from tidemark import operators as ops
from tidemark import plans, sinks, sources
from tidemark.operators.keys import Batch
from tidemark.layout import Layout
from tidemark.schemas import (
    ALL_STATS,
    GOLD,
    SILVER_HISTORY,
    SILVER_HISTORY_PARTITIONS,
    SILVER_STATS,
    SILVER_STATS_PARTITIONS,
)

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
SCHEMA = (
    "video_id string, region string, category_id int, views long, likes long, comment_count long, "
    "ingestion_date date, ingestion_hour int, _source_file string"
)
REFERENCE = [("1", "in", "One"), ("1", "us", "Uno"), ("2", "us", "Two"), ("abc", "us", "Text")]


def stats_frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).withColumn("title", F.concat(F.lit("t-"), "video_id"))


def dim_frame(spark):
    return ops.canonical_dim(spark.createDataFrame(REFERENCE, "id string, region string, snippet_title string"))


def as_dict(df, *key):
    return {tuple(r[k] for k in key): r for r in df.collect()}


def test_engagement_counts_every_snapshot_and_the_others_only_the_latest(spark):
    stats = stats_frame(spark, [
        ("a", "us", 1, 100, 10, None, D1, 1, "f"),
        ("a", "us", 1, 300, 20, 2, D2, 1, "f"),
        ("b", "us", 1, 0, None, None, D2, 1, "f"),
        ("c", "us", 2, 0, 1, 1, D2, 1, "f"),
        ("d", "us", 9, 5, 1, 1, D2, 1, "f"),
        ("e", "us", None, 5, 1, 1, D2, 1, "f"),
    ])
    dim, latest = dim_frame(spark), plans.latest_snapshots(stats)
    engagement = as_dict(plans.category_engagement(stats, dim), "category_id")
    assert set(engagement) == {("1",), ("2",)}
    one = engagement["1",]
    assert (one.category_name, one.total_views, one.total_likes, one.total_comments) == ("One", 400, 30, 2)
    assert one.engagement_rate == 8.0 and engagement["2",].engagement_rate is None
    once = as_dict(plans.category_engagement(latest, dim), "category_id")
    assert once["1",].total_views == 300
    performance = as_dict(plans.category_performance(latest, dim), "category_id")["1",]
    assert (performance.video_count, performance.total_views, performance.avg_views, performance.avg_likes) == (2, 300, 150.0, 20.0)
    region = as_dict(plans.category_region(latest, dim), "region", "category_id")
    assert region["us", "2"].total_likes == 1


def test_rankings_order_ties_and_missing_views(spark):
    stats = stats_frame(spark, [
        ("b", "us", 1, 5, 0, 0, D1, 1, "f"), ("a", "us", 1, 5, 0, 0, D1, 1, "f"), ("a", "in", 1, 5, 0, 0, D1, 1, "f"),
        ("z", "us", 1, 9, 0, 0, D1, 1, "f"), ("n", "us", 1, None, 0, 0, D1, 1, "f"), ("q", "us", 9, 99, 0, 0, D1, 1, "f"),
    ])
    latest, dim = plans.latest_snapshots(stats), dim_frame(spark)
    ranks = plans.video_rankings(latest, dim, k=5)
    assert [(r.video_id, r.region) for r in ranks.orderBy("video_rank").collect()] == [
        ("z", "us"), ("a", "in"), ("a", "us"), ("b", "us"), ("n", "us")]
    assert plans.video_rankings(latest, dim).count() == 3


@pytest.mark.parametrize("name, frame", [
    ("category_engagement", plans.category_engagement), ("category_performance", plans.category_performance),
    ("category_region", plans.category_region), ("video_rankings", plans.video_rankings)])
def test_results_have_the_declared_types(spark, name, frame):
    stats = stats_frame(spark, [("a", "us", 1, 1, 1, 1, D1, 1, "f")])
    assert [(f.name, f.dataType) for f in frame(stats, dim_frame(spark)).schema] == [
        (f.name, f.dataType) for f in GOLD[name][0]]


def test_ties_within_an_hour_go_to_the_later_file(spark):
    stats = stats_frame(spark, [
        ("a", "us", 1, 1, 1, 1, D1, 1, "20240101_010000.json"), ("a", "us", 2, 2, 1, 1, D1, 1, "20240101_013000.json")])
    assert [r.views for r in plans.latest_snapshots(stats).collect()] == [2]


# --- incremental refresh over tables ------------------------------------------------------


def write_stats(spark, layout, data):
    frame = ops.conform(stats_frame(spark, data), SILVER_STATS)
    sinks.write_partitions(frame, layout.stats, SILVER_STATS_PARTITIONS)


def refresh(spark, layout, prefix, batch, **options):
    names = sinks.register_tables(spark, layout, prefix)
    reference = spark.createDataFrame(REFERENCE, "id string, region string, snippet_title string")
    return names, plans.silver_to_gold(spark.table(names["stats"]), reference, batch, names, **options)


def gold(spark, layout, name):
    schema, _ = GOLD[name]
    return sorted(tuple(r) for r in spark.read.schema(schema).parquet(layout.gold(name)).collect())


def make_history(seed, hours=4):
    pick = random.Random(seed)
    return [
        (f"v{pick.randrange(6)}", pick.choice(["us", "in"]), pick.choice([1, 1, 2, 9]), pick.randrange(100),
         pick.randrange(9), pick.randrange(9), D1, hour, f"f{n}")
        for hour in range(hours) for n in range(6)
    ]


def test_incremental_refresh_equals_a_full_recompute_on_touched_keys(spark, tmp_path):
    layout, data = Layout(str(tmp_path)), make_history(1)
    for hour in range(4):
        write_stats(spark, layout, [r for r in data if r[7] == hour])
        names, counts = refresh(spark, layout, "inc_", Batch(D1, hour))
        new = [r for r in data if r[7] == hour]
        assert counts == {
            "new_rows": len(new),
            "affected_categories": len({r[2] for r in new}),
            "affected_pairs": len({(r[1], r[2]) for r in new}),
            "facts_without_name": sum(r[2] == 9 for r in new),
        }
    stats, dim = sources.read_stats(spark, layout.stats), dim_frame(spark)
    latest = plans.latest_snapshots(stats)
    batch = {(r[1], r[2]) for r in data if r[7] == 3}
    full = {
        "category_engagement": plans.category_engagement(stats, dim),
        "category_performance": plans.category_performance(latest, dim),
        "category_region": plans.category_region(latest, dim),
        "video_rankings": plans.video_rankings(latest, dim),
    }
    for name, expected in full.items():
        by = GOLD[name][1]
        pick = (lambda r: (r.region, int(r.category_id)) in batch) if "region" in by else (
            lambda r: int(r.category_id) in {c for _, c in batch})
        stored = spark.read.schema(GOLD[name][0]).parquet(layout.gold(name))
        assert sorted(tuple(r) for r in stored.collect() if pick(r)) == sorted(tuple(r) for r in expected.collect() if pick(r))


def test_runs_with_state_equal_a_full_recompute(spark, tmp_path):
    """New batches, one late, one repeated with other content, one repeated empty, and a moved video."""
    layout, state = Layout(str(tmp_path)), str(tmp_path / "state")
    loads = [(hour, [r for r in make_history(7, hours=6) if r[7] == hour]) for hour in (0, 1, 3, 4)]
    loads.append((2, [r for r in make_history(8, hours=6) if r[7] == 2]))  # late
    loads.append((4, [("v1", "us", 2, 500, 1, 1, D1, 4, "again"), ("v9", "in", 1, 3, 1, 1, D1, 4, "again")]))
    loads.append((5, [("v1", "us", 1, 900, 1, 1, D1, 5, "moved")]))
    loads.append((5, [("v0", "us", 2, 1, 1, 1, D1, 5, "instead")]))
    loads.append((4, loads[5][1]))
    dim = dim_frame(spark)
    for step, (hour, data) in enumerate(loads):
        write_stats(spark, layout, data)
        for gone in set(p.name for p in (tmp_path / "silver" / "video_statistics_v2").iterdir() if p.is_dir()) - {f"region={r[1]}" for r in data}:
            folder = tmp_path / "silver" / "video_statistics_v2" / gone / f"ingestion_date={D1}" / f"ingestion_hour={hour}"
            if folder.exists():  # the whole batch is replaced
                for file in folder.iterdir():
                    file.unlink()
                folder.rmdir()
        names = sinks.register_tables(spark, layout, "state_")
        reference = spark.createDataFrame(REFERENCE, "id string, region string, snippet_title string")
        plans.silver_to_gold(spark.table(names["stats"]), reference, Batch(D1, hour), names, state=state, include_previous=True)
        stats = sources.read_stats(spark, layout.stats)
        latest = plans.latest_snapshots(stats)
        full = {
            "category_engagement": plans.category_engagement(stats, dim),
            "category_performance": plans.category_performance(latest, dim),
            "category_region": plans.category_region(latest, dim),
            "video_rankings": plans.video_rankings(latest, dim),
        }
        for name, expected in full.items():
            assert gold(spark, layout, name) == sorted(tuple(r) for r in expected.collect()), (step, name)


def replace_batch(spark, layout, hour, data):
    """The whole batch is what ``data`` holds."""
    from tidemark.session import delete_folder, glob_paths

    for folder in glob_paths(spark, f"{layout.stats}/region=*/ingestion_date={D1}/ingestion_hour={hour}"):
        delete_folder(spark, folder)
    if data:
        write_stats(spark, layout, data)


def with_state(spark, layout, prefix, hour):
    names = sinks.register_tables(spark, layout, prefix)
    reference = spark.createDataFrame(REFERENCE, "id string, region string, snippet_title string")
    plans.silver_to_gold(
        spark.table(names["stats"]), reference, Batch(D1, hour), names, state=f"{layout.root}/state", include_previous=True
    )


def assert_full(spark, layout, note):
    """The Gold tables are those of a full recompute."""
    stats, dim = sources.read_stats(spark, layout.stats), dim_frame(spark)
    latest = plans.latest_snapshots(stats)
    full = {
        "category_engagement": plans.category_engagement(stats, dim),
        "category_performance": plans.category_performance(latest, dim),
        "category_region": plans.category_region(latest, dim),
        "video_rankings": plans.video_rankings(latest, dim),
    }
    for name, expected in full.items():
        assert gold(spark, layout, name) == sorted(tuple(r) for r in expected.collect()), (note, name)


@pytest.mark.parametrize("first_run", [True, False])
def test_a_run_that_ends_anywhere_is_made_good_by_the_next(spark, tmp_path, monkeypatch, first_run):
    from pyspark.sql.readwriter import DataFrameWriter

    from tidemark.plans import state

    plain, text, left = DataFrameWriter.parquet, state.write_text, [0]

    def counted(function):
        def run(*args, **options):
            left[0] -= 1
            if left[0] == 0:
                raise RuntimeError("killed")
            return function(*args, **options)

        return run

    crash, done = 1, False
    while not done:
        layout = Layout(str(tmp_path / str(crash)))
        prefix = f"crash_{first_run}_{crash}_"
        write_stats(spark, layout, [("a", "us", 1, 5, 1, 1, D1, 0, "f"), ("b", "in", 2, 6, 1, 1, D1, 0, "f")])
        if not first_run:
            write_stats(spark, layout, [("a", "us", 2, 7, 1, 1, D1, 1, "f"), ("c", "in", 1, 8, 1, 1, D1, 1, "f")])
            with_state(spark, layout, prefix, 1)
            replace_batch(spark, layout, 1, [("b", "in", 1, 9, 1, 1, D1, 1, "again")])
        monkeypatch.setattr(DataFrameWriter, "parquet", counted(plain))
        monkeypatch.setattr(state, "write_text", counted(text))
        left[0] = crash
        try:
            with_state(spark, layout, prefix, 0 if first_run else 1)
            done = True
        except RuntimeError:
            pass
        monkeypatch.undo()
        with_state(spark, layout, prefix, 0 if first_run else 1)
        assert_full(spark, layout, crash)
        crash += 5
    assert crash > 9


def test_keys_of_a_run_that_was_not_published_are_published_by_another(spark, tmp_path, monkeypatch):
    from tidemark.plans import gold as module

    layout = Layout(str(tmp_path))
    write_stats(spark, layout, [("a", "us", 1, 5, 1, 1, D1, 0, "f"), ("b", "in", 2, 6, 1, 1, D1, 0, "f")])
    with_state(spark, layout, "pend_", 0)
    write_stats(spark, layout, [("a", "us", 2, 7, 1, 1, D1, 1, "f")])
    with_state(spark, layout, "pend_", 1)
    replace_batch(spark, layout, 1, [("c", "in", 1, 3, 1, 1, D1, 1, "again")])

    def fails(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(module, "replace_affected", fails)
    with pytest.raises(RuntimeError):
        with_state(spark, layout, "pend_", 1)
    monkeypatch.undo()
    write_stats(spark, layout, [("d", "us", 1, 4, 1, 1, D1, 2, "f")])
    with_state(spark, layout, "pend_", 2)
    assert_full(spark, layout, "pending")


def test_a_batch_loaded_again_without_odd_regions_leaves_none_of_their_rows(spark, tmp_path):
    layout = Layout(str(tmp_path))
    write_stats(spark, layout, [("a", "a:b", 1, 5, 1, 1, D1, 0, "f"), ("a", "us", 2, 6, 1, 1, D1, 0, "f")])
    with_state(spark, layout, "odd_", 0)
    write_stats(spark, layout, [("b", "a:b", 2, 7, 1, 1, D1, 1, "f"), ("b", None, 1, 8, 1, 1, D1, 1, "f"), ("a", "us", 1, 9, 1, 1, D1, 1, "f")])
    with_state(spark, layout, "odd_", 1)
    replace_batch(spark, layout, 1, [("a", "us", 1, 9, 1, 1, D1, 1, "f")])
    with_state(spark, layout, "odd_", 1)
    assert_full(spark, layout, "odd")


def test_what_a_batch_writes_does_not_grow_with_history(spark, tmp_path, monkeypatch):
    """And segments are merged without changing a result."""
    from tidemark.plans import state

    monkeypatch.setattr(state, "FAN", 3)
    facts = ops.conform(stats_frame(spark, [(f"v{i}", "us", i % 3, i, 1, 1, D1, 0, "f") for i in range(20_000)]), SILVER_STATS)
    kept, written, rows = state.GoldState(spark, str(tmp_path / "state")), [], facts
    for hour in range(6):
        if hour:
            some = [(f"v{i}", "us", 1, 7 * i, 1, 1, D1, hour, "f") for i in range(hour * 100, hour * 100 + 150)]
            rows = rows.unionByName(ops.conform(stats_frame(spark, some), SILVER_STATS))
        before = {s["path"] for s in kept.manifest()["segments"]} if hour else set()
        kept.update(rows, Batch(D1, hour), str(tmp_path / "work" / str(hour)))
        kept.published()
        written.append(sum(s["bytes"] for s in kept.manifest()["segments"] if s["path"] not in before))
    segments = kept.manifest()["segments"]
    assert len(segments) < 6 and {s["level"] for s in segments} == {0, 1, state.BASE}
    assert max(written[1:]) < written[0] / 10
    assert len(list((tmp_path / "state" / "segments").iterdir())) <= len(segments) + 4
    columns = ["video_id", "region", *plans.snapshots.MEASURES]
    got, want = kept.latest().select(*columns), plans.latest_snapshots(rows).select(*columns)
    assert sorted(got.collect()) == sorted(want.collect())
    assert kept.sums().agg(F.sum("views")).first()[0] == rows.agg(F.sum("views")).first()[0]


def test_a_new_batch_does_not_read_all_facts(spark, tmp_path, monkeypatch):
    """With state, facts are only read through the filter on the batch."""
    layout, state = Layout(str(tmp_path)), str(tmp_path / "state")
    write_stats(spark, layout, [r for r in make_history(1) if r[7] < 2])
    names = sinks.register_tables(spark, layout, "part_")
    reference = spark.createDataFrame(REFERENCE, "id string, region string, snippet_title string")
    plans.silver_to_gold(spark.table(names["stats"]), reference, Batch(D1, 1), names, state=state)
    for folder in (tmp_path / "silver" / "video_statistics_v2").glob("region=*/*/ingestion_hour=[01]"):
        for file in folder.glob("*.parquet"):
            file.write_bytes(b"unreadable")
        for file in folder.glob(".*.crc"):
            file.unlink()
    write_stats(spark, layout, [r for r in make_history(1) if r[7] == 2])
    sinks.register_tables(spark, layout, "part_")
    counts = plans.silver_to_gold(spark.table(names["stats"]), reference, Batch(D1, 2), names, state=state)
    assert counts["new_rows"] == 6


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    layout = Layout(str(tmp_path))
    write_stats(spark, layout, make_history(2, hours=2))
    refresh(spark, layout, "rep_", Batch(D1, 1))
    before = {name: gold(spark, layout, name) for name in GOLD}
    refresh(spark, layout, "rep_", Batch(D1, 1))
    assert before == {name: gold(spark, layout, name) for name in GOLD} and before["video_rankings"]


def test_a_batch_that_touches_nothing_stops_early(spark, tmp_path):
    layout = Layout(str(tmp_path))
    write_stats(spark, layout, make_history(3, hours=1))
    _, counts = refresh(spark, layout, "none_", Batch(D2, 7))
    assert set(counts.values()) == {0}


def test_emptied_partitions_disappear_and_untouched_ones_stay(spark, tmp_path):
    layout = Layout(str(tmp_path))
    first = [("a", "us", 1, 5, 0, 0, D1, 1, "f"), ("b", "us", 2, 6, 0, 0, D1, 1, "f")]
    write_stats(spark, layout, first)
    refresh(spark, layout, "emp_", Batch(D1, 1))
    assert [r[-1] for r in gold(spark, layout, "video_rankings")] == ["1", "2"]
    # Within one later batch the only video of category 1 moves to category 2.
    write_stats(spark, layout, [("a", "us", 1, 7, 0, 0, D1, 2, "f1"), ("a", "us", 2, 8, 0, 0, D1, 2, "f2")])
    names, _ = refresh(spark, layout, "emp_", Batch(D1, 2))
    assert {r[-1] for r in gold(spark, layout, "video_rankings")} == {"2"}
    assert {r[-1] for r in gold(spark, layout, "category_region")} == {"2"}
    assert spark.table(names["video_rankings"]).filter("category_id = '1'").isEmpty()
    # All snapshots still count for engagement.
    assert {r[-1] for r in gold(spark, layout, "category_engagement")} == {"1", "2"}


def test_left_categories_are_refreshed_only_on_request(spark, tmp_path):
    layout = Layout(str(tmp_path))
    write_stats(spark, layout, [("a", "us", 1, 5, 0, 0, D1, 1, "f")])
    refresh(spark, layout, "mov_", Batch(D1, 1))
    write_stats(spark, layout, [("a", "us", 2, 8, 0, 0, D1, 2, "f")])
    refresh(spark, layout, "mov_", Batch(D1, 2))
    assert {r[-1] for r in gold(spark, layout, "category_performance")} == {"1", "2"}
    refresh(spark, layout, "mov_", Batch(D1, 2), include_previous=True)
    assert {r[-1] for r in gold(spark, layout, "category_performance")} == {"2"}


def test_view_over_history_and_current_facts(spark, tmp_path):
    layout = Layout(str(tmp_path))
    write_stats(spark, layout, [("a", "us", 1, 5, 0, 0, D1, 1, "f")])
    history = stats_frame(spark, [("a", "us", 2, 9, 0, 0, None, None, "h"), ("h", "us", 2, 1, 0, 0, None, None, "h")])
    sinks.replace_dataset(ops.conform(history, SILVER_HISTORY), layout.history, SILVER_HISTORY_PARTITIONS)
    names = sinks.register_tables(spark, layout, "view_")
    for temporary, view in ((True, "view_temp"), (False, "view_all")):
        sinks.create_all_stats_view(spark, view, names["history"], names["stats"], temporary)
        df = spark.table(view)
        assert df.columns == ALL_STATS.names and df.count() == 3
        latest = {(r.video_id): r.category_id for r in plans.latest_snapshots(df).collect()}
        assert latest == {"a": 1, "h": 2}


def test_run_latest_end_to_end_is_idempotent(spark, tmp_path):
    layout = Layout(str(tmp_path))
    items = "array<struct<id:string,snippet:struct<title:string,categoryId:string>,statistics:struct<viewCount:string>>>"
    for hour, views in ((4, "10"), (5, "20")):
        df = spark.createDataFrame([("us", [("a", ("T", "1"), (views,))])], f"region string, items {items}")
        sinks.land_envelopes(df, layout.raw_stats, dt.datetime(2024, 1, 1, hour, tzinfo=dt.timezone.utc), "test")
    plans.bronze_json_to_silver(spark, layout.raw_stats, layout.stats, Batch(D1, 4))
    docs = spark.createDataFrame([("us", [("1", ("One",))])], "region string, items array<struct<id:string,snippet:struct<title:string>>>")
    sinks.land_reference(docs, layout.raw_reference, dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), "test")
    plans.upsert_reference(spark, layout.raw_reference, layout.reference)
    results = []
    for source in ("stats", "stats", "all_stats"):
        outcome = plans.run_latest(spark, layout, prefix="run_", source=source)
        assert outcome["batch"] == Batch(D1, 5) and outcome["metrics"]["output_rows"] == 1
        results.append({name: gold(spark, layout, name) for name in GOLD})
    assert results[0] == results[1] == results[2]
    assert results[0]["category_engagement"] == [("One", 30, None, None, None, "1")]
    assert results[0]["video_rankings"] == [("a", "T", "One", "us", 20, 1, "1")]
    assert spark.table(outcome["tables"]["all_stats"]).count() == 2
    assert spark.table(outcome["tables"]["reference"]).count() == 1
    assert spark.table(outcome["tables"]["video_rankings"]).first().video_id == "a"


def test_replacing_a_few_partitions_costs_a_few_statements(spark, tmp_path, monkeypatch):
    """However many other partitions there are."""
    schema, path = T.StructType().add("n", "long").add("k", "string"), str(tmp_path / "t")
    sinks.write_partitions(spark.range(1000).selectExpr("id AS n", "cast(id AS string) AS k"), path, ["k"])
    sinks.create_table(spark, "many_partitions", schema, path, ["k"])
    sinks.repair_table(spark, "many_partitions")
    said, plain = [], type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **b: said.append(text) or plain(self, text, *a, **b))
    new = spark.createDataFrame([(-1, "1"), (-2, "2"), (-3, "new")], "n long, k string")
    affected = spark.createDataFrame([(str(k),) for k in (1, 2, 3, 4, 5, "new")], "k string")
    sinks.replace_affected(new, affected, "many_partitions", ["k"])
    assert len(said) <= 4 and not any("REPAIR" in text for text in said)
    stored = {r.k: r.n for r in spark.table("many_partitions").collect()}
    assert len(stored) == 998 and stored["1"] == -1 and stored["new"] == -3 and not {"3", "4", "5"} & set(stored)
    assert spark.read.parquet(path).count() == 998
