import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.llm.lines import drop_shared_lines
from tidemark.llm.mixing import mix_sources, mixed_texts, source_targets, split_quotas, taken_words

EDGES = " \t\n\x0b\x0c\r"


def brute_lines(rows, least=20, docs=3):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(EDGES))

    held = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least and d is not None:
                held[key(line)].add(d)
    shared = {k: max(s) for k, s in held.items() if len(s) >= docs}
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if shared.get(key(x), d) == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines(spark):
    a, b, e = "This line is shared by MANY documents", "\t this line is shared by many documents \r", "ÉÉÉ shared line with accents"
    rows = [
        (1, f"{a}\nown\n{a}\n"), (2, f"{b}\n\nx"), (3, a), (4, None), (5, ""), (6, "short\nshort"), (7, "short"),
        (8, "short"), (9, e), (10, e.lower()), (11, e), (12, f"{e}\n{a}"), (None, a), (3, a), (3, f"other\n{a}"),
        (13, "\n".join(f"only line number {i} of a very long text" for i in range(20_000)) + f"\n{a}"), (14, a),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS _docs", "'n' AS n_lines")
    clashing = frame.selectExpr("*", "2 AS _batch", "3 AS _lines", "4 AS keeper", "5 AS N_Dropped", "6 AS `a``b`")
    got = drop_shared_lines(clashing)
    assert got.columns == ["doc_id", "text", "_docs", "_batch", "_lines", "keeper", "a`b", "n_lines", "n_dropped"]
    assert {tuple(r)[2:7] for r in got.collect()} == {(1, 2, 3, 4, 6)}
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == brute_lines(rows)
    assert drop_shared_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def documents(spark, count=60, seed=1):
    random = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        n = int(random.integers(0, 400))
        text = "".join(f"{' ' if k else ''}w{i}_{k}{chr(10) if k % 9 == 0 else ''}" for k in range(n))
        rows.append((i, text, ["a", "b", "c", None, "ß"][i % 5] if i % 3 else "a"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_takes_its_targets(spark):
    docs = documents(spark)
    mix = mix_sources(docs, block_words=64, shard_words=500)
    rows = taken_words(mix).collect()
    sources = {r.doc_id: r.source for r in docs.collect()}
    taken, target, size = defaultdict(int), {}, {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]], size[sources[r.doc_id]] = r.target, r.source_size
    assert len(rows) == docs.count()
    for s in taken:
        assert taken[s] == int(target[s] + 0.5) and target[s] <= 2 * size[s]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    again = taken_words(mix_sources(docs.repartition(7), block_words=64, shard_words=500)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    drawn = mix.drawn.collect()
    per = defaultdict(int)
    for r in drawn:
        per[r.shard] += 1
    assert len(per) == 64 and sum(r.n_words for r in drawn) == sum(r.taken for r in rows)


def test_mixed_texts_hold_the_words_taken(spark):
    docs = documents(spark, 40, 2)
    mix = mix_sources(docs, block_words=50, shard_words=1000)
    taken = {r.doc_id: r.taken for r in taken_words(mix).collect()}
    source = {r.doc_id: r.text for r in docs.collect()}
    words, whole = defaultdict(int), 0
    clashing = mixed_texts(docs.selectExpr("1 AS _words", "*", "2 AS _copies", "3 AS _k1"), mix)
    assert clashing.columns == ["_words", "doc_id", "text", "source", "_copies", "_k1"]
    assert clashing.select("doc_id", "text").exceptAll(mixed_texts(docs, mix).select("doc_id", "text")).isEmpty()
    for r in mixed_texts(docs, mix).collect():
        got, own = r.text.split(), source[r.doc_id].split()
        assert set(got) <= set(own) and len(set(got)) == len(got)
        assert got == sorted(got, key=own.index)
        whole += r.text == source[r.doc_id]
        words[r.doc_id] += len(got)
    assert words == {d: n for d, n in taken.items() if n}
    assert whole > 20


def test_targets_reshare_the_excess(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 500)], "source string, size long")
    got = {r.source: r.target for r in source_targets(sized).collect()}
    total, caps, weights = 1.5 * 1515, {"a": 20, "b": 2000, "c": 10, None: 1000}, {"a": 3, "b": 1, "c": 2, None: 3}
    want, open_, left = {}, set(caps), total
    while True:  # share, stop at the caps, share the excess again
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > caps[s]}
        if not over:
            break
        for s in over:
            want[s] = caps[s]
            left -= caps[s]
        open_ -= over
    want |= {s: level * weights[s] for s in open_}
    assert {s: round(t, 6) for s, t in got.items()} == {s: round(t, 6) for s, t in want.items()}


def test_tree_quotas_are_exact_and_hypergeometric(spark):
    draws = [6000] + [500] * 8
    frame = spark.createDataFrame(list(enumerate(draws)), "src long, draws long")
    rows = split_quotas(frame, 6).collect()
    by_shard, by_source = defaultdict(int), defaultdict(list)
    for r in rows:
        by_shard[r.shard] += r.until - r.begin
        by_source[r.src].append((r.begin, r.until))
    assert len(by_shard) == 64 and max(by_shard.values()) - min(by_shard.values()) <= 1
    for s, ranges in by_source.items():
        ranges.sort()
        assert ranges[0][0] == 0 and ranges[-1][1] == draws[s]
        assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    shares = [u - b for b, u in by_source[0]]
    n, p = sum(draws) / 64, 0.6
    assert abs(np.mean(shares) - n * p) < 1e-9 and 0.6 < np.std(shares) / np.sqrt(n * p * (1 - p)) < 1.5


def test_mix_of_odd_rows(spark):
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "x y z", "a"), (3, "x y z", "a"), (3, "p q", "b"), (None, "only words here", "b"),
        (4, "w " * 50_000, None), (5, "  lead and trail  ", "c"), (6, "", "empty"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS src", "3 AS target")
    mix = mix_sources(frame.drop("size", "src", "target"), block_words=16)
    got = taken_words(mix).collect()
    assert len(got) == len(rows)
    assert all(r.taken == 0 for r in got if r.size == 0) and all(r.taken <= 2 * r.size for r in got)
    texts = mixed_texts(frame, mix)
    assert texts.columns == frame.columns
    assert sum(len(r.text.split()) for r in texts.collect()) == sum(r.taken for r in got)
    assert taken_words(mix_sources(spark.createDataFrame([], "doc_id long, text string, source string"))).collect() == []


def test_main_paths_are_native(spark):
    docs = documents(spark, 10)
    for frame in (drop_shared_lines(docs), taken_words(mix_sources(docs)), mixed_texts(docs, mix_sources(docs))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_digest_of_kept_lines(spark):
    got = drop_shared_lines(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")).select(F.sha2("text", 256)).first()[0]
    assert got == hashlib.sha256(b"a\nb").hexdigest()


def test_whole_documents_only(spark):
    docs = documents(spark, 150, 5)
    long = spark.createDataFrame([(900, "w " * 3000, "b"), (901, "x " * 2500, "c"), (902, "y", "c")], docs.schema)
    docs = docs.unionByName(long)
    text = {r.doc_id: r.text for r in docs.collect()}
    mix = mix_sources(docs, block_words=500, shard_words=2000, whole=True)
    got = mixed_texts(docs, mix).collect()
    assert got and all(r.text == text[r.doc_id] for r in got)
    copies = defaultdict(int)
    for r in got:
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 2
    rows = taken_words(mix).collect()
    assert {r.doc_id: r.taken for r in rows if r.taken} == {d: n * len(text[d].split()) for d, n in copies.items()}
    total, goal = sum(r.taken for r in rows), 1.5 * sum(r.size for r in rows)
    assert abs(total - goal) < 0.01 * goal
    again = mixed_texts(docs, mix_sources(docs.repartition(7), block_words=500, shard_words=2000, whole=True)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    assert not re.search("Python|Pandas|Arrow", mixed_texts(docs, mix)._jdf.queryExecution().executedPlan().toString())


def test_texts_come_by_shard_in_the_order_of_place(spark, tmp_path):
    docs = documents(spark, 150, 5)
    mix = mix_sources(docs, block_words=100, shard_words=500, whole=True)
    drawn = mix.drawn.collect()
    spots = defaultdict(list)
    for r in drawn:
        spots[r.doc_id].append((r.shard, r.place))
    mixed_texts(docs, mix).select(F.spark_partition_id().alias("task"), "doc_id", "source").write.parquet(f"{tmp_path}/mix")
    order = defaultdict(list)
    for file in sorted((tmp_path / "mix").glob("*.parquet")):
        for doc_id in pq.read_table(file).column("doc_id").to_pylist():
            order[file.name].append(doc_id)
    assert sum(map(len, order.values())) == len(drawn)
    once = {d: s[0] for d, s in spots.items() if len(s) == 1}
    homes = defaultdict(set)
    for file, ids in order.items():
        seen = [once[d] for d in ids if d in once]
        assert seen == sorted(seen)
        for shard, _ in seen:
            homes[shard].add(file)
    assert len(homes) > 4 and all(len(files) == 1 for files in homes.values())
    sources = {r.doc_id: r.source for r in docs.collect()}
    longest = [str(sources[d]) for d in max(order.values(), key=len)]
    assert longest != sorted(longest)


def test_every_block_can_move(spark):
    """The end of a source's stream is drawn in the last pass as often as other places."""
    docs = documents(spark, 300, 5)
    sizes = mix_sources(docs, block_words=60, shard_words=100_000, whole=True)
    copies = {(r.src, r.offset): r.n for r in sizes.drawn.groupBy("src", "offset").agg(F.count("*").alias("n")).collect()}
    rows = sizes.sizes.filter("size > 0").collect()
    last = {}
    for r in rows:
        last[r.src] = max(last.get(r.src, 0), r.offset)
    least = {s: min(copies.get((r.src, r.offset), 0) for r in rows if r.src == s) for s in last}
    most = {s: max(copies.get((r.src, r.offset), 0) for r in rows if r.src == s) for s in last}
    mixed = [s for s in last if least[s] != most[s]]
    assert mixed and any(copies.get((s, last[s]), 0) == most[s] for s in mixed)


def test_the_stage_mixes_whole_documents(spark):
    import corpus_pipeline

    rows = [(i, f"d{i} " * (20_000 if i % 7 == 0 else 900), "en", "abc"[i % 3], 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    text = {r[0]: r[1] for r in rows}
    got = corpus_pipeline.mix(spark, docs, "").collect()
    assert got and all(r.text == text[r.doc_id] for r in got)
