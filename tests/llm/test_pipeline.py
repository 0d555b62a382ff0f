import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import tokenizers

import corpus_pipeline
from tidemark.llm.quality import keep_quality
from test_lines_mixing import brute_lines
from test_minhash import brute


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, out = docs, {}
    for name, function in corpus_pipeline.STAGES:
        function(spark, before, sf).write.parquet(f"{tmp_path}/{name}")
        before = out[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe":
            assert before.columns == docs.columns
    text = {n: {r.doc_id: r.text for r in f.collect()} for n, f in out.items() if n not in ("bpe", "mix")}
    kept = {r.doc_id for r in keep_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert set(text["quality"]) == kept and 100 < len(kept) < 200
    lines = brute_lines(list(text["quality"].items()))
    assert text["line_dedup"] == {d: t for d, t, _, _ in lines}
    groups = brute(list(text["line_dedup"].items()), 5)
    assert set(text["near_dedup"]) == {d for d, (_, c) in groups.items() if c == d}
    mixed = out["mix"].collect()
    words = {d: len(t.split()) for d, t in text["near_dedup"].items()}
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert all(taken[d] <= 2 * words[d] for d in taken)
    assert abs(sum(taken.values()) - 1.5 * sum(words.values())) < 30
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def row(r):
        ids = library.encode(r.text, add_special_tokens=False).ids
        return r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()

    assert sorted(tuple(r) for r in out["bpe"].collect()) == sorted(map(row, mixed))


def test_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "words without an id here", None, "a", 3), (3, "same words again and more", "en", "b", 1), (3, "same words again and more", "en", "b", 1), (4, "long " * 50_000, "en", None, 9)]
    for k, rows in enumerate((odd, [])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{k}")
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert {r.doc_id for r in got.collect()} <= {None, 3, 4}


def test_tokens_are_made_of_few_texts_at_a_time(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([len(batch)])], names=["n"])

    monkeypatch.setattr(corpus_pipeline, "round_trip", lambda docs, _: docs.mapInArrow(sizes, "n long"))
    docs = spark.range(3000).selectExpr("id AS doc_id", "'a b' AS text").coalesce(1)
    got = [r.n for r in corpus_pipeline.bpe(spark, docs, "").collect()]
    assert sum(got) == 3000 and max(got) <= corpus_pipeline.TEXTS_PER_BATCH < 1000
    assert spark.conf.get(key) == before
