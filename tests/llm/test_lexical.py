import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import lexical
from tidemark.llm.lexical import rank_documents, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(docs, items, k):
    """The definition, document by document."""
    bags = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for doc, bag, n in bags:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
                for t in words(text)
                if bag[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def texts(seed, count):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünder", "ÉCLAIR", "a_b", "x-Y", "漢字"]
    made = [" ".join(r.choices(vocabulary, k=r.randrange(1, 12))) for _ in range(count)]
    return made + [made[0]] * 25 + [made[1]] * 3


@pytest.mark.parametrize("cells, wide, size", [(1 << 22, 1 << 12, 1 << 20), (40, 3, 60)])
def test_against_the_definition(spark, monkeypatch, cells, wide, size):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "TERMS", wide)
    docs = list(enumerate(texts(1, 120), 5))
    random.Random(3).shuffle(docs)
    items = list(enumerate(texts(2, 12)))
    got = rank_documents(*frames(spark, docs, items), k=7, block_bytes=size)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 7)


def test_large_weights_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(lexical, "EXACT", 0)
    docs, items = list(enumerate(texts(4, 40))), list(enumerate(texts(5, 3)))
    got = rank_documents(*frames(spark, docs, items), k=5)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 5)


def test_terms_are_not_cut(monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 5)
    text = "abc defghijklmnop  Q\x00R\x7fé12_ß漢 z" * 3
    assert [t.decode() for some in terms(text.encode()) for t in some] == words(text)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "..!"), (None, "b a"), (4, "a b"), (4, "a b"), (5, "a"), (6, "A" * 3_000_000), (7, "b " * 400_000)]
    items = [(1, "a a B"), (2, None), (3, ""), (None, "b"), (4, "zzz")]
    d, i = frames(spark, docs, items)
    d, i = d.selectExpr("*", "1 AS h", "2 AS bag", "'t' AS TERMS"), i.selectExpr("*", "1 AS item", "2 AS score")
    assert sorted((tuple(r) for r in rank_documents(d, i, k=20).collect()), key=repr) == brute(docs, items, 20)
    none = frames(spark, [], [])
    assert rank_documents(none[0], i).collect() == rank_documents(d, none[1]).collect() == []
    assert rank_documents(d.filter("doc_id <= 3"), i).collect() == []


def test_a_large_class_sends_few_rows(spark):
    """Of a class that holds most documents, each task sends k rows at most to rank its members."""
    docs = [(i, "a b c") for i in range(4000)] + [(5000 + i, f"a {i}") for i in range(50)]
    d, i = frames(spark, docs, [(1, "b")])
    got = rank_documents(d, i, k=3)
    assert [(r.rank, r.doc_id) for r in got.orderBy("rank").collect()] == [(1, 0), (2, 1), (3, 2)]
    assert got._jdf.queryExecution().toString().count("WindowGroupLimit") >= 2
