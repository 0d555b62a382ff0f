import re

import numpy as np
import pytest

from tidemark.llm import minhash
from tidemark.llm.components import connected_components
from tidemark.llm.minhash import forest, near_duplicates


def shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(rows, width, percent=80):
    """doc_id -> (size, component) by comparing all pairs."""
    sets = [(d, shingles(t, width)) for d, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and d is not None and e is not None and 100 * len(a & b) >= percent * len(a | b):
                p, q = root(d), root(e)
                up[max(p, q)] = min(p, q)
    return {d: (len(s), root(d) if s else d) for d, s in sets if d is not None}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("width", [4, 5])
def test_against_all_pairs(spark, sf, width):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = near_duplicates(frame(spark, rows), width).collect()
    want = brute(rows, width)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert any(not r.kept for r in got)


def family(seed, members, words=120, edits=12):
    """Copies of one text with words replaced: similarities on both sides of the threshold."""
    random = np.random.default_rng(seed)
    base = [f"w{i}" for i in random.integers(0, 10_000, words)]
    out = []
    for _ in range(members):
        text = list(base)
        for at in random.integers(0, words, random.integers(0, edits)):
            text[at] = f"x{random.integers(0, 50)}"
        out.append(" ".join(text))
    return out


def test_large_group_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SETS", 20)
    rows = list(enumerate(family(1, 90) + family(2, 40) + family(3, 30)))
    got = near_duplicates(frame(spark, rows), 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, 4)


def test_odd_rows(spark):
    long = " ".join(f"a{i}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"),
        (7, long), (8, long.upper()), (8, long.upper()), (9, "É é"), (10, "é é"),
        (None, "one two"), (None, "nobody else has this"), (11, "p q r s t u"), (11, "v w x y z 1"), (12, "v w x y z 1"),
    ]
    odd = frame(spark, rows).selectExpr("doc_id", "text", "'x' AS node", "1 AS bands", "2 AS component_id", "3 AS kept")
    got = sorted((tuple(r) for r in near_duplicates(odd).collect()), key=repr)
    expected = [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True),
        (7, 59_996, 7, True), (8, 59_996, 7, False), (8, 59_996, 7, False), (9, 1, 9, True), (10, 1, 10, True),
        (None, 1, 4, False), (None, 1, None, True), (11, 2, 11, True), (11, 2, 11, True), (12, 2, 11, False),
    ]
    assert got == sorted(expected, key=repr)


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).collect() == []


def test_forest_connects_what_links_connect():
    random = np.random.default_rng(4)
    base = random.integers(0, 1 << 62, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[random.random(400) < 0.93], random.integers(0, 1 << 62, 20, dtype=np.uint64)])) for _ in range(40)]
    links = forest(sets, np.zeros(40, np.int8), 80, 150)
    assert len(links) < 40

    def groups(pairs):
        label = list(range(40))
        for _ in range(40):
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
        return label

    every = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert groups(links) == groups(every)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 150), (7, 7), (None, 3)] + [(500, 500 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 150: 100, 200: 100, **{500 + i: 500 for i in range(50)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
