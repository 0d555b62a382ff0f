import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives
from tidemark.llm.negatives import Candidates, mine_negatives, walk

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, every, positives=5, count=10):
    """The definition over all pairs."""
    width = 6
    usable = {}
    for i, label, v in rows:
        if None not in (i, label, v) and len(v) == width and all(c is not None and math.isfinite(c) for c in v):
            x = (label, [math.floor(256 * c) for c in v])
            usable[i] = min(usable.get(i, x), x)
    out = []
    for a, (label, u) in usable.items():
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(u, v, strict=True)), i, other) for i, (other, v) in usable.items() if i != a]
        for s, i, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted(x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)
            out += [(a, i, r, n, -s, -t) for r, (t, n, _) in enumerate(fits[:count], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, n, v and [None if c is None else float(c) for c in v]) for i, n, v in rows], SCHEMA)


def made(seed, count, noise=0.3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(7, 6))
    return [(i, int(r.integers(4)), (centres[i % 7] * r.uniform(0.5, 2) + noise * r.normal(size=6)).tolist()) for i in range(count)]


@pytest.mark.parametrize("noise, block_bytes, members", [(0.3, 64 << 20, 64), (0.05, 1 << 11, 4), (2.0, 1 << 10, 1)])
def test_against_all_pairs(spark, noise, block_bytes, members):
    rows = made(1, 300, noise) + [(1000 + i, i % 3, [1.0, 1, 1, 1, 1, 1]) for i in range(60)]
    got = mine_negatives(table(spark, rows), F.col("vec_id") % 9 == 0, block_bytes=block_bytes, members=members)
    want = brute(rows, 9)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100


def test_large_components_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(negatives, "EXACT", 0)
    rows = [(i, n, [c * 1e4 for c in v]) for i, n, v in made(2, 80)]
    got = mine_negatives(table(spark, rows), F.col("vec_id") % 5 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5)


def test_walks_end_early():
    """On clustered rows a member certifies its end long before the end of the list."""
    import pyarrow as pa

    r = np.random.default_rng(4)
    centres = np.round(300 * r.normal(size=(40, 16)))
    x = np.repeat(centres, 500, axis=0) + np.round(5 * r.normal(size=(20_000, 16)))
    block = Candidates(pa.table({"vec_id": np.arange(len(x)), "label": np.zeros(len(x), np.int64), "vector": list(x)}), 16)
    seen = []

    def take(members, rows, products):
        seen.append(len(rows))
        best[members] = np.maximum(best[members], products.max(axis=1))
        return best[members]

    u = centres[3] + np.round(5 * r.normal(size=(10, 16)))
    best = np.full(len(u), -np.inf)
    walk(u, block, best.copy(), take)
    assert (best == (u @ x.T).max(axis=1)).all() and sum(seen) < 4000


def test_odd_rows(spark):
    nan, v = float("nan"), [1.0, 2, 3, 4, 5, 6]
    rows = [
        (0, 1, v), (1, 1, v), (1, 1, [1.5] + v[1:]), (2, 2, [0.5, 1, 1.5, 2, 2.5, 3]), (2, 2, [0.5, 1, 1.5, 2, 2.5, 3]), (3, None, v), (4, 1, None), (5, 1, [nan] + v[1:]),
        (6, 1, [float("inf")] + v[1:]), (7, 2, [None, *v[1:]]), (8, 1, v[:3]), (None, 1, v), (9, 1, []), (10, 1, [0.0] * 6), (11, 2, [0.0] * 6),
        (20, 1, [0.0] * 6), (30, 1, [-c for c in v]), (40, 1, v), (40, 1, v), (12, 3, [0.4, 1, 1.5, 2, 2.5, 3]),
    ]
    frame = table(spark, rows).selectExpr("*", "1 AS block", "2 AS round", "3 AS cluster")
    got = mine_negatives(frame, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10)
    condition = F.col("vec_id") % 10 == 0
    assert mine_negatives(table(spark, []), condition).collect() == []
    assert mine_negatives(table(spark, [(1, 1, v)]), condition).collect() == []
    assert mine_negatives(table(spark, [(10, 1, v)]), condition).collect() == []
