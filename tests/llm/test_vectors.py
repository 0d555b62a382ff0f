import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import crosspolytope, kmtree
from tidemark.llm.crosspolytope import CrossPolytope, hadamard, near_vectors, places_for, tables_for
from tidemark.llm.kmtree import Tree, best, nearest

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, rows):
    whole = lambda v: v and [None if c is None else float(c) for c in v]
    return spark.createDataFrame([(i, whole(v)) for i, v in rows], SCHEMA)


def brute(rows, cosine=0.95):
    """(vec_id, links, component) of each row by all pairs."""
    usable = [v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    x = [np.array(v, dtype=np.float32).astype(float) if u else None for (_, v), u in zip(rows, usable, strict=True)]
    n = len(rows)
    near = [[i != j and usable[i] and usable[j] and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= cosine for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, open_ = {i}, [i]
        while open_:
            for j in np.flatnonzero(near[open_.pop()]):
                if j not in seen:
                    seen.add(j)
                    open_.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        name = (min(ids) if ids else None) if usable[i] else rows[i][0]
        out.append((rows[i][0], int(sum(near[i])), name, name == rows[i][0]))
    return sorted(out, key=repr)


def clusters(seed, groups, members, width=8, noise=0.12):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(groups, width))
    return [(centres[i % groups] + noise * random.normal(size=width)).tolist() for i in range(groups * members)]


def test_links_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(crosspolytope, "BLOCK", 16)
    rows = list(enumerate(clusters(1, 12, 12) + clusters(2, 1, 60, noise=0.25) + clusters(3, 30, 1)))
    got = sorted((tuple(r) for r in near_vectors(table(spark, rows)).collect()), key=repr)
    want = brute(rows)
    assert got == want and any(r[1] > 5 for r in want) and any(r[1] == 0 for r in want)


def test_odd_vectors(spark):
    nan = float("nan")
    v, w = [1.0, 2, 3, 4, 5, 6, 7, 8], [8.0, -7, 6, -5, 4, -3, 2, -1]
    rows = [
        (1, v), (2, v), (2, v), (3, [2 * c for c in v]), (4, w), (5, None), (6, []), (7, [0.0] * 8), (8, [nan] + v[1:]),
        (9, [float("inf")] + v[1:]), (10, [None, *v[1:]]), (11, v[:4]), (None, v), (None, [1.0] + [0] * 7), (12, [-0.0] + w[1:]), (13, [0.0] + w[1:]),
    ]
    frame = table(spark, rows).selectExpr("*", "1 AS node", "2 AS bucket", "3 AS links")
    assert sorted((tuple(r) for r in near_vectors(frame).collect()), key=repr) == brute(rows)
    assert near_vectors(table(spark, [])).collect() == []
    assert [tuple(r) for r in near_vectors(table(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def test_hashing():
    x = np.random.default_rng(1).normal(size=(5, 8))
    h = np.array([[1.0]])
    while len(h) < 8:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(hadamard(x), x @ h.T)
    assert CrossPolytope(6, 2, 3).keys(x[:, :6]).shape == (5, 3, 3)
    # Pairs at the threshold meet in one of the tables.
    made = CrossPolytope(64, places_for(10_000, 64), tables_for(64, places_for(10_000, 64), 0.95), seed=99)
    a = np.random.default_rng(2).normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = np.random.default_rng(3).normal(size=a.shape)
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1)[:, None]
    met = (made.keys(a)[:, :, :, None] == made.keys(b)[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.all()


def test_search_against_brute_force(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = frame.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = nearest(frame, F.col("vec_id") % 20 == 0, k=20, leaf_rows=40)
    hits = total = 0
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    at = {v: i for i, v in enumerate(ids)}
    for q in np.flatnonzero(ids % 20 == 0):
        found = sorted(by[ids[q]])
        assert [f[0] for f in found] == list(range(1, 21))
        score = x @ x[q]
        assert max(abs(score[at[v]] - s) for _, v, s in found) < 1e-12
        score[q] = -np.inf
        true = set(ids[np.lexsort((ids, -score))[:20]])
        hits, total = hits + len(true & {v for _, v, _ in found}), total + 20
    assert hits / total >= 0.9


def test_search_blocks_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(kmtree, "BLOCK", 7)
    v = [1.0, 0, 0, 0]
    rows = [(i, v) for i in range(1, 41)] + [(100 + i, [0.5, 0.1 * i, 0, 0]) for i in range(10)]
    rows += [(200, None), (220, [0.0] * 4), (240, [float("nan"), 1, 1, 1]), (260, [1.0, 2]), (None, v), (20, v)]
    frame = table(spark, rows).selectExpr("*", "1 AS leaf", "2 AS query_id", "3 AS rank")
    got = nearest(frame, F.col("vec_id") % 20 == 0, k=5, recall=1.0).collect()
    by = {q: [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    assert set(by) == {20, 40, 100}
    assert by[20] == by[100] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    large = table(spark, [(20, v), *[(2**53 + i, v) for i in (0, 1, 1, 2, 3)]])
    got = nearest(large, F.col("vec_id") == 20, k=5, recall=1.0).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(i + 1, 2**53 + i) for i in range(4)]
    few = table(spark, [(20, v), (1, v)])
    assert [tuple(r) for r in nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 1, 1.0)]
    assert nearest(table(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest(table(spark, [(1, v)]), F.col("vec_id") % 20 == 0).collect() == []


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(7).normal(size=(2000, 6))
    tree = Tree(x, 30)
    assert 20 <= tree.leaves <= 45
    assert sorted(tree.visits(x[0], tree.leaves)) == list(range(tree.leaves))
    assert set(tree.assign(x)) == set(range(tree.leaves))
    i, j, s = best(np.array([-1]), x[:1], np.arange(2000), x, 3)
    assert list(j) == list(np.argsort(-(x @ x[0]), kind="stable")[:3]) and np.allclose(s, np.sort(x @ x[0])[::-1][:3])


def test_tiny_leaves_do_not_cut_the_neighbours(spark):
    """A far cluster of five rows fills a leaf of its own; its query still gets k neighbours."""
    random = np.random.default_rng(11)
    far = [[40.0 + 0.01 * random.normal(), *(0.01 * random.normal(size=5))] for _ in range(5)]
    rows = list(enumerate(far)) + [(100 + i, v) for i, v in enumerate(random.normal(size=(600, 6)).tolist())]
    rows += [(0, far[0]), (1, far[1]), (1, far[1])]
    got = nearest(table(spark, rows), (F.col("vec_id") % 20 == 0), k=20, recall=0.5, leaf_rows=40).collect()
    asked = {i for i, _ in rows if i % 20 == 0}
    by = {q: sorted(r["rank"] for r in got if r.query_id == q) for q in asked}
    assert all(ranks == list(range(1, 21)) for ranks in by.values())
