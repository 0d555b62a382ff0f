"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

1. A tree is fitted on a sample of at most ``2 * sample`` vectors, chosen by hash; its leaves number one
   for ``leaf_rows`` rows, up to ``sample / 16``. Every vector is then indexed: it walks down to its leaf.
2. A query visits leaves in the order of a priority queue: the open node whose centre has the largest
   inner product with it (plus its radius) is opened next.
3. How many leaves a query visits is calibrated: for ``calibration`` queries, chosen by hash, the true
   neighbours among all vectors are found block by block, and visits are widened until the share
   ``recall`` of them lies in visited leaves. A query goes on beyond that number until the visited leaves
   hold ``k`` rows of other ids for certain, or all leaves are visited.
4. Queries meet leaves in a shuffle. Large leaves and large query sets are split into blocks, and each
   pair of blocks is one task's work: a matrix product finds candidates, products in double precision
   added in order rank them. Each block keeps the nearest ``k`` of each query; a window keeps the best.

The tree, the number of ids in each leaf and the calibration queries are all that is broadcast; both have fixed bounds.

Defined cases. Vectors that are null, empty, zero, hold null or non-finite components or differ in length
from most, and rows without vec_id, take no part. Repeated rows count once; rows of one vec_id with
different vectors are separate candidates, and the least of the vectors is the query. A query with fewer
candidates than ``k`` gets all of them. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vectors import dimension, matrix, products, real, usable
from tidemark.session import scratch, stage

SAMPLE, LEAF_ROWS, BRANCHES = 16_384, 4_096, 8
CALIBRATION, RECALL = 256, 0.95
BLOCK = 4_096


def _kmeans(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[random.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        for c in range(k):
            own = x[near == c]
            centres[c] = own.mean(axis=0) if len(own) else x[random.integers(len(x))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


class Tree:
    """Nodes as arrays: centre, radius, children (none for a leaf) and the leaf's number."""

    def __init__(self, x: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = 5):
        self.centres, self.radius, self.children, self.leaf = [], [], [], []
        self.leaves = 0
        self._grow(x, max(1, leaves), branches, np.random.default_rng(seed))
        self.centres, self.radius = np.array(self.centres), np.array(self.radius)

    def _grow(self, x: np.ndarray, leaves: int, branches: int, random: np.random.Generator) -> int:
        node = len(self.centres)
        centre = x.mean(axis=0)
        self.centres.append(centre)
        self.radius.append(float(np.sqrt(((x - centre) ** 2).sum(axis=1).mean())))
        self.children.append([])
        self.leaf.append(-1)
        parts = []
        if leaves > 1 and len(x) > 1:
            centres = _kmeans(x, min(branches, leaves, len(x)), random)
            near = _nearest(x, centres)
            parts = [x[near == c] for c in range(len(centres)) if (near == c).any()]
        if len(parts) > 1:
            for part in parts:
                share = max(1, round(leaves * len(part) / len(x)))
                self.children[node].append(self._grow(part, share, branches, random))
        else:
            self.leaf[node] = self.leaves
            self.leaves += 1
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), dtype=np.int32)
        open_ = [(0, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            children = self.children[node]
            if not children:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = _nearest(x[rows], self.centres[children])
                open_ += [(child, rows[near == c]) for c, child in enumerate(children)]
        return out

    def visits(self, query: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first, and more until they hold ``least`` of ``held`` rows."""
        score = -(self.centres @ query + self.radius * float(np.sqrt(query @ query)))
        queue, found, rows = [(score[0], 0)], [], 0
        while queue and (len(found) < most or rows < least):
            _, node = heapq.heappop(queue)
            for child in self.children[node]:
                heapq.heappush(queue, (score[child], child))
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
                rows += 0 if held is None else int(held[self.leaf[node]])
        return found


def _leaves(tree: Tree, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(matrix(batch.column(1), width))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(leaf)], names=["vec_id", "embedding", "leaf"])

    return run


def _routes(tree: Tree, width: int, most: int, held: np.ndarray, k: int):
    """Rows are (vec_id, embedding, leaves that hold the vec_id); ``held``: distinct ids in each leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            routes = [
                tree.visits(q, most, held, k + own)
                for q, own in zip(matrix(batch.column(1), width), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(routes, pa.list_(pa.int32()))],
                names=["vec_id", "embedding", "leaves"],
            )

    return run


def best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple:
    """The ``k`` nearest of each query among ``v``: (query row, vector row, exact product), in order."""
    out_q, out_v, out_s = [], [], []
    for first in range(0, len(q), 256):
        part = q[first : first + 256]
        rough = part @ v.T
        rough[query_ids[first : first + 256][:, None] == ids[None, :]] = -np.inf
        keep = min(k, len(ids))
        least = np.partition(rough, len(ids) - keep, axis=1)[:, len(ids) - keep]
        slack = 1e-9 * (np.linalg.norm(part, axis=1) * np.linalg.norm(v, axis=1).max() + 1e-300)
        i, j = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
        exact = products(part[i], v[j])
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        begin = np.searchsorted(i, i, "left")
        top = np.arange(len(i)) - begin < k
        out_q.append(i[top] + first)
        out_v.append(j[top])
        out_s.append(exact[top])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _once(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without repeated rows."""
    order = np.lexsort((*x.T, ids))  # ids stay integers: doubles would not tell large ones apart
    a, z = order[:-1], order[1:]
    again = (ids[a] == ids[z]) & (x[a] == x[z]).all(axis=1)
    kept = np.sort(order[np.concatenate([[True], ~again])])
    return ids[kept], x[kept]


def _meet(width: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table(
            {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        )
        if not len(left) or not len(right):
            return empty
        ids, v = left["vec_id"].to_numpy(), matrix(left["embedding"], width)
        if len(np.unique(ids)) < len(ids):
            ids, v = _once(ids, v)
        queries = right["query_id"].to_numpy()
        i, j, score = best(queries, matrix(right["embedding"], width), ids, v, k)
        return pa.table({"query_id": queries[i], "vec_id": ids[j], "score": score})

    return run


def _chosen(id_: Column, share: float) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), id_), F.lit(1 << 30)) < int(share * (1 << 30))


def _rows(frame: DataFrame, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A bounded sample as ids and matrix, in the order of ids."""
    table = frame.select("vec_id", "embedding").limit(most).toArrow()
    ids, x = table["vec_id"].to_numpy(), matrix(table["embedding"], width)
    order = np.lexsort((*x.T, ids)) if len(ids) else np.arange(0)
    return ids[order], x[order]


def _calibrated(vectors: DataFrame, tree: Tree, width: int, k: int, recall: float, ids: np.ndarray, q: np.ndarray) -> int:
    """Leaves to visit so that ``recall`` of the true neighbours of the given queries is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), BLOCK):
                part = batch.slice(first, BLOCK)
                mine, leaf = part.column(0).to_numpy(), part.column(2).to_numpy()
                i, j, score = best(ids, q, mine, matrix(part.column(1), width), k)
                yield pa.record_batch(
                    [pa.array(i), pa.array(mine[j]), pa.array(leaf[j]), pa.array(score)],
                    names=["query", "vec_id", "leaf", "score"],
                )

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    true = (
        vectors.select("vec_id", "embedding", "leaf")
        .mapInArrow(run, "query long, vec_id long, leaf int, score double")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query", "leaf")
        .toArrow()  # k rows for each calibration query
    )
    place = np.empty((len(q), tree.leaves), dtype=np.int64)
    for n, query in enumerate(q):
        place[n, tree.visits(query, tree.leaves)] = np.arange(tree.leaves)
    needed = np.sort(place[true["query"].to_numpy(), true["leaf"].to_numpy()]) + 1
    if not len(needed):
        return tree.leaves
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def nearest(
    embeddings: DataFrame,
    queries: Column,
    k: int = 20,
    recall: float = RECALL,
    sample: int = SAMPLE,
    leaf_rows: int = LEAF_ROWS,
    calibration: int = CALIBRATION,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``embeddings`` (vec_id, embedding) that
    ``queries`` (a condition on vec_id) chooses."""
    spark = embeddings.sparkSession
    root = scratch(spark)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), real("embedding", embeddings))
    width = dimension(rows)
    fit = rows.filter(usable(F.col("embedding")) & (F.size("embedding") == width) & F.col("vec_id").isNotNull())
    count = fit.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if count == 0:
        return spark.createDataFrame([], schema)
    _, some = _rows(fit.filter(_chosen(F.col("vec_id"), min(1.0, sample / count))), width, 2 * sample)
    if not len(some):
        _, some = _rows(fit, width, sample)
    tree = Tree(some, max(1, min(sample // 16, round(count / leaf_rows))))
    kind = rows.schema["embedding"].dataType.simpleString()
    vectors = stage(
        fit.mapInArrow(_leaves(tree, width), f"vec_id long, embedding {kind}, leaf int"), f"{root}/vectors"
    )
    asked = fit.filter(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked_count = asked.count()
    if asked_count == 0:
        return spark.createDataFrame([], schema)
    share = min(1.0, 2 * calibration / asked_count)
    ids, q = _rows(asked.filter(_chosen(F.col("vec_id") + 1, share)), width, calibration)
    if not len(ids):
        ids, q = _rows(asked, width, calibration)
    most = _calibrated(vectors, tree, width, k, recall, ids, q)
    pairs = vectors.select("leaf", "vec_id").distinct()
    held = np.zeros(tree.leaves, dtype=np.int64)
    for r in pairs.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # one row for each leaf
        held[r.leaf] = r.n
    own = pairs.groupBy("vec_id").agg(F.count("*").alias("own"))
    routed = stage(
        asked.join(own, "vec_id").mapInArrow(_routes(tree, width, most, held, k), f"vec_id long, embedding {kind}, leaves array<int>"),
        f"{root}/queries",
    ).select(F.col("vec_id").alias("query_id"), "embedding", F.explode("leaves").alias("leaf"))
    # One row for each leaf of a tree of bounded size.
    held = vectors.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("v_blocks"))
    sought = routed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks"))
    blocks = F.broadcast(held.join(sought, "leaf"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side_v = (
        vectors.join(blocks, "leaf")
        .withColumn("v", F.pmod(F.xxhash64("vec_id"), F.col("v_blocks")).cast("int"))
        .withColumn("q", numbers("q_blocks"))
        .select("leaf", "v", "q", "vec_id", "embedding")
    )
    side_q = (
        routed.join(blocks, "leaf")
        .withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("q_blocks")).cast("int"))
        .withColumn("v", numbers("v_blocks"))
        .select("leaf", "v", "q", "query_id", "embedding")
    )
    key = ["leaf", "v", "q"]
    found = (
        side_v.groupBy(*key)
        .cogroup(side_q.groupBy(*key))
        .applyInArrow(_meet(width, k), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
