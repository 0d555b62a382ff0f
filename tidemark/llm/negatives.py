"""Hard negatives by anchor-clustered shared lists.

Anchors are gathered in clusters. For a cluster, candidates are sorted once by an upper bound of their
product with any member: with the angle between a candidate and the cluster's direction at least ``t`` and
no member further than ``s`` from it, a product is at most the two norms times cos(t - s). Every member
walks that one list, a run of candidates at a time in a matrix product for all members still walking, and
stops when the next bound is below what it still needs: then no later candidate can count.

Twice over: first for an anchor's positives (its first rows of the same label), then, their scores known,
for the negatives of each positive (the first rows of other labels whose score lies in the positive's
range). A walk for negatives also ends below the least score that any range allows.

Candidates are dealt by hash to blocks and anchors by cluster to rounds, both bounded in bytes, and each
pair of block and round is one task's work, so nothing of the table's size is gathered. A cluster with
more anchors than a round should hold is split by hash. Each task returns the first few of each anchor,
and a window keeps the first of these. Cluster directions are fitted on a bounded sample of anchors; they
only decide how early walks end, never the result.

Scores are integers: a component x counts as floor(256 * x). Products are computed in double precision
where that is exact, else in 64-bit integers.

Defined cases. Rows with a null vec_id, label or vector, a null or non-finite component, one that makes an
integer beyond 2**26, no component, or a length other than most, take no part. Of rows with one vec_id the
least by label and then by components counts, and no row is its own positive or negative. Zero vectors
score 0. Equal scores go by vec_id. Anchors without positives or negatives give no rows. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vectors import matrix
from tidemark.session import scratch, stage

SCALE, LARGEST = 256, 1 << 26
#: Bytes of a block or a round in 64-bit numbers, and the least number of blocks.
BLOCK_BYTES, BLOCKS = 64 << 20, 8
#: Anchors on which directions are fitted, anchors of a cluster, and clusters at most.
SAMPLE, MEMBERS, CLUSTERS = 16_384, 64, 256
#: Candidates in one step of a walk, and the first step.
RUN, FIRST = 4_096, 256
EXACT = 1 << 53


def whole(vector: Column) -> Column:
    """Components as integers: floor(256 * x); null for a vector that takes no part."""
    x = F.transform(vector.cast("array<double>"), lambda c: F.floor(c * SCALE))
    bad = F.exists(vector.cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE >= LARGEST))
    return F.when((F.size(vector) > 0) & ~bad, x)


def once(rows: DataFrame) -> DataFrame:
    """Of rows with one vec_id the least by label and components."""
    least = F.min(F.struct("label", "vector")).alias("least")
    return rows.groupBy("vec_id").agg(least).select("vec_id", "least.label", "least.vector")


def fitted(x: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Unit directions of clusters, by spherical k-means from evenly spaced rows."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm > 0, norm, 1)
    centres = x[np.linspace(0, len(x) - 1, clusters).astype(int)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        for c in range(clusters):
            total = x[near == c].sum(axis=0)
            size = np.linalg.norm(total)
            if size > 0:
                centres[c] = total / size
    return centres


def _assigned(centres: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (matrix(batch.column(2), width) @ centres.T).argmax(axis=1)
            yield pa.record_batch([*batch.columns, pa.array(near.astype(np.int32))], names=[*batch.schema.names, "cluster"])

    return run


class Candidates:
    """The rows of a block, once per vec_id, by vec_id."""

    def __init__(self, table: pa.Table, width: int):
        ids, label = table["vec_id"].to_numpy(), table["label"].to_numpy()
        x = matrix(table["vector"], width)
        repeated = len(np.unique(ids)) < len(ids)
        order = np.lexsort((*x.T[::-1], label, ids)) if repeated else np.argsort(ids)
        first = np.ones(len(ids), dtype=bool)
        first[1:] = ids[order][1:] != ids[order][:-1]
        self.ids, self.label, self.x = ids[order][first], label[order][first], x[order][first]
        self.norm = np.sqrt((self.x**2).sum(axis=1))
        self.safe = width * float(np.abs(self.x).max(initial=0))

    def products(self, u: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Integer products of ``u`` with the given candidates."""
        v = self.x[rows]
        if self.safe * float(np.abs(u).max(initial=0)) < EXACT:
            return (u @ v.T).astype(np.int64)
        return u.astype(np.int64) @ v.astype(np.int64).T


def shared_list(u: np.ndarray, candidates: Candidates) -> tuple[np.ndarray, np.ndarray]:
    """Candidates in the order of their bounds for any member of the cluster ``u`` of norm one, and these."""
    norms = np.sqrt((u**2).sum(axis=1))
    units = u / np.where(norms > 0, norms, 1)[:, None]
    total = units.sum(axis=0)
    size = np.linalg.norm(total)
    direction = total / size if size > 0 else total
    spread = np.arccos(np.clip(units[norms > 0] @ direction, -1, 1)).max(initial=0) if size > 0 else np.pi
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = np.where(candidates.norm > 0, (candidates.x @ direction) / candidates.norm, 1)
    angle = np.arccos(np.clip(cosine, -1, 1))
    # The slack covers rounding: a bound must never be too small.
    bound = candidates.norm * (np.cos(np.maximum(0, angle - spread - 1e-7)) + 1e-9)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def walk(u: np.ndarray, candidates: Candidates, needs: np.ndarray, take) -> None:
    """Every member of a cluster walks the shared list until nothing further can count.

    ``take(members, rows, products)`` sees each step and returns what score each of the members needs now;
    ``needs`` has it at first.
    """
    order, bound = shared_list(u, candidates)
    norms = np.sqrt((u**2).sum(axis=1))
    at, step, walking = 0, FIRST, np.arange(len(u))
    while at < len(order):
        walking = walking[norms[walking] * bound[at] + 0.5 >= needs[walking]]  # both sides of it are integers
        if not len(walking):
            return
        rows = order[at : at + step]
        needs[walking] = take(walking, rows, candidates.products(u[walking], rows))
        at, step = at + len(rows), min(RUN, 2 * step)


class Firsts:
    """The first ``k`` (score, id) of each of some lists; higher scores first, then smaller ids."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * lists

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        old_scores, old_ids = self.held[i]
        if len(old_scores) == self.k and len(scores):
            good = scores >= old_scores[-1]
            scores, ids = scores[good], ids[good]
        if len(scores):
            scores, ids = np.concatenate([old_scores, scores]), np.concatenate([old_ids, ids])
            order = np.lexsort((ids, -scores))[: self.k]
            self.held[i] = scores[order], ids[order]

    def least(self, i: int) -> float:
        """The score below which nothing counts for this list."""
        return float(self.held[i][0][-1]) if len(self.held[i][0]) == self.k else -np.inf


def _positives(width: int, k: int):
    """Anchors (vec_id, label, vector, cluster) and a block to (anchor, vec_id, score), the first k of each."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if len(left) and len(right):
            block = Candidates(right, width)
            ids, label, cluster = (left[c].to_numpy() for c in ("vec_id", "label", "cluster"))
            vectors = matrix(left["vector"], width)
            for c in np.unique(cluster):
                own = np.flatnonzero(cluster == c)
                firsts = Firsts(len(own), k)

                def take(members, rows, products, own=own, firsts=firsts):
                    for m, scores in zip(members, products, strict=True):
                        a = own[m]
                        same = np.flatnonzero((block.label[rows] == label[a]) & (block.ids[rows] != ids[a]))
                        firsts.add(m, scores[same], block.ids[rows[same]])
                    return [firsts.least(m) for m in members]

                walk(vectors[own], block, np.full(len(own), -np.inf), take)
                out += [(np.full(len(s), ids[a]), i, s) for a, (s, i) in zip(own, firsts.held, strict=True)]
        anchor, vec, score = (np.concatenate(part) for part in zip(*out, strict=True))
        return pa.table({"anchor_id": anchor, "vec_id": vec, "score": score})

    return run


def _negatives(width: int, k: int, low: int, high: int):
    """Anchors with their positives' scores and a block to (anchor, positive score, vec_id, score): the
    first k of each distinct positive score."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 4]
        if len(left) and len(right):
            block = Candidates(right, width)
            ids, label, cluster = (left[c].to_numpy() for c in ("vec_id", "label", "cluster"))
            vectors, wanted = matrix(left["vector"], width), left["scores"].to_pylist()
            for c in np.unique(cluster):
                own = np.flatnonzero(cluster == c)
                # 100 * score from low * positive to high * positive, in whole numbers.
                ranges = [[(p, -(-low * p // 100), high * p // 100) for p in wanted[a]] for a in own]
                offset = np.cumsum([0, *map(len, ranges)])
                firsts = Firsts(int(offset[-1]), k)

                def needed(m, ranges=ranges, offset=offset, firsts=firsts):
                    return min(max(floor, firsts.least(offset[m] + j)) for j, (_, floor, _) in enumerate(ranges[m]))

                def take(members, rows, products, own=own, ranges=ranges, offset=offset, firsts=firsts, needed=needed):
                    for m, scores in zip(members, products, strict=True):
                        other = np.flatnonzero((block.label[rows] != label[own[m]]) & (scores >= needed(m)))
                        theirs, names = scores[other], block.ids[rows[other]]
                        for j, (_, floor, ceiling) in enumerate(ranges[m]):
                            fits = (theirs >= floor) & (theirs <= ceiling)
                            firsts.add(offset[m] + j, theirs[fits], names[fits])
                    return [needed(m) for m in members]

                walk(vectors[own], block, np.array([needed(m) for m in range(len(own))], dtype=np.float64), take)
                for m, a in enumerate(own):
                    for j, (p, _, _) in enumerate(ranges[m]):
                        s, i = firsts.held[offset[m] + j]
                        out.append((np.full(len(s), ids[a]), np.full(len(s), p), i, s))
        anchor, positive, vec, score = (np.concatenate(part) for part in zip(*out, strict=True))
        return pa.table({"anchor_id": anchor, "positive_score": positive, "vec_id": vec, "score": score})

    return run


def _grid(anchors: DataFrame, rows: DataFrame, blocks: int, rounds: int, function, schema: str) -> DataFrame:
    """``function`` for each pair of a round of anchors and a block of rows."""
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("block", numbers(blocks))
    right = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("round", numbers(rounds))
    key = ["block", "round"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(function, schema)


def _first(frame: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return frame.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def mine_negatives(
    embeddings: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    block_bytes: int = BLOCK_BYTES,
    members: int = MEMBERS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of
    ``embeddings`` (vec_id, label, embedding) that ``anchors``, a condition on vec_id, chooses.

    ``low`` and ``high``: percent of the positive's score between which a negative's has to be.
    """
    spark, root = embeddings.sparkSession, scratch(embeddings.sparkSession)
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole(F.col("embedding")).alias("vector")
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    sizes = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if sizes is None:
        return spark.createDataFrame([], schema)
    width, count = sizes["width"], sizes["count"]
    kind = "vec_id long, label long, vector array<int>"
    rows = stage(rows.filter(F.size("vector") == width).withColumn("vector", F.col("vector").cast("array<int>")), f"{root}/rows")
    own = once(rows.filter(anchors))
    asked = own.count()
    if asked == 0:
        return spark.createDataFrame([], schema)
    chosen = F.pmod(F.xxhash64(F.lit(23), "vec_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / asked) * (1 << 30))
    some = own.filter(chosen | F.lit(asked <= SAMPLE)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()  # bounded
    sample = matrix(some["vector"], width) if len(some) else np.zeros((1, width))
    centres = fitted(sample, max(1, min(len(sample), CLUSTERS, math.ceil(asked / members))))
    near = stage(own.mapInArrow(_assigned(centres, width), f"{kind}, cluster int"), f"{root}/anchors")
    # A cluster larger than it should be is split, so that a round of anchors stays bounded.
    each = max(members, block_bytes // (8 * width) // 8)
    parts = near.groupBy("cluster").agg(F.ceil(F.count("*") / each).cast("int").alias("parts"))  # a row for each cluster
    rounds = max(1, math.ceil(asked * 8 * width / block_bytes))
    blocks = max(BLOCKS, math.ceil(count * 8 * width / block_bytes))
    placed = stage(
        near.join(parts, "cluster")
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
        .withColumn("round", F.pmod(F.xxhash64("cluster", "part"), F.lit(rounds)).cast("int"))
        .drop("parts", "part"),
        f"{root}/placed",
    )
    first = _grid(placed, rows, blocks, rounds, _positives(width, positives), "anchor_id long, vec_id long, score long")
    near_rows = stage(
        _first(first, ["anchor_id"], positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
        f"{root}/positives",
    )
    # A negative score below zero is no share of a positive one, so only these can have negatives.
    scores = near_rows.filter(F.col("positive_score") >= 0).groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    walking = placed.join(scores.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    second = _grid(
        walking, rows, blocks, rounds, _negatives(width, negatives, low, high), "anchor_id long, positive_score long, vec_id long, score long"
    )
    found = _first(second, ["anchor_id", "positive_score"], negatives)
    return near_rows.join(found, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
