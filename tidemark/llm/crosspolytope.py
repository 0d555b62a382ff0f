"""Near-duplicate vectors: cross-polytope hashing after Hadamard rotations, multiprobe buckets, verified
candidate pairs.

A rotation is three rounds of random signs and a fast Hadamard transform; a vector's hash is the signed
axis nearest to its rotation, and a table's bucket is a tuple of such hashes. Each vector enters its
bucket and the next likely ones (the second nearest axis in one place of the tuple). Tuples get longer
with the number of vectors, so that buckets stay small, and the number of tables is chosen, by simulation
at the very threshold, so that a pair is missed with probability 1e-5 at most.

1. Equal vectors become one class, with a count.
2. Bucket keys alone are counted; only vectors in shared buckets travel on, with their keys.
3. Small buckets are packed together; a large one is split by hash into blocks of bounded size, and a
   pair of blocks is a group. Products find candidates, exact cosines confirm them. A pair counts in one of the buckets
   that it shares, that of the least key. A task returns a count for each vector and a spanning forest, never the pairs.
4. Counts are added up; connected components over the forests give the groups.

Defined cases. Null, empty and zero vectors, those with null or non-finite components, and those that
differ in length from most are linked with nothing: n_links 0, their own component, kept. Rows that share
a vec_id are linked like any others; kept is true for each whose id names its component. A null vec_id
counts as a link of others and is never a component's name; without other rows its component is null.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.vectors import dimension, matrix, products, real, usable
from tidemark.llm.words import mix
from tidemark.session import scratch, stage

BLOCK = 1024
MISSED = 1e-5


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), without scaling."""
    n = x.shape[1]
    half = 1
    while half < n:
        y = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x


class CrossPolytope:
    """Bucket keys of unit vectors: ``tables`` x (1 + ``places``) for each."""

    def __init__(self, width: int, places: int, tables: int, seed: int = 3):
        self.width, self.places, self.tables = width, places, tables
        self.padded = 1 << max(1, (width - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables * places, 3, self.padded))

    def _axes(self, unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two nearest signed axes of rotation k, and how much nearer the first is."""
        x = np.zeros((len(unit), self.padded))
        x[:, : self.width] = unit
        for sign in self.signs[k]:
            x = hadamard(x * sign) / math.sqrt(self.padded)
        size = np.abs(x)
        rows = np.arange(len(x))
        first = size.argmax(axis=1)
        top = size[rows, first].copy()
        size[rows, first] = -1
        second = size.argmax(axis=1)
        axis = lambda at: 2 * at + (x[rows, at] < 0)
        return axis(first), axis(second), top - size[rows, second]

    def keys(self, unit: np.ndarray) -> np.ndarray:
        out = np.empty((len(unit), self.tables, 1 + self.places), dtype=np.uint64)
        for t in range(self.tables):
            found = [self._axes(unit, t * self.places + p) for p in range(self.places)]
            for probe in range(1 + self.places):
                key = np.full(len(unit), t + 1, dtype=np.uint64)
                for p, (first, second, _) in enumerate(found):
                    axis = second if probe == p + 1 else first
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + axis.astype(np.uint64))
                out[:, t, probe] = key
        return out


def places_for(count: int, width: int) -> int:
    """Hashes in a tuple, so that there are a few buckets for each vector."""
    axes = 2 * (1 << max(1, (width - 1).bit_length()))
    return max(1, math.ceil(math.log(4 * max(1, count)) / math.log(axes)))


def tables_for(width: int, places: int, cosine: float, missed: float = MISSED) -> int:
    """Tables needed: shares of simulated pairs at the threshold that meet in a table."""
    random = np.random.default_rng(11)
    a = random.normal(size=(4000, width))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = random.normal(size=a.shape)
    if width > 1:
        b -= (a * b).sum(axis=1)[:, None] * a
        b /= np.maximum(np.linalg.norm(b, axis=1)[:, None], 1e-12)
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine**2)) * b
    one = CrossPolytope(width, places, 2)
    x, y = one.keys(a), one.keys(b)
    met = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3)).mean()
    return 1 if met > 1 - missed else math.ceil(math.log(missed) / math.log(1 - met))


def _keys(made: CrossPolytope):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                x = matrix(part.column(1), made.width)
                x /= np.abs(x).max(axis=1)[:, None]
                keys = made.keys(x / np.linalg.norm(x, axis=1)[:, None]).reshape(len(part), -1)
                ends = np.arange(len(part) + 1, dtype=np.int32) * keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
                yield pa.record_batch(
                    [part.column(0), part.column(1), part.column(2), lists],
                    names=["node", "embedding", "copies", "keys"],
                )

    return run


def _labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest index that each of n can reach over the pairs."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _same_bucket(bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows with one bucket, rows being in the order of their buckets."""
    rows = np.arange(len(bucket))
    for k in range(1, len(bucket)):
        rows = rows[rows + k < len(bucket)]
        rows = rows[bucket[rows] == bucket[rows + k]]
        if not len(rows):
            return
        yield rows, rows + k


def _across(unit: np.ndarray, block: np.ndarray, low: int, high: int, least: float) -> Iterator[tuple]:
    """Pairs of one bucket's rows across two blocks, or inside one, that are near enough."""
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    for first in range(0, len(left), 512):
        rows = left[first : first + 512]
        i, j = np.nonzero(unit[rows] @ unit[right].T >= least)
        i, j = rows[i], right[j]
        yield (i[i < j], j[i < j]) if low == high else (i, j)


def _verify(width: int, tables: int, cosine: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, low, high = (k.as_py() for k in key)
        table = table.sort_by("bucket")
        bucket = table["bucket"].to_numpy()
        x = matrix(table["embedding"], width)
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(x), tables, -1)
        block = table["block"].to_numpy()
        x = x / np.exp2(np.floor(np.log2(np.abs(x).max(axis=1))))[:, None]  # exact, and squares stay in range
        norm = np.sqrt(products(x, x))
        unit = x / norm[:, None]
        links, ends_x, ends_y = np.zeros(len(x), dtype=np.int64), [], []
        found = _same_bucket(bucket) if low < 0 else _across(unit, block, low, high, cosine - 1e-9)
        for i, j in found:
            if low < 0:
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine - 1e-9
                i, j = i[near], j[near]
            for part in range(0, len(i), 65536):
                a, b = i[part : part + 65536], j[part : part + 65536]
                near = products(x[a], x[b]) / (norm[a] * norm[b]) >= cosine
                a, b = a[near], b[near]
                # The least of the keys that both have decides.
                where = np.full(len(a), np.iinfo(np.int64).max)
                for t in range(tables):
                    for p in range(keys.shape[2]):
                        shared = (keys[a, t, p][:, None] == keys[b, t]).any(axis=1)
                        np.minimum(where, keys[a, t, p], out=where, where=shared)
                here = where == bucket[a]
                a, b = a[here], b[here]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                label = _labels(len(x), a, b)
                tied = np.flatnonzero(label != np.arange(len(x)))
                ends_x.append(tied)
                ends_y.append(label[tied])
        tied = np.concatenate([*ends_x, np.zeros(0, np.int64)]).astype(np.int64)
        to = np.concatenate([*ends_y, np.zeros(0, np.int64)]).astype(np.int64)
        # A vector has a row for each of its buckets here; they are one node.
        names, at = np.unique(node, return_inverse=True)
        label = _labels(len(names), at[tied], at[to])
        total = np.zeros(len(names), dtype=np.int64)
        np.add.at(total, at, links)
        some = np.flatnonzero(total > 0)
        return pa.table({"node": names[some], "root": names[label[some]], "links": total[some]})

    return run


def near_vectors(embeddings: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings`` (vec_id, embedding)."""
    spark = embeddings.sparkSession
    root = scratch(spark)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), real("embedding", embeddings))
    width = dimension(rows)
    fit = F.col("usable") & (F.size("embedding") == max(width, 1))
    rows = rows.withColumn("usable", usable(F.col("embedding")))
    # -0.0 and 0.0 are the same component.
    tidy = F.transform("embedding", lambda x: x + F.lit(0.0))
    kind = rows.schema["embedding"].dataType.simpleString()
    digest = [F.xxhash64(tidy).alias("d1"), F.xxhash64(F.lit(9), tidy).alias("d2")]
    marked = stage(rows.select("vec_id", F.coalesce(fit, F.lit(False)).alias("fit"), "embedding", *digest), f"{root}/rows")
    classes = stage(
        marked.filter("fit").groupBy("d1", "d2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")),
        f"{root}/classes",
    )
    # Classes are numbered by their digest; rows that share a vec_id may be in several.
    node = F.xxhash64("d1", "d2").alias("node")
    one = (
        marked.filter("fit")
        .join(classes, ["d1", "d2"])
        .filter(F.col("vec_id").eqNullSafe(F.col("least")))
        .select(node, "embedding", "copies")
    )
    vectors = one.dropDuplicates(["node"])
    count = classes.count()
    places = places_for(count, max(width, 1))
    made = CrossPolytope(max(width, 1), places, tables_for(max(width, 1), places, cosine))
    hashed = stage(
        vectors.mapInArrow(_keys(made), f"node long, embedding {kind}, copies long, keys array<long>"),
        f"{root}/hashed",
    )
    entries = hashed.select("node", F.explode(F.array_distinct("keys")).alias("bucket"))
    shared = (
        entries.groupBy("bucket")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("bucket", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    # Buckets of one block are dealt to packs of about two blocks' rows; larger ones go by themselves.
    shared = stage(shared, f"{root}/shared")
    small = shared.filter("blocks = 1").agg(F.sum("n")).first()[0] or 0
    pack = F.pmod(F.xxhash64(F.lit(2), "bucket"), F.lit(max(1, small // (2 * BLOCK))))
    met = entries.join(shared.drop("n"), "bucket")
    travelling = (
        met.join(hashed, "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("alone", F.col("blocks") > 1)
        .select(
            F.when(F.col("alone"), F.col("bucket")).otherwise(pack).alias("grp"),
            F.when(F.col("alone"), F.least("block", "other")).otherwise(F.lit(-1)).alias("low"),
            F.when(F.col("alone"), F.greatest("block", "other")).otherwise(F.lit(-1)).alias("high"),
            "bucket",
            "block",
            "node",
            "copies",
            F.col("embedding"),
            "keys",
        )
    )
    links = stage(
        travelling.groupBy("grp", "low", "high").applyInArrow(
            _verify(made.width, made.tables, cosine), "node long, root long, links long"
        ),
        f"{root}/links",
    )
    groups = connected_components(links.select("node", "root"), "node", "root")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        classes.select("d1", "d2", "least", "copies", node)
        .join(counted, "node", "left")
        .join(groups, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    names = known.groupBy("component").agg(F.min("least").alias("name"))
    known = known.join(names, "component").select(
        "d1", "d2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "name"
    )
    result = marked.drop("embedding").join(known, ["d1", "d2"], "left")
    fitting = F.col("fit")
    return result.select(
        "vec_id",
        F.when(fitting, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(fitting, F.col("name")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
