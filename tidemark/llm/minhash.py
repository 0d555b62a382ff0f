"""Near-duplicate documents: MinHash with banding, signature verification, exact confirmation and
connected components.

Documents are lower-cased (A-Z) and split into words; a document's set holds its distinct shingles of
``width`` words (the whole sequence when it has fewer words, nothing when it has none). Two documents
are linked when 100 * |A & B| >= ``percent`` * |A | B|.

1. One pass over the texts gives each document its set size, a 128-bit digest of its set and one
   key per band of MinHash minima. Documents with equal sets become one class.
2. Classes that share a band key are tied together (each to the smallest of its bucket, so a bucket of
   any size costs one row for each member), and ties are closed to candidate groups by connected
   components: every pair that banding finds lies inside one group.
3. Texts of grouped classes are read again. A group is split by hash into blocks of bounded size, and
   each pair of blocks is one task's work: signatures propose pairs, full sets confirm them, best
   estimates first, and pairs already connected inside the task are passed over. A task returns a
   spanning forest, so no group is ever expanded into its pairs.
4. Connected components over confirmed links give the result.

With the default 30 bands of 5 minima a pair at exactly 0.8 is missed with probability 7e-6. Blocks
hold sets as hashes of 64 bits.

Defined cases. Null or empty texts, and texts without words: size 0, linked with nothing. Rows that
share a doc_id count as one document, linked with each other unless empty; repeated rows are all
returned. Null doc_ids: such rows can share a class with others but never name a component; without
another row in the class their component is null and they are kept. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.words import mix, shingle_sets
from tidemark.session import scratch, stage

BANDS, ROWS = 30, 5
#: Most shingles, and most sets, of a block on average.
BLOCK_SHINGLES, BLOCK_SETS = 1_500_000, 1_500
#: Estimates may be this far below the threshold (five standard deviations at 150 minima).
SLACK = 0.16
#: Bitmaps that say which documents may be grouped: so many of 4 KB, whatever the input.
BITMAPS = 512


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-shift hash functions: the upper half of a * x + b modulo 2**64, a odd."""
    random = np.random.default_rng(20_240_229)
    a = random.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, random.integers(0, 1 << 63, count, dtype=np.uint64)


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """Minima of ``count`` hash functions over each set; sets must not be empty."""
    a, b = _functions(count)
    out = np.empty((len(sets), count), dtype=np.uint32)
    first = 0
    while first < len(sets):  # runs that stay in the processor's cache
        past, total = first, 0
        while past < len(sets) and (past == first or total + len(sets[past]) <= 50_000):
            total += len(sets[past])
            past += 1
        joined = np.concatenate(sets[first:past])
        starts = np.cumsum([0, *map(len, sets[first : past - 1])])
        if len(joined) * count <= 500_000:
            every = (joined * a[:, None] + b[:, None]) >> np.uint64(32)
            out[first:past] = np.minimum.reduceat(every, starts, axis=1).T
        else:
            for k in range(count):
                out[first:past, k] = np.minimum.reduceat((joined * a[k] + b[k]) >> np.uint64(32), starts)
        first = past
    return out


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set, with different mixing; equal sets have equal sums."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    one = np.add.reduceat(mix(joined ^ np.uint64(0x5851F42D4C957F2D)), starts)
    two = np.add.reduceat(mix(joined * np.uint64(0x2545F4914F6CDD1D)), starts)
    return one.view(np.int64), two.view(np.int64)


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def _sketch(width: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, sets in shingle_sets(texts, width):
                size = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(size)
                one, two = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                held = np.zeros(len(sets) + 1, dtype=np.int32)
                keys = np.zeros((0, bands), dtype=np.int64)
                if len(full):
                    some = [sets[i] for i in full]
                    one[full], two[full] = _digests(some)
                    keys = _band_keys(signatures(some, bands * rows), bands, rows)
                    held[full + 1] = bands
                yield pa.record_batch(
                    [
                        ids.slice(first, len(sets)),
                        pa.array(size),
                        pa.array(one),
                        pa.array(two),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(held, dtype=np.int32)), pa.array(keys.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return sketch


def _sets_of_members(width: int):
    """Sets of grouped classes; a row whose text has another digest than its class is left out."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(i).to_numpy() for i in (3, 4))
            for first, sets in shingle_sets(batch.column(1), width):
                full = [i for i, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                d1, d2 = _digests([sets[i] for i in full])
                here = [
                    i for k, i in enumerate(full) if d1[k] == one[first + i] and d2[k] == two[first + i]
                ]
                rows = pa.array([first + i for i in here], pa.int64())
                yield pa.record_batch(
                    [
                        *(batch.column(k).take(rows) for k in (2, 3, 4, 5, 6)),
                        pa.array([sets[i].tobytes() for i in here], pa.binary()),
                    ],
                    names=["node", "d1", "d2", "grp", "blocks", "shingles"],
                )

    return collect


def _labels(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def forest(sets: list[np.ndarray], side: np.ndarray, percent: int, count: int) -> list[tuple[int, int]]:
    """Links that connect all sets that confirmed links connect.

    ``side``: 0 or 1; with both present only pairs across the sides are looked at.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    signature = signatures([sets[i] for i in order], count)
    size, across = size[order], side[order]
    mixed = len(np.unique(across)) > 1
    least = percent / 100 - SLACK
    far = np.searchsorted(size, size * (100 / percent) + 1e-9, "right")  # larger sets can't be similar enough
    found_x, found_y, found_e = [], [], []
    for first in range(0, len(sets), 128):
        past = min(first + 128, len(sets))
        reach = int(far[past - 1])
        if (past - first) * (reach - first) * count <= 2_000_000:
            same = (signature[first:past, None] == signature[None, first:reach]).sum(axis=2)
        else:
            same = np.zeros((past - first, reach - first), dtype=np.uint16)
            for k in range(count):
                same += signature[first:past, k][:, None] == signature[first:reach, k][None, :]
        x, y = np.nonzero(same >= least * count)
        keep = y > x
        if mixed:
            keep &= across[x + first] != across[y + first]
        x, y = x[keep], y[keep]
        found_e.append(same[x, y])
        found_x.append((x + first).astype(np.int32))
        found_y.append((y + first).astype(np.int32))
    x, y, e = (np.concatenate(f) if f else np.zeros(0, np.int32) for f in (found_x, found_y, found_e))
    best = np.argsort(-e.astype(np.int32), kind="stable")
    x, y = x[best], y[best]
    parent, links, step = np.arange(len(sets)), [], 64
    while len(x):
        for i, j in zip(x[:step], y[:step], strict=True):
            p, q = parent[i], parent[j]
            while parent[p] != p:
                p = parent[p]
            while parent[q] != q:
                q = parent[q]
            if p != q and _linked(sets[order[i]], sets[order[j]], percent):
                parent[max(p, q)] = min(p, q)
                links.append((int(order[i]), int(order[j])))
        parent = _labels(parent)
        x, y = x[step:], y[step:]
        open_ = parent[x] != parent[y]
        x, y = x[open_], y[open_]
        step = min(4096, step * 2)
    return links


def _confirm(percent: int, count: int):
    def confirm(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        node, block = table["node"].to_numpy(), table["block"].to_numpy()
        sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in table["shingles"].combine_chunks()]
        links = forest(sets, (block == high if low != high else np.zeros(len(node))).astype(np.int8), percent, count)
        return pa.table(
            {
                "a": pa.array([node[i] for i, _ in links], pa.int64()),
                "b": pa.array([node[j] for _, j in links], pa.int64()),
            }
        )

    return confirm


def _possible(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` without most rows that have no partner in ``wanted``, before they are shuffled.

    A hash of each wanted doc_id sets one of a fixed number of bits, so what is broadcast never grows; on
    inputs that set most bits fewer rows are turned away, and the join decides as ever.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAPS * 32768))
    bits = (
        wanted.select(place.alias("p"))
        .groupBy(F.floor(F.col("p") / 32768).alias("_map"))
        .agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("_bits"))
    )
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return (
        texts.withColumn("_p", place)
        .withColumn("_map", F.floor(F.col("_p") / 32768))
        .withColumn("_at", F.col("_p") % 32768)
        .join(F.broadcast(bits), "_map")
        .filter(F.getbit(byte.cast("int"), (F.col("_at") % 8).cast("int")) == 1)
        .select("doc_id", "text")
    )


def near_duplicates(
    documents: DataFrame,
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``documents`` (doc_id, text)."""
    spark = documents.sparkSession
    root = scratch(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = stage(
        texts.mapInArrow(
            _sketch(width, bands, rows), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
        ),
        f"{root}/sketch",
    )
    classes = stage(
        sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("size")),
        f"{root}/classes",
    )
    # Ties inside buckets. Only one row of each class takes part.
    keyed = (
        sketched.withColumnRenamed("doc_id", "node")
        .join(classes.select("node", "d1", "d2"), ["node", "d1", "d2"], "left_semi")
        .select("node", F.explode("bands").alias("bucket"))
    )
    shared = keyed.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last")
    ties = keyed.join(shared.select("bucket", "hub"), "bucket").filter("node != hub").select("node", "hub")
    groups = connected_components(ties.distinct(), "node", "hub")
    # Blocks of groups.
    members = stage(
        classes.join(groups, "node").select("node", "d1", "d2", "size", F.col("component").alias("grp")),
        f"{root}/members",
    )
    split = members.groupBy("grp").agg(
        F.greatest(
            F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS), F.lit(1)
        ).cast("int").alias("blocks")
    )
    wanted = members.join(split, "grp").select(F.col("node").alias("doc_id"), "d1", "d2", "grp", "blocks")
    sets = (
        _possible(texts, wanted)
        .join(wanted, "doc_id")
        .select("doc_id", "text", F.col("doc_id").alias("node"), "d1", "d2", "grp", "blocks")
        .mapInArrow(
            _sets_of_members(width), "node long, d1 long, d2 long, grp long, blocks int, shingles binary"
        )
        .withColumn("block", F.pmod(F.xxhash64("node", "d1", "d2"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )
    links = stage(
        sets.select("grp", "low", "high", "block", "node", "shingles")
        .groupBy("grp", "low", "high")
        .applyInArrow(_confirm(percent, bands * rows), "a long, b long"),
        f"{root}/links",
    )
    # Rows of one doc_id with different texts are one document: usually there are none.
    rows_ = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "d1", "d2")
    several = rows_.groupBy("doc_id").agg(F.min("d1").alias("m"), F.max("d1").alias("n")).filter("m != n")
    named_twice = rows_.join(several, "doc_id").join(classes, ["d1", "d2"]).select("doc_id", "node").distinct()
    hubs = named_twice.groupBy("doc_id").agg(F.min("node").alias("b"))
    links = links.unionByName(named_twice.join(hubs, "doc_id").select(F.col("node").alias("a"), "b"))
    parts = connected_components(links, "a", "b")
    named = classes.select("d1", "d2", "node").join(
        parts.withColumnRenamed("component", "found"), "node", "left"
    ).select("d1", "d2", F.coalesce("found", "node").alias("component"))
    empty = F.col("n_shingles") == 0
    result = sketched.drop("bands").join(named, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
