"""Ranked lexical search: documents for each item, each distinct bag of words scored once.

A term is a run of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.

1. Bags. One pass over the texts keeps of each document its number of terms and its bag: how often each
   term of the items' vocabulary occurs. Texts are cut into terms slice by slice.
2. Classes. Documents with the same bag and the same length factor m have the same score for every item.
   They are grouped by a hash of both, and by both themselves, so that equal hashes alone join nothing. A
   class that holds a third of all documents is combined before the shuffle.
3. Document frequencies are sums over classes. Each class is scored once, against all items in a matrix
   product of integers; a task keeps ``k`` classes for each item, by score and then by smallest doc_id,
   and a window over these keeps ``k``. No document outside them can be among an item's first ``k``.
4. Expansion. Of each winning class the ``k`` smallest doc_ids are taken, and an item's documents are
   ranked by score and doc_id.

The vocabulary and the items are what is broadcast. Items are dealt by hash to so many blocks that a
block's terms stay near ``block_bytes``; each block is a run of its own over the documents.

Defined cases. Null and empty texts, and items without terms, have no terms: such documents count for
nothing and such items get no rows. Very long texts are read in slices. Each row of ``documents`` is a
document and each row of ``items`` an item, repeated or not; equal scores go by doc_id, a null one last.
Other columns are ignored. An empty table on either side gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import scratch, stage

SCHEMA = "item_id long, rank int, doc_id long, score long"
SLICE = 1 << 20
BLOCK_BYTES = 32 << 20
#: Numbers in a block of the matrix product, and terms of the items that share one.
CELLS, TERMS = 1 << 22, 1 << 12
#: Sums up to this are exact in double precision.
EXACT = 1 << 53

#: A byte of a term as it is, lower-cased; any other byte as a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for batch in batches for i in range(0, len(batch), rows))


def terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, slice by slice; no term is cut."""
    begin = 0
    while begin < len(data):
        end = begin + SLICE
        if end < len(data):
            gap = _BETWEEN.search(data, end)
            end = gap.start() if gap else len(data)
        yield data[begin:end].translate(_TERM).split()
        begin = end


def counted(data: bytes | None) -> tuple[int, Counter]:
    """How many terms a text has, and how often each occurs."""
    n, counts = 0, Counter()
    for some in terms(data or b""):
        n += len(some)
        counts.update(some)
    return n, counts


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [counted(t)[1] for t in batch.column(1).to_pylist()]
        yield pa.record_batch(
            [
                batch.column(0),
                pa.array([list(b) for b in bags], pa.list_(pa.binary())),
                pa.array([list(b.values()) for b in bags], pa.list_(pa.int64())),
            ],
            names=["item_id", "terms", "repeats"],
        )


def _bags(shared):
    """Rows (doc_id, text) to (doc_id, n, bag): pairs of term number and count, by term number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        known = number.keys()
        for batch in slices(batches):
            ns, bags = [], []
            for text in batch.column(1).to_pylist():
                n, counts = counted(text)
                pairs = sorted((number[t], counts[t]) for t in counts.keys() & known)
                ns.append(n)
                bags.append(np.array(pairs, dtype="<i4").tobytes())
            yield pa.record_batch(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "n", "bag"]
            )

    return run


def _pairs(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number and count of each pair of the given bags."""
    held = bags.to_pylist()
    flat = np.frombuffer(b"".join(held), dtype="<i4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(held)), [len(b) // 8 for b in held]), flat[:, 0], flat[:, 1]


def _frequencies(size: int):
    """Rows (bag, copies) to (term, df): a row for each term that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            row, term, _ = _pairs(batch.column(0))
            np.add.at(total, term, batch.column(1).to_numpy()[row])
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met), pa.array(total[met])], names=["term", "df"])

    return run


class Items:
    """The items of a block, in parts that share at most TERMS terms (or are one item)."""

    def __init__(self, items: list[list[tuple[int, int]]], weight: np.ndarray):
        self.weight, self.parts = weight, []
        most = max((sum(q for _, q in item) for item in items), default=0)
        #: No count of a term scores above 1,000,000.
        self.exact = most * int(weight.max(initial=0)) * 1_000_000 < EXACT
        own, members = set(), []
        for i, item in enumerate(items):
            wider = own | {t for t, _ in item}
            if members and len(wider) > TERMS:
                self._close(own, members, items)
                wider, members = {t for t, _ in item}, []
            own = wider
            members.append(i)
        if members:
            self._close(own, members, items)

    def _close(self, own: set[int], members: list[int], items: list[list[tuple[int, int]]]) -> None:
        column = np.full(len(self.weight), -1, dtype=np.int64)
        listed = np.array(sorted(own), dtype=np.int64)
        column[listed] = np.arange(len(listed))
        repeats = np.zeros((len(listed), len(members)), dtype=np.float64 if self.exact else np.int64)
        for j, i in enumerate(members):
            for t, q in items[i]:
                repeats[column[t], j] = q
        self.parts.append((column, np.array(members), repeats))

    def scores(self, m: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray):
        """(first row, items, their scores of a run of rows) for all rows and items."""
        value = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
        for column, members, repeats in self.parts:
            at = column[term]
            mine = at >= 0
            r, c, v = row[mine], at[mine], value[mine]
            step = max(1, CELLS // max(repeats.shape))
            for first in range(0, len(m), step):
                a, z = np.searchsorted(r, [first, first + step])
                block = np.zeros((min(step, len(m) - first), len(repeats)), dtype=repeats.dtype)
                block[r[a:z] - first, c[a:z]] = v[a:z]
                yield first, members, (block @ repeats).astype(np.int64)


def _best(shared, k: int):
    """Rows (h, m, bag, first) to the ``k`` best classes of each item: (item, score, first, h, m, bag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Plain values are broadcast and the rest is made here: tasks need no copy of this package.
        listed, weight = shared.value
        items, least = Items(listed, weight), np.zeros(len(listed), dtype=np.int64)
        item, score, first = (np.zeros(0, dtype=np.int64) for _ in range(3))
        classes = np.zeros(0, dtype=object)
        for batch in slices(batches):
            m = batch.column(1).to_numpy()
            ids = batch.column(3).fill_null(np.iinfo(np.int64).max).to_numpy()
            keys = batch.column(0).to_numpy()
            bags = batch.column(2)
            found = [(item, score, first, classes)]
            for begin, members, block in items.scores(m, *_pairs(bags)):
                r, c = np.nonzero((block > 0) & (block >= least[members]))
                rows = r + begin
                kept = np.empty(len(rows), dtype=object)
                for x, y in enumerate(rows.tolist()):
                    kept[x] = (int(keys[y]), int(m[y]), y)
                found.append((members[c], block[r, c], ids[rows], kept))
            item, score, first, classes = (np.concatenate(part) for part in zip(*found, strict=True))
            order = np.lexsort((first, -score, item))
            item, score, first, classes = (part[order] for part in (item, score, first, classes))
            place = np.arange(len(item)) - np.searchsorted(item, item, "left")
            top = place < k
            full = place == k - 1
            least[item[full]] = score[full]
            item, score, first, classes = (part[top] for part in (item, score, first, classes))
            for x, (key, length, row) in enumerate(classes):
                if not isinstance(row, bytes):
                    classes[x] = (key, length, bags[row].as_py())
        none = first == np.iinfo(np.int64).max
        yield pa.record_batch(
            [
                pa.array(item.astype(np.int32)),
                pa.array(score),
                pa.array(first, mask=none),
                pa.array([c[0] for c in classes], pa.int64()),
                pa.array([c[1] for c in classes], pa.int64()),
                pa.array([c[2] for c in classes], pa.binary()),
            ],
            names=["item", "score", "first", "h", "m", "bag"],
        )

    return run


def _ranked(documents: DataFrame, items: pa.Table, k: int) -> DataFrame | None:
    """Results for the items of one block."""
    spark, root = documents.sparkSession, scratch(documents.sparkSession)
    ids, listed, repeats = (items[c].to_pylist() for c in ("item_id", "terms", "repeats"))
    number = {t: i for i, t in enumerate(sorted({t for some in listed for t in some}))}
    if not number:
        return None
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    bags = stage(
        texts.mapInArrow(_bags(spark.sparkContext.broadcast(number)), "doc_id long, n long, bag binary").filter("n > 0"),
        f"{root}/bags",
    )
    documents_n, terms_n = bags.agg(F.count("*"), F.sum("n")).first()
    if not documents_n:
        return None
    m = F.expr(f"75 + (25L * n * {documents_n}L) div {terms_n}L")
    held = bags.filter(F.length("bag") > 0).select("doc_id", m.alias("m"), "bag")
    held = held.withColumn("h", F.xxhash64("m", "bag"))
    classes = stage(
        held.groupBy("h", "m", "bag").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")), f"{root}/classes"
    )
    frequency = np.zeros(len(number), dtype=np.int64)
    met = classes.select("bag", "copies").mapInArrow(_frequencies(len(number)), "term long, df long")
    found = met.groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each term of the block
    frequency[found["term"].to_numpy()] = found["df"].to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * documents_n + 2) / (2 * df + 1))) for df in frequency.tolist()], dtype=np.int64)
    block = [[(number[t], q) for t, q in zip(ts, qs, strict=True)] for ts, qs in zip(listed, repeats, strict=True)]
    best = classes.select("h", "m", "bag", "first").mapInArrow(
        _best(spark.sparkContext.broadcast((block, weight)), k), "item int, score long, first long, h long, m long, bag binary"
    )
    order = [F.desc("score"), F.asc_nulls_last("first"), "h"]
    winners = stage(
        best.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
        .filter(F.col("place") <= k)
        .drop("place", "first"),
        f"{root}/winners",
    )
    # k rows for each item of the block at most; the hash alone first, which leaves few documents to verify.
    hashes = stage(winners.select("h").distinct(), f"{root}/hashes")
    chosen = stage(winners.select("h", "m", "bag").distinct(), f"{root}/chosen")
    member = Window.partitionBy("h", "m", "bag").orderBy(F.asc_nulls_last("doc_id"))
    members = (
        held.join(hashes, "h", "left_semi")
        .withColumn("place", F.row_number().over(member))
        .filter(F.col("place") <= k)
        .join(chosen, ["h", "m", "bag"])
        .drop("place")
    )
    names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "item int, item_id long")
    final = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        winners.join(members, ["h", "m", "bag"])
        .withColumn("rank", F.row_number().over(final).cast("int"))
        .filter(F.col("rank") <= k)
        .join(names, "item")
        .select("item_id", "rank", "doc_id", "score")
    )


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) for each item (item_id, text)."""
    spark = documents.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    asked = stage(
        asked.mapInArrow(_item_terms, "item_id long, terms array<binary>, repeats array<bigint>").filter(F.size("terms") > 0),
        f"{scratch(spark)}/items",
    )
    size = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.length(t) + 16))).first()[0]
    blocks = math.ceil((size or 0) / block_bytes)
    found = []
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).orderBy("item_id", "terms")
        found.append(_ranked(documents, mine.toArrow(), k))  # bounded by block_bytes
    found = [f for f in found if f is not None]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], SCHEMA)
