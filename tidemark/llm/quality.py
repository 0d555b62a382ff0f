"""Quality scores: random Fourier features over document statistics, ridge regression by
partition-summed normal equations, isotonic calibration.

One pass over the texts turns each into a row of statistics (shares of byte classes, word lengths,
repetition of words, pairs, runs of four and lines), which is written once and read for fitting and for
scoring. Cosines of random projections approximate a Gaussian kernel on the standardised statistics. Each
partition of labelled rows adds up its part of the normal equations, the parts are summed in Spark, and
the driver solves one system of fixed size. Calibration counts labels in a fixed number of score bins
over a fold that the fit did not see, pools neighbours that fall, and interpolates.

All labelled rows outside the held-out fold are used: three fifths to fit, one fifth to calibrate.

Defined cases. Null and empty texts have statistics of zero and get the score these lead to. Documents
without doc_id are scored and not held out. Several labels of a document are averaged; null labels and
labels of unknown documents are left out. Without usable labels every score is 0.5. Repeated rows are
scored alike. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import Words, _shingles, chunks, text_bytes
from tidemark.session import scratch, stage

FEATURES = 384
RIDGE = 1e-3
BINS = 2000
FOLDS = 5

#: Byte classes, in this order; every other byte is class 0.
_CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t\r\x0b\x0c",
    b"\n",
    b".,;:",
    b"!?",
    b"#*&%$@~^=+",
    b"|<>{}[]\\/_",
    b"-'\"()",
    bytes(range(0xC0, 0x100)),
    bytes(range(0x80, 0xC0)),
]
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _members in enumerate(_CLASSES):
    _CLASS[list(_members)] = _k + 1
_N = len(_CLASSES) + 1
STATISTICS = _N + 16


def _sums(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[begins]


def _distinct(hashes: np.ndarray) -> tuple[int, int]:
    """Distinct values and the count of the most frequent one."""
    if len(hashes) == 0:
        return 0, 0
    _, counts = np.unique(hashes, return_counts=True)
    return len(counts), int(counts.max())


def statistics(raw: np.ndarray, where: np.ndarray) -> np.ndarray:
    """A row of numbers for each text of a run of texts."""
    n = len(where) - 1
    out = np.zeros((n, STATISTICS))
    size = np.diff(where).astype(np.float64)
    if len(raw) == 0:
        return out
    document = np.repeat(np.arange(n), np.diff(where))
    kind = _CLASS[raw]
    shares = np.bincount(document * _N + kind, minlength=n * _N).reshape(n, _N)
    words = Words(raw, where)
    begins, ends = words.of[:-1], words.of[1:]
    count = (ends - begins).astype(np.float64)
    some, bytes_ = np.maximum(count, 1), np.maximum(size, 1)
    length = (words.end - words.start).astype(np.float64)
    again = np.zeros(len(length))
    again[1:] = words.hash[1:] == words.hash[:-1]
    upper = np.concatenate([[0], np.cumsum(kind == 2)])
    lower = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 11))])
    shout = (upper[words.end] - upper[words.start] >= 2) & (lower[words.end] == lower[words.start])
    last = kind[words.end - 1] if len(length) else kind[:0]
    mean = _sums(length, begins, ends) / some
    out[:, :_N] = shares / bytes_[:, None]
    out[:, _N] = np.log1p(size)
    out[:, _N + 1] = np.log1p(count)
    out[:, _N + 2] = mean
    out[:, _N + 3] = np.sqrt(np.maximum(0, _sums(length**2, begins, ends) / some - mean**2))
    out[:, _N + 4] = _sums(again, begins, ends) / some
    out[:, _N + 5] = _sums(shout, begins, ends) / some
    out[:, _N + 6] = _sums(last == 8, begins, ends) / some
    out[:, _N + 7] = _sums(last == 7, begins, ends) / some
    out[:, _N + 8] = _sums(length == 1, begins, ends) / some
    out[:, _N + 9] = _sums(length >= 15, begins, ends) / some
    lines = np.flatnonzero(raw == 10)
    for i in range(n):
        h = words.hash[begins[i] : ends[i]]
        if len(h):
            kinds, most = _distinct(h)
            four = _shingles(h, 4)
            out[i, _N + 10] = kinds / len(h)
            out[i, _N + 11] = most / len(h)
            out[i, _N + 12] = _distinct(_shingles(h, 2))[0] / max(1, len(h) - 1)
            out[i, _N + 13] = _distinct(four)[0] / max(1, len(four))
    out[:, _N + 14] = np.log1p(size / (np.bincount(document[lines], minlength=n) + 1))
    out[:, _N + 15] = kind[np.maximum(where[1:] - 1, 0)] == 6
    out[size == 0] = 0
    return out


def document_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, stats array<double>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, where = text_bytes(batch.column(1))
            for first, past, part, starts in chunks(raw, where):
                rows = statistics(part, starts)
                ends = pa.array(np.arange(past - first + 1, dtype=np.int32) * STATISTICS)
                yield pa.record_batch(
                    [batch.column(0).slice(first, past - first), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))],
                    names=["doc_id", "stats"],
                )

    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, stats array<double>")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), STATISTICS)


class Fourier:
    """Standardises statistics and maps them to cosines of random projections, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, seed: int):
        random = np.random.default_rng(seed)
        self.mean, self.scale = mean, 1 / np.where(deviation > 1e-9, deviation, 1)
        self.weights = random.normal(0, 1 / np.sqrt(len(mean)), (len(mean), features))
        self.shift = random.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        standard = np.clip((stats - self.mean) * self.scale, -8, 8)
        waves = np.cos(standard @ self.weights + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack([waves, np.ones((len(stats), 1))])


def _normal_equations(train: DataFrame, features: Fourier, width: int) -> np.ndarray:
    """Rows of [Z'Z | Z'y], each partition's sum added to the others' in Spark."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            for i in range(0, len(batch), 4096):
                rows = batch.slice(i, 4096)
                z = features(_matrix(rows.column(0)))
                total += z.T @ np.hstack([z, rows.column(1).to_numpy()[:, None]])
        yield pa.record_batch(
            [pa.array(np.arange(width)), pa.array([r.tobytes() for r in total], pa.binary())], names=["row", "part"]
        )

    def add(key: tuple, table: pa.Table) -> pa.Table:
        parts = sorted(p.as_buffer().to_pybytes() for p in table["part"].combine_chunks())
        total = sum(np.frombuffer(p) for p in parts)
        return pa.table({"row": pa.array([key[0].as_py()]), "total": pa.array([total.tobytes()], pa.binary())})

    summed = (
        train.select("stats", "y")
        .mapInArrow(part, "row long, part binary")
        .groupBy("row")
        .applyInArrow(add, "row long, total binary")
    )
    out = np.zeros((width, width + 1))
    for row in summed.collect():  # a fixed number of rows, whatever the input
        out[row["row"]] = np.frombuffer(row["total"])
    return out


def isotonic(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing means of bins by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for k, (n, t) in enumerate(zip(count, total, strict=True)):
        blocks.append([n, t, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, t2, _ = blocks.pop()
            blocks[-1][0] += n2
            blocks[-1][1] += t2
    out, ends = np.empty(len(count)), [b[2] for b in blocks[1:]] + [len(count)]
    for (n, t, first), end in zip(blocks, ends, strict=True):
        out[int(first) : int(end)] = t / n
    return out


class Scorer:
    def __init__(self, features: Fourier, weights: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.features, self.weights, self.at, self.value = features, weights, at, value

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated, with a thousandth of the raw score to order equal values."""
        if len(self.at) == 0:
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        return 0.999 * np.interp(raw, self.at, self.value) + 0.001 * np.clip(raw, 0, 1)


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = 7) -> Scorer:
    """A scorer from ``stats`` (doc_id, stats) and ``labels`` (doc_id, y) outside the held-out fold."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("double").alias("y"))
        .filter("y IS NOT NULL AND doc_id IS NOT NULL")
        .filter(fold(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.avg("y").alias("y"))
    )
    root = scratch(stats.sparkSession)
    rows = stage(stats.join(known, "doc_id").withColumn("fold", fold(F.col("doc_id"))), f"{root}/labelled")
    train, check = rows.filter("fold > 1"), rows.filter("fold = 1")
    each = [F.col("stats")[k] for k in range(STATISTICS)]
    moments = train.agg(F.count("*"), *[f(c) for c in each for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        zero = np.zeros(STATISTICS)
        return Scorer(Fourier(zero, zero, features, seed), np.zeros(features + 1), np.zeros(0), np.zeros(0))
    mapped = Fourier(np.array(moments[1::2]), np.array(moments[2::2]), features, seed)
    sums = _normal_equations(train, mapped, features + 1)
    penalty = ridge * moments[0] * np.eye(features + 1) / (features + 1)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])
    scorer = Scorer(mapped, weights, np.zeros(0), np.zeros(0))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = scorer.raw(_matrix(batch.column(0)))
            bins = np.clip((raw + 0.5) * (BINS / 2), 0, BINS - 1).astype(np.int64)
            yield pa.record_batch([pa.array(bins), pa.array(raw), batch.column(1)], names=["bin", "raw", "y"])

    counted = (
        check.select("stats", "y")
        .mapInArrow(binned, "bin long, raw double, y double")
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.avg("raw").alias("raw"), F.sum("y").alias("y"))
        .orderBy("bin")
        .collect()  # a fixed number of bins
    )
    if not counted:
        return Scorer(mapped, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    n, at, y = (np.array([float(r[k]) for r in counted]) for k in ("n", "raw", "y"))
    return Scorer(mapped, weights, at, isotonic(n, y))


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents`` (doc_id, text); ``labels``
    (doc_id, quality)."""
    stats = stage(document_statistics(documents), f"{scratch(documents.sparkSession)}/stats")
    scorer = fit(stats, labels.select("doc_id", F.col("quality").alias("y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(scorer(_matrix(batch.column(1))))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents`` that the classifier does not reject; texts are not shuffled."""
    stats = stage(document_statistics(documents), f"{scratch(documents.sparkSession)}/stats")
    scorer = fit(stats, labels.select("doc_id", F.col("quality").alias("y")))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, where = text_bytes(batch.column(at))
            for first, past, part, starts in chunks(raw, where):
                kept = scorer(statistics(part, starts)) >= threshold
                yield batch.slice(first, past - first).filter(pa.array(kept))

    return documents.mapInArrow(run, documents.schema)
