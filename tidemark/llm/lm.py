"""Language-model scores by stupid backoff, from n-gram counts of the corpus itself.

A document's words (runs of bytes other than white space, A-Z lower-cased) follow a start mark. A word
is scored by the longest n-gram of at most ``order`` words that ends with it and lies in its document, start mark
included: log(c(n-gram) / c(n-gram without its last word)) when it occurs at least ``min_count`` times in
the corpus, else log(``backoff``) and the score by the n-gram without its first word, and so on; a single word has
log(c(word) / N). A document's score is the sum; counts cover all documents.

1. Each task counts the distinct n-grams of all orders in batches of documents, in one sorted list of
   keys for a batch. Ranges of keys are buckets; a batch sends a row to each bucket, with its keys and their
   numbers, compressed. However common an n-gram is, a batch sends it once.
2. A bucket adds the numbers up and answers each batch with the counts of its keys, in their order. The batch's
   words (indexes into a list of word hashes, compressed) pass through one of the buckets. The hashes are keys
   of single words, so a mark on each key names them, and the bucket sends them on.
3. The answers meet the batch's words again, and its documents are scored.

N-gram identities are hashes of 64 bits. Buckets number one for ``PARTITION_WORDS`` words.

Defined cases. Null and empty texts, and texts without words: n_words 0, log_score 0, mean_log 0. A null
doc_id is scored like any other. Repeated rows count as often as they occur, and each is scored. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import Words, chunks, mix, text_bytes

PARTITION_WORDS = 1_200_000
#: Words of a packed batch: the more, the fewer n-grams are sent again by other batches.
BATCH_WORDS = 3_000_000
PIECE = 1 << 18
#: The start mark's key.
START = np.uint64(0xA0761D6478BD642F)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0xD6E8FEB86659FD93) + mix(second + np.uint64(0x632BE59BD9B4E019)))


class _Batch:
    """Texts of a batch: ids, words of each, and the keys of all words, a start mark before each text's."""

    def __init__(self, ids: list[pa.Array], words: list[tuple[np.ndarray, np.ndarray]]):
        self.ids = pa.concat_arrays(ids)
        self.counts = np.concatenate([np.diff(of) for of, _ in words])
        starts = _starts(self.counts)
        self.key = np.full(int(self.counts.sum()) + len(starts), START)
        inside = np.ones(len(self.key), dtype=bool)
        inside[starts] = False
        self.key[inside] = np.concatenate([hashes for _, hashes in words])


def _starts(counts: np.ndarray) -> np.ndarray:
    """Where the start marks of texts that have words stand."""
    held = counts[counts > 0] + 1
    return np.cumsum(held) - held


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[_Batch]:
    for batch in batches:
        raw, where = text_bytes(batch.column(1))
        ids, words, total = [], [], 0
        for first, past, part, starts in chunks(raw, where):
            found = Words(part, starts)
            ids.append(batch.column(0).slice(first, past - first))
            words.append((found.of, found.hash))
            total += len(found.hash)
            if total >= BATCH_WORDS:
                made = _Batch(ids, words)
                ids, words, total = [], [], 0
                yield made
                del made
        if ids:
            yield _Batch(ids, words)


def _squeeze(values: np.ndarray) -> bytes:
    """Compressed, all first bytes together, all second bytes, and so on."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def _spread(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _bits(values: np.ndarray) -> np.ndarray:
    """How many bits each value needs."""
    return np.frexp(values)[1].astype(np.uint8)


def _squeeze_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """The number of bits of each rank, and the ranks with those of equal size together."""
    size = _bits(ranks)
    return _squeeze(size), _squeeze(ranks[np.argsort(size, kind="stable")])


def _spread_ranks(sizes: bytes, grouped: bytes) -> np.ndarray:
    size = _spread(sizes, np.uint8)
    ranks = np.empty(len(size), dtype=np.uint32)
    ranks[np.argsort(size, kind="stable")] = _spread(grouped, np.uint32)
    return ranks


def _by_frequency(size: np.ndarray) -> np.ndarray:
    """Frequent words first, by the bits of their numbers; those of equal size stay in order."""
    return np.argsort(np.uint8(64) - size, kind="stable")


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, where = text_bytes(batch.column(0))
        n = sum(len(Words(part, starts).hash) for _, _, part, starts in chunks(raw, where))
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])


def _grams(key: np.ndarray, counts: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``order`` words: the n-grams' keys, and where in ``key`` they end."""
    held = counts[counts > 0] + 1
    place = np.arange(len(key)) - np.repeat(_starts(counts), held)
    ends, gram = np.arange(len(key)), key
    for n in range(1, order + 1):
        if n > 1:
            inside = place[ends] >= n - 1
            # The n-gram one word shorter that ends a word earlier is the one before, in the same text.
            gram, ends = pair_key(gram[np.flatnonzero(inside) - 1], key[ends[inside]]), ends[inside]
        yield gram, ends


def _keys(key: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """The keys of all n-grams, sorted, each as often as it occurs."""
    held = counts[counts > 0] + 1
    keys = np.empty(sum(int(np.maximum(0, held - n).sum()) for n in range(order)), dtype=np.uint64)
    at = 0
    for gram, _ in _grams(key, counts, order):
        keys[at : at + len(gram)] = gram
        at += len(gram)
    keys.sort()
    return keys


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Where each key of a sorted list occurs first."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _least(bucket: int, buckets: int) -> np.uint64:
    """The least key of a bucket's range."""
    return np.uint64((bucket << 64) // buckets)


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the sorted keys of each bucket, a range of keys, begin; and the end."""
    least = [_least(b, buckets) for b in range(buckets)]
    return np.append(np.searchsorted(keys, np.array(least, dtype=np.uint64)), len(keys))


SENT = "bucket int, batch long, keys binary, often binary, single binary, words array<binary>, ids array<long>, counts array<long>"
ANSWERED = "batch long, bucket int, often binary, listed binary, words array<binary>, ids array<long>, counts array<long>"


def _pack(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in enumerate(_batches(batches)):
            batch = (TaskContext.get().partitionId() << 24) | number
            keys = _keys(b.key, b.counts, order)
            first = _distinct(keys)
            often = np.diff(np.append(first, len(keys))).astype(np.uint32)
            keys = keys[first]
            del first
            edges = _edges(keys, buckets)
            listed, index, times = np.unique(b.key, return_inverse=True, return_counts=True)
            single = np.zeros(len(keys), dtype=bool)
            single[np.searchsorted(keys, listed)] = True
            # Frequent words first, so that most indexes are small; keys as steps from one to the next.
            size = _bits(times)
            place = np.empty(len(listed), dtype=np.uint32)
            place[_by_frequency(size)] = np.arange(len(listed))
            words = [_squeeze(size), *_squeeze_ranks(place[index])]
            del b.key, listed, index, times, place
            home = int(mix(np.array([batch + 1], dtype=np.uint64))[0] % np.uint64(buckets))
            for p in range(buckets):
                begin, end = edges[p], edges[p + 1]
                if begin == end and p != home:
                    continue
                yield pa.record_batch(
                    [
                        pa.array([p], pa.int32()),
                        pa.array([batch], pa.int64()),
                        pa.array([_squeeze(np.diff(keys[begin:end], prepend=_least(p, buckets)))], pa.binary()),
                        pa.array([_squeeze(often[begin:end])], pa.binary()),
                        pa.array([_squeeze(np.packbits(single[begin:end]))], pa.binary()),
                        pa.array([words if p == home else None], pa.list_(pa.binary())),
                        pa.array([b.ids.to_pylist() if p == home else None], pa.list_(pa.int64())),
                        pa.array([b.counts.tolist() if p == home else None], pa.list_(pa.int64())),
                    ],
                    names=["bucket", "batch", "keys", "often", "single", "words", "ids", "counts"],
                )

    return run


def _answer(buckets: int):
    """For each batch the counts of its keys over all batches, in their order, and its keys of single words."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        least = _least(key[0].as_py(), buckets)
        sent, often, single = ([x.as_buffer() for c in table[n].chunks for x in c] for n in ("keys", "often", "single"))
        steps = [_spread(x, np.uint64) for x in sent]
        keys = np.concatenate([np.cumsum(s, dtype=np.uint64) + least for s in steps])
        ends = np.cumsum([len(s) for s in steps])
        del steps
        listed = []
        for part, marks in zip(np.split(keys, ends[:-1]), single, strict=True):
            words = part[np.unpackbits(_spread(marks, np.uint8), count=len(part)).astype(bool)]
            listed.append(_squeeze(np.diff(words, prepend=least)))
        order = np.argsort(keys, kind="stable")
        n = np.concatenate([_spread(x, np.uint32) for x in often]).astype(np.int64)[order]
        first = _distinct(keys[order])
        total = np.empty(len(keys), dtype=np.int64)
        if len(keys):
            total[order] = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(keys))))
        answers = [_squeeze(part) for part in np.split(total, ends[:-1])]
        return pa.table(
            {c: table[c] for c in ("batch", "bucket")}
            | {"often": pa.array(answers, pa.binary()), "listed": pa.array(listed, pa.binary())}
            | {c: table[c] for c in ("words", "ids", "counts")}
        )

    return run


def _pieces(size: int) -> Iterator[slice]:
    """Slices of a long array, so that steps over it need little memory."""
    return (slice(at, at + PIECE) for at in range(0, size, PIECE))


def _score(order: int, total: int, buckets: int, backoff: float, min_count: int):
    """The scores of a batch's documents."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        home = next(k for k in range(len(table)) if table["ids"][k].is_valid)
        counts = table["counts"][home].values.to_numpy()
        # Buckets are ranges of keys: what they sent, in order, is that of the sorted keys.
        numbers = table["bucket"].to_numpy()
        places = np.argsort(numbers)
        parts = table["listed"].combine_chunks()
        listed = np.concatenate(
            [
                np.cumsum(_spread(parts[int(k)].as_buffer(), np.uint64), dtype=np.uint64) + _least(int(numbers[k]), buckets)
                for k in places
            ]
        )
        sizes, *ranks = (part.as_buffer() for part in table["words"][home].values)
        words = listed[_by_frequency(_spread(sizes, np.uint8))][_spread_ranks(*ranks)]
        del sizes, ranks, listed, parts
        often = table["often"].combine_chunks()
        n = np.concatenate([_spread(often[int(k)].as_buffer(), np.int64) for k in places])
        keys = _keys(words, counts, order)
        keys = keys[_distinct(keys)]
        value = np.zeros(len(words))
        context, context_ends = None, None
        for gram, ends in _grams(words, counts, order):
            by_key = np.argsort(gram)
            size = np.empty(len(gram), dtype=np.int64)
            for part in _pieces(len(gram)):
                size[by_key[part]] = n[np.searchsorted(keys, gram[by_key[part]])]
            del by_key
            for part in _pieces(len(gram)):
                at, found = ends[part], size[part]
                if context is None:
                    value[at] = np.log(found) - math.log(max(1, total))
                else:
                    before = context[np.searchsorted(context_ends, at - 1)]
                    value[at] = np.where(
                        found >= min_count, np.log(found) - np.log(before), math.log(backoff) + value[at]
                    )
            context, context_ends = size, ends
        starts = _starts(counts)
        value[starts] = 0.0
        sums = np.zeros(len(counts))
        if len(starts):
            sums[counts > 0] = np.add.reduceat(value, starts)
        return pa.table({"doc_id": table["ids"][home].values, "n_words": counts, "log_score": sums})

    return run


def score_documents(
    documents: DataFrame,
    backoff: float = 0.4,
    min_count: int = 2,
    partition_words: int = PARTITION_WORDS,
    order: int = 2,
) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log) for every row of ``documents`` (doc_id, text), by n-grams of
    up to ``order`` words."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.select("text").mapInArrow(_total, "n long").agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(total / partition_words))
    sent = texts.mapInArrow(_pack(order, buckets), SENT)
    answered = sent.groupBy("bucket").applyInArrow(_answer(buckets), ANSWERED)
    scored = answered.groupBy("batch").applyInArrow(
        _score(order, total, buckets, backoff, min_count), "doc_id long, n_words long, log_score double"
    )
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(F.lit(0.0))
    return scored.withColumn("mean_log", mean)
