"""Byte-level BPE as a streaming transducer, and the way back.

Encoding. A token sequence is the merge list's result exactly when each neighbouring pair of tokens is
the result for the pair's own bytes. So each prefix of a piece has one last token: the one that ends
there and forms such a pair with the last token of the prefix before it. The encoder keeps that token for
each byte read. Whatever follows, the final sequence has a token end among the last ``lookahead`` bytes,
``lookahead`` being the longest token that the merge list makes; once the paths from all of these lead
through one boundary, the tokens before it are stable and are emitted, so memory does not grow with the
piece. Pair checks are remembered.

Texts are read in windows: special tokens are cut out first, then pieces are matched, and the pieces that
a longer window could change wait for the next one.

Decoding. Tokens give bytes, and a state machine turns bytes into text as they come; incomplete or
invalid sequences become U+FFFD.

Defined cases. Null and empty texts have no tokens and decode to the empty text. The vocabulary is read
on the driver from a tokenizer file (its size is the bound of what is broadcast).
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the format: how a text is cut into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII alone, whose letters, digits and white space are these.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"
#: Longest alternative of fixed text: a piece that starts nearer to the end than this can still change.
CONTRACTION = 3
WINDOW = 1 << 16
REMEMBERED = 300_000
#: Bytes at the beginning of a piece whose tokens are remembered.
START = 6


def _byte_of_char() -> dict[str, int]:
    """The format writes printable Latin-1 bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes by id, merges by rank, and special tokens, of a byte-level BPE tokenizer file."""

    def __init__(self, tokens: dict[int, bytes], rank: dict[tuple[bytes, bytes], int], special: dict[str, int]):
        self.tokens, self.rank, self.special = tokens, rank, special

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        byte = _byte_of_char()
        model = made["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        spell = {t: bytes(byte[c] for c in t) for t in model["vocab"]}
        special = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        tokens = {i: t.encode() for t, i in special.items()} | {i: spell[t] for t, i in model["vocab"].items()}
        return Vocabulary(tokens, {(spell[a], spell[b]): k for k, (a, b) in enumerate(pairs)}, special)


def merge_all(data: bytes, rank: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The definition: the pair of least rank is merged, leftmost first, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min((rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Transducer:
    """Bytes of a piece in, ids of stable tokens out."""

    def __init__(self, vocabulary: Vocabulary):
        self.rank = vocabulary.rank
        self.ids = {t: i for i, t in vocabulary.tokens.items() if i not in vocabulary.special.values()}
        #: One object for each token, so that what is remembered stays small.
        self.same = {t: t for t in self.ids}
        self.lookahead = max(map(len, self.ids))
        #: Lengths of the tokens that end with given bytes (four, or three or two where the token is
        #: shorter), longest first; single bytes are always tokens.
        ends: dict[bytes, set[int]] = {}
        for token in self.ids:
            ends.setdefault(token[-4:], set()).add(len(token))
        for end in list(ends):
            if len(end) > 2:
                ends[end] |= {n for n in (2, 3) if end[-n:] in self.ids}
        self.lengths = {end: sorted(found - {1}, reverse=True) for end, found in ends.items()}
        self.made = {a + b: (k, a, b) for (a, b), k in self.rank.items()}
        if len(self.made) < len(self.rank):
            raise ValueError("two merges make the same token")
        #: Ranks of merges by their left and then their right part.
        self.merges: dict[bytes, dict[bytes, int]] = {}
        for (a, b), k in self.rank.items():
            self.merges.setdefault(a, {})[b] = k
        self.spines: tuple[dict, dict] = ({}, {})
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.starts: dict[bytes, list[bytes]] = {}

    def _fit(self, a: bytes, b: bytes) -> bool:
        """Whether the merges of a's and b's bytes together end with these two tokens.

        They do unless a merge crosses the boundary while both its sides stand there. The tokens that
        stand there are a's right ends and b's left ends, each until a merge of its own takes it; of equal
        merges the leftmost comes first.
        """
        if len(self.fits) > REMEMBERED:
            self.fits.clear()
        fits = True
        left, right = self.spines[1].get(a) or self._ends(a, True), self.spines[0].get(b) or self._ends(b, False)
        for x, until_x in left if a else ():
            merges = self.merges.get(x)
            if merges:
                for y, until_y in right:
                    crossing = merges.get(y)
                    if crossing is not None and crossing < until_x and crossing <= until_y:
                        fits = False
        self.fits[a, b] = fits
        return fits

    def _ends(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """Tokens that stand at one end of ``token`` on the way to it, and the merge that takes each."""
        known = self.spines[right].get(token)
        if known is None:
            known, part, until = [], token, 1 << 60
            while part is not None:
                known.append((part, until))
                made = self.made.get(part)
                if made is None:
                    break
                until, part = made[0], made[2 if right else 1]
            self.spines[right][token] = known
        return known

    def _advance(self, data: bytes, last: list[bytes], begin: bytes) -> None:
        """Adds to ``last`` the token that ends at each byte of ``data`` that is new.

        ``begin`` is the token before ``data``.
        """
        same, lengths, fit, fits = self.same, self.lengths, self._fit, self.fits
        for end in range(len(last), len(data) + 1):
            found = None
            for size in (
                lengths.get(data[end - 4 : end] if end > 3 else data[:end])
                or lengths.get(data[end - 3 : end] if end > 2 else data[:end])
                or lengths.get(data[end - 2 : end] if end > 1 else b"")
                or ()
            ):
                if size <= end:
                    token = same.get(data[end - size : end])
                    if token is not None:
                        pair = (last[end - size] or begin, token)
                        known = fits.get(pair)
                        if fit(*pair) if known is None else known:
                            found = token
                            break
            last.append(found or same[data[end - 1 : end]])

    def whole(self, data: bytes) -> list[int]:
        """Ids of a piece that is too short for anything to leave before its end."""
        last = [b""]
        if len(data) > START:  # pieces often begin alike
            known = self.starts.get(data[:START])
            if known is None:
                self._advance(data[:START], last, b"")
                if len(self.starts) > REMEMBERED:
                    self.starts.clear()
                self.starts[data[:START]] = last.copy()
            else:
                last = known.copy()
        self._advance(data, last, b"")
        return self._path(last, len(data))

    def run(self, blocks: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of one piece given in blocks; each list is stable."""
        data, last, begin = b"", [b""], b""  # last[i]: the token that ends at byte i of data
        for block in blocks:
            data += block
            self._advance(data, last, begin)
            if len(data) > 4 * self.lookahead:
                stable = self._meet(last)
                if stable:
                    yield self._path(last, stable)
                    begin = last[stable]
                    data, last = data[stable:], [b"", *last[stable + 1 :]]
        if data:
            yield self._path(last, len(data))

    def _meet(self, last: list[bytes]) -> int:
        """The last boundary that the paths from all possible token ends share."""
        n = len(last) - 1
        open_ = set(range(max(0, n - self.lookahead + 1), n + 1))
        while len(open_) > 1:
            most = max(open_)
            open_.discard(most)
            open_.add(most - len(last[most]))
        return open_.pop()

    def _path(self, last: list[bytes], end: int) -> list[int]:
        out = []
        while end > 0:
            token = last[end]
            out.append(self.ids[token])
            end -= len(token)
        return out[::-1]


class Encoder:
    """Texts to ids; pieces seen before are remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.transducer = Transducer(vocabulary)
        self.special = vocabulary.special
        self.cut = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None
        self.pattern, self.ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        self.seen: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        ids = self.older.get(piece)
        if ids is None:
            data, size = piece.encode(), 2 * self.transducer.lookahead
            if len(data) <= 2 * size:
                ids = self.transducer.whole(data)
            else:
                blocks = (data[i : i + size] for i in range(0, len(data), size))
                ids = [i for run in self.transducer.run(blocks) for i in run]
        if len(piece) <= 64:
            if len(self.seen) >= REMEMBERED:
                self.older, self.seen = self.seen, {}
            self.seen[piece] = ids = tuple(ids)
        return ids

    def _plain(self, text: str) -> Iterator[list[int]]:
        """Ids of a text without special tokens, a list for each window."""
        rest, at = "", 0
        while at < len(text) or rest:
            window, at = rest + text[at : at + WINDOW], at + WINDOW
            pattern = self.ascii if window.isascii() else self.pattern
            if at >= len(text):
                pieces, rest = pattern.findall(window), ""
            else:
                pieces, done = [], 0
                for m in pattern.finditer(window):
                    if m.end() == len(window) or m.start() + CONTRACTION > len(window):
                        break
                    pieces.append(m[0])
                    done = m.end()
                rest = window[done:]
            found = list(map(self.seen.get, pieces))
            if None in found:
                fresh = {p: self._piece(p) for p in {p for p, f in zip(pieces, found, strict=True) if f is None}}
                found = [fresh[p] if f is None else f for p, f in zip(pieces, found, strict=True)]
            yield list(chain.from_iterable(found))

    def runs(self, text: str) -> Iterator[list[int]]:
        done = 0
        for m in self.cut.finditer(text) if self.cut else ():
            if m.start() > done:
                yield from self._plain(text[done : m.start()])
            yield [self.special[m[0]]]
            done = m.end()
        if done < len(text):
            yield from self._plain(text[done:] if done else text)

    def encode(self, text: str | None) -> list[int]:
        runs = list(self.runs(text or ""))
        return runs[0] if len(runs) == 1 else [i for run in runs for i in run]


class Decoder:
    """Ids to text, a run at a time; :meth:`end` gives what an unfinished sequence leaves."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = [vocabulary.tokens.get(i, b"") for i in range(max(vocabulary.tokens, default=-1) + 1)]
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def end(self) -> str:
        left = self.state.decode(b"", True)
        self.state.reset()
        return left

    def decode(self, ids: list[int]) -> str:
        return "".join([self.feed(ids[i : i + WINDOW]) for i in range(0, len(ids), WINDOW)]) + self.end()


def _loaded(documents: DataFrame, tokenizer: str):
    made = Vocabulary.read(tokenizer)
    return documents.sparkSession.sparkContext.broadcast({"parts": (made.tokens, made.rank, made.special)})


def _encoder(shared) -> Encoder:
    """One encoder for all tasks of a worker process, so that it remembers pieces of earlier tasks."""
    held = shared.value
    if "encoder" not in held:
        held["encoder"] = Encoder(Vocabulary(*held["parts"]))
    return held["encoder"]


def _decoder(shared) -> Decoder:
    return Decoder(Vocabulary(*shared.value["parts"]))


def _with(batch: pa.RecordBatch, drop: set[str], **columns: pa.Array) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n not in drop | set(columns)]
    return pa.record_batch(
        [*(batch.column(i) for i in kept), *columns.values()], names=[*(batch.schema.names[i] for i in kept), *columns]
    )


def _schema(documents: DataFrame, drop: set[str], added: str) -> str:
    kept = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in documents.schema if f.name not in drop]
    return ", ".join([*kept, added])


def encode(documents: DataFrame, tokenizer: str) -> DataFrame:
    """``documents`` with ``ids`` (array<int>) in place of ``text``."""
    shared = _loaded(documents, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for part in _slices(batch):
                ids = [np.array(encoder.encode(t), dtype=np.int32) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield _with(part, {"text"}, ids=pa.ListArray.from_arrays(pa.array(ends), flat))

    return documents.mapInArrow(run, _schema(documents, {"text", "ids"}, "ids array<int>"))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with ``text`` in place of ``ids``."""
    shared = _loaded(encoded, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(shared)
        for batch in batches:
            for part in _slices(batch):
                texts = [decoder.decode(ids or []) for ids in part.column("ids").to_pylist()]
                yield _with(part, {"ids"}, text=pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, _schema(encoded, {"text", "ids"}, "text string"))


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, len(batch), rows))


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again as a stream.

    Tokens go from the encoder to the decoder and both digests a run at a time, so nothing of a text's
    size is held but the text.
    """
    shared = _loaded(documents, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # of earlier tasks of this process
        encoder, decoder = _encoder(shared), _decoder(shared)
        names = [str(i) for i in range(len(decoder.bytes))]
        for batch in batches:
            for part in _slices(batch):
                rows = []
                for text in part.column(1).to_pylist():
                    ids_sha, text_sha, count = hashlib.sha256(), hashlib.sha256(), 0
                    for ids in encoder.runs(text or ""):
                        if ids:
                            ids_sha.update((("," if count else "") + ",".join(map(names.__getitem__, ids))).encode())
                            text_sha.update(decoder.feed(ids).encode())
                            count += len(ids)
                    text_sha.update(decoder.end().encode())
                    rows.append((count, ids_sha.hexdigest(), text_sha.hexdigest()))
                counts, first, second = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.record_batch(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    texts = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
