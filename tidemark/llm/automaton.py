"""Byte-level BPE by a rank file, as a lazily determinised finite-state transducer, and the way back.

The transducer. A state of the nondeterministic machine is (last finished token, node of the trie of all
tokens): reading a byte goes down the trie; at a token's node that token may be finished, if no merge of
the bytes of the two tokens crosses the boundary between them. Every prefix of a piece has one token
sequence that merging gives, so exactly one path at a time stands at the root. Determinised, a state is
the set of open paths, and its output the token that ends there; reading back from a boundary by these
outputs gives the tokens before it. Tokens are settled, and emitted, up to the last boundary through which
all open paths lead: these begin in the last bytes of the longest token, which bounds the lookahead.
States and moves are made when they are first needed, and thrown away together when they exceed a bound.

Ranks. Adjacent tokens whose bytes together are a token merge, the lowest rank first, the leftmost of
equals; a piece that is a token stays whole.

Texts are read in windows. A piece that goes on beyond a window is fed to the transducer part by part, so
the memory in use, besides the text, does not grow with the text or its pieces.

Decoding. Tokens give bytes; a state machine over UTF-8 lets whole characters through and holds back the
bytes of an unfinished one.

Defined cases. Null and empty texts have no tokens and decode to nothing. Repeated rows give repeated
rows; an empty table gives none. Very long texts are read in windows. A null or unknown id decodes to
nothing, bytes that are no UTF-8 to U+FFFD. :func:`encode` keeps other columns, but for one called ``ids``
in any case, which it replaces. The rank file is read on the driver; its size is the bound of what is
broadcast.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate, chain
from operator import getitem

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the format, for texts of ASCII alone: contractions, letters, digits, other signs, white space.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"
#: A piece that starts nearer to the end of a window than the longest contraction can still change.
CONTRACTION = 3
WINDOW, LONG = 1 << 16, 1 << 12
STATES, REMEMBERED = 150_000, 300_000
#: Bytes of a long piece between two looks for what is settled.
BLOCK = 256
#: The part of an open path that names its node.
NODE = (1 << 32) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, which are their ids."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merged(data: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """The definition: of the neighbours that form a token, those of least rank merge, leftmost first;
    only ranks less than ``below``."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] >= below:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class State(dict):
    """A determinised state: its moves by byte, made when they are missing; the open paths, each
    (last token + 1) << 32 | trie node; and the token that ends where it is reached."""

    __slots__ = ("machine", "paths", "last")

    def __missing__(self, byte: int) -> State:
        return self.machine.step(self, byte)


class Transducer:
    """All states made so far, by their open paths."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.states = ranks, states
        self.spell = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        #: The trie by node: children by byte, the token that ends there (or None), and the depth.
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.depth = [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self.child[node].get(byte)
                if below is None:
                    below = self.child[node][byte] = len(self.depth)
                    self.child.append({})
                    self.ends.append(None)
                    self.depth.append(self.depth[node] + 1)
                node = below
            self.ends[node] = rank
        self.sides: tuple[dict, dict] = ({}, {})
        self.agreed: dict[int, bool] = {}
        self.made: dict[tuple[int, ...], State] = {}
        self.start = self.state((0,))

    def standing(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """Parts that stand at one end of ``token`` while it is merged, and the rank that takes each.

        Empty for a token that its own bytes do not merge to.
        """
        known = self.sides[right].get(token)
        if known is None:
            known, part, until = [], self.spell[token], 1 << 60
            while len(part) > 1:
                known.append((part, until))
                until = self.ranks[part]
                halves = merged(part, self.ranks, until)
                if len(halves) != 2:
                    known = []
                    break
                part = halves[right]
            else:
                known.append((part, until))
            self.sides[right][token] = known
        return known

    def agree(self, before: int, token: int) -> bool:
        """Whether ``token`` can follow ``before`` (-1: begin a piece).

        It can unless a merge across the boundary comes while both its parts stand there. Of equal ranks
        the leftmost merges first.
        """
        right = self.standing(token, False)
        if before < 0 or not right:
            return bool(right)
        ranks = self.ranks
        for x, until_x in self.standing(before, True):
            for y, until_y in right:
                crossing = ranks.get(x + y)
                if crossing is not None and crossing < until_x and crossing <= until_y:
                    return False
        return True

    def state(self, paths: tuple[int, ...]) -> State:
        made = self.made.get(paths)
        if made is None:
            made = self.made[paths] = State()
            made.machine, made.paths, made.last = self, paths, (paths[-1] >> 32) - 1
        return made

    def step(self, state: State, byte: int) -> State:
        """A move that is not known yet."""
        child, ends, agreed = self.child, self.ends, self.agreed
        paths, found = [], -1
        for path in state.paths:
            below = child[path & NODE].get(byte)
            if below is not None:
                before = path & ~NODE
                if child[below]:
                    paths.append(before | below)
                if found < 0 and (token := ends[below]) is not None:
                    known = agreed.get(before | token)
                    if known is None:
                        known = agreed[before | token] = self.agree((path >> 32) - 1, token)
                    if known:
                        found = token
        if found < 0:
            raise ValueError(f"no token sequence ends with byte {byte}")
        paths.append((found + 1) << 32)
        then = state[byte] = self.state(tuple(paths))
        return then

    def trim(self) -> None:
        """Throws the states away when they are too many."""
        if len(self.made) > self.states or len(self.agreed) > 4 * self.states:
            for made in self.made.values():
                made.clear()  # states refer to each other
            self.made.clear()
            self.agreed.clear()
            self.start = self.state((0,))

    def piece(self, data: bytes) -> list[int]:
        """Tokens of a whole piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        states = list(accumulate(data, getitem, initial=self.start))
        out, end, size = [], len(data), self.size
        while end > 0:
            token = states[end].last
            out.append(token)
            end -= size[token]
        return out[::-1]


class Run:
    """A piece longer than any token, read in parts; what is returned is settled."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.paths = transducer, (0,)
        self.tokens: list[int] = []  # the token that ends at each byte since the last settled boundary

    def feed(self, data: bytes) -> list[int]:
        machine, out = self.transducer, []
        for first in range(0, len(data), BLOCK):
            machine.trim()
            states = list(accumulate(data[first : first + BLOCK], getitem, initial=machine.state(self.paths)))
            self.tokens += [state.last for state in states[1:]]
            self.paths = states[-1].paths
            settled = self._settled()
            out += self._read(settled)
            del self.tokens[:settled]
        return out

    def _settled(self) -> int:
        """The last boundary that all open paths share."""
        tokens, size = self.tokens, self.transducer.size
        bounds = {len(tokens) - self.transducer.depth[path & NODE] for path in self.paths}
        while len(bounds) > 1:
            most = max(bounds)
            bounds.discard(most)
            bounds.add(most - size[tokens[most - 1]])
        return bounds.pop()

    def _read(self, end: int) -> list[int]:
        out = []
        while end > 0:
            token = self.tokens[end - 1]
            out.append(token)
            end -= self.transducer.size[token]
        return out[::-1]

    def end(self) -> list[int]:
        return self._read(len(self.tokens))


class Pieces(dict):
    """Tokens of short pieces seen before, up to a bound; others are encoded when they are asked for."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            self.transducer.trim()
            ids = tuple(self.transducer.piece(piece.encode()))
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Texts to ids, a run at a time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern, self.ascii = regex.compile(pattern), re.compile(ASCII_PATTERN)
        self.kinds = [regex.compile(k) for k in (r"\s+", r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")]
        self.pieces = Pieces(self.transducer)

    def _ids(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def runs(self, text: str) -> Iterator[list[int]]:
        """Ids of a text; each list is settled."""
        if len(text) <= WINDOW:
            yield self._ids((self.ascii if text.isascii() else self.pattern).findall(text))
            return
        rest, kind, run = "", None, None  # kind and run: of a piece whose beginning has been fed
        for at in range(0, len(text), WINDOW):
            window, last, done = rest + text[at : at + WINDOW], at + WINDOW >= len(text), 0
            rest, ids = "", []
            if run is not None:
                more = kind.match(window)
                done = more.end() if more else 0
                goes_on = done == len(window) and not last
                if kind is self.kinds[0] and done and (goes_on or done < len(window)):
                    done -= 1  # the last white space may belong to what follows
                ids = run.feed(window[:done].encode())
                if goes_on:
                    rest = window[done:]
                    yield ids
                    continue
                ids += run.end()
                run = None
            pieces = []
            for m in self.pattern.finditer(window, done):
                if not last and (m.end() == len(window) or m.start() + CONTRACTION > len(window)):
                    rest = window[m.start() :]
                    break
                pieces.append(m[0])
            ids += self._ids(pieces)
            if len(rest) > LONG:
                kind, run = next(k for k in self.kinds if k.match(rest[-1])), Run(self.transducer)
                keep = 1 if kind is self.kinds[0] else 0
                ids += run.feed(rest[: len(rest) - keep].encode())
                rest = rest[len(rest) - keep :]
            yield ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.runs(text or "")))


def _table() -> list[list[int]]:
    """UTF-8 as a state machine. 0: between characters; 1, 2, 3: so many bytes to come; 4 to 7: the
    second byte after E0, ED, F0, F4; -1: no UTF-8."""
    rows = [[-1] * 256 for _ in range(8)]
    ranges = [
        (0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE0, 0xE0, 4), (0, 0xE1, 0xEF, 2), (0, 0xED, 0xED, 5), (0, 0xF0, 0xF0, 6),
        (0, 0xF1, 0xF3, 3), (0, 0xF4, 0xF4, 7), (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2),
        (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2),
    ]
    for state, low, high, then in ranges:
        rows[state][low : high + 1] = [then] * (high - low + 1)
    return rows


UTF8 = _table()


class Decoder:
    """Ids to bytes or text, a run at a time, whole characters only; ``end`` gives what is left."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.held = b""

    def feed(self, ids: list[int]) -> bytes:
        data = self.held + b"".join(map(self.bytes.__getitem__, ids))
        # An unfinished character begins in the last three bytes: only there the machine has to run.
        for first in range(max(0, len(data) - 3), len(data)):
            state = 0
            for byte in data[first:]:
                state = UTF8[state][byte] if state >= 0 else state
                if state == 0:
                    break
            if state > 0:
                self.held = data[first:]
                return data[:first]
        self.held = b""
        return data

    def feed_text(self, ids: list[int]) -> str:
        return self.feed(ids).decode("utf-8", "replace")

    def end(self) -> bytes:
        left, self.held = self.held, b""
        return left

    def decode(self, ids: list[int | None]) -> str:
        known = [i for i in ids if i is not None and 0 <= i < len(self.bytes)]
        runs = [self.feed_text(known[i : i + WINDOW]) for i in range(0, len(known), WINDOW)]
        return "".join(runs) + self.end().decode("utf-8", "replace")


def _loaded(frame: DataFrame, ranks: str, pattern: str | None = None):
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return frame.sparkSession.sparkContext.broadcast({"ranks": read_ranks(ranks), "pattern": pattern})


def _encoder(shared) -> Encoder:
    """One for all tasks of a worker process, so that it keeps the states of earlier tasks."""
    held = shared.value
    if "encoder" not in held:
        held["encoder"] = Encoder(held["ranks"], held["pattern"])
    return held["encoder"]


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without searches for cyclic garbage, which go through all states again and again: the only cycles
    are those of states, and these are cut when states are thrown away."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, len(batch), rows))


def _mapped(frame: DataFrame, old: str, new: str, kind: str, run) -> DataFrame:
    """``frame`` with the column ``new`` of type ``kind``, made by ``run`` from ``old``, in place of that one
    and of any called ``new``. ``run`` sees ``old`` last, and columns by number: any name may occur."""
    kept = [i for i, f in enumerate(frame.schema) if f.name.lower() not in (old, new)]
    numbered = frame.toDF(*[old if f.name.lower() == old else f"c{i}" for i, f in enumerate(frame.schema)])
    kinds = [f"c{i} {frame.schema[i].dataType.simpleString()}" for i in kept]
    made = numbered.select(*[f"c{i}" for i in kept], old).mapInArrow(run, ", ".join([*kinds, f"{new} {kind}"]))
    return made.toDF(*[frame.columns[i] for i in kept], new)


def encode(documents: DataFrame, ranks: str, pattern: str | None = None) -> DataFrame:
    """``documents`` with ``ids`` (array<int>), the last column, in place of ``text``."""
    shared = _loaded(documents, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for part in _slices(batch):
                with _uncollected():
                    ids = [np.array(encoder.encode(t), dtype=np.int32) for t in part.column(-1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                names = [*part.schema.names[:-1], "ids"]
                yield pa.record_batch([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), flat)], names=names)

    return _mapped(documents, "text", "ids", "array<int>", run)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` with ``text``, the last column, in place of ``ids``."""
    shared = _loaded(encoded, ranks, "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value["ranks"])
        for batch in batches:
            for part in _slices(batch):
                texts = [decoder.decode(ids or []) for ids in part.column(-1).to_pylist()]
                names = [*part.schema.names[:-1], "text"]
                yield pa.record_batch([*part.columns[:-1], pa.array(texts, pa.string())], names=names)

    return _mapped(encoded, "ids", "text", "string", run)


def round_trip(documents: DataFrame, ranks: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again as a stream.

    Digests are of the ids in decimal, joined by one space, and of the decoded bytes. A run of tokens goes
    from the encoder to the decoder and both digests and is forgotten.
    """
    shared = _loaded(documents, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(shared), Decoder(shared.value["ranks"])
        names = list(map(str, range(len(decoder.bytes))))

        def one(text: str | None) -> tuple[int, str, str]:
            ids_sha, bytes_sha, count = hashlib.sha256(), hashlib.sha256(), 0
            for ids in encoder.runs(text or ""):
                if ids:
                    ids_sha.update(((" " if count else "") + " ".join(map(names.__getitem__, ids))).encode())
                    bytes_sha.update(decoder.feed(ids))
                    count += len(ids)
            bytes_sha.update(decoder.end())
            return count, ids_sha.hexdigest(), bytes_sha.hexdigest()

        for batch in batches:
            for part in _slices(batch):
                with _uncollected():
                    rows = [one(text) for text in part.column(1).to_pylist()]
                counts, first, second = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.record_batch(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    texts = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
