import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import automaton
from tidemark.llm.automaton import Decoder, Encoder, Run, Transducer, decode, encode, merged, read_ranks, round_trip
from tidemark.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER, DECODER = Encoder(RANKS, public_tokenizers.PATTERN), Decoder(RANKS)
PARTS = ["<|endoftext|>", "'re", "'r", "'", "a", "aa", " ", "  ", "\n", "　", "\x1c", "\x85", "é", "漢字", "😀", "12", "½", "!!", "=", "\t", " the", "ing", "̀", "zzzz"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=6), max_size=30).map("".join))
def test_same_as_the_library(text):
    ids = ENCODER.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert DECODER.decode(ids) == text


def test_other_ranks():
    """Also where a token has several ways to be merged, and where states are thrown away all the time."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    encoder, r = Encoder(read_ranks(path), public_tokenizers.PATTERN), random.Random(2)
    encoder.transducer.states = 50
    for _ in range(300):
        text = "".join(r.choice("etaoinsrhldé漢 ") for _ in range(r.randrange(60)))
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_long_pieces_cross_windows(monkeypatch):
    r = random.Random(3)
    texts = ["a" * 70_000, "x" * 65_535 + "'re " * 3, " " * 66_000 + "y", " " * 140_000, "é" * 65_537 + "漢" * 20_000, "12" * 40_000 + "'" * 70_000 + "ll", "".join(r.choice("etaoins") for _ in range(140_000)) + "\n" * 65_536 + "z"]
    for text in texts:
        assert ENCODER.encode(text) == LIBRARY.encode_ordinary(text)
    monkeypatch.setattr(automaton, "WINDOW", 40)
    monkeypatch.setattr(automaton, "LONG", 10)
    for _ in range(200):
        text = "".join(r.choice(PARTS) * r.choice([1, 1, 1, 30]) for _ in range(12))
        assert ENCODER.encode(text) == LIBRARY.encode_ordinary(text)


def test_tokens_leave_while_a_piece_is_read():
    """What is held does not grow with the piece, and the tokens are those of the definition."""
    r, run, out, held = random.Random(5), Run(Transducer(RANKS)), [], []
    piece = "".join(r.choice("etaoinsrhld") for _ in range(60_000)).encode()
    for i in range(0, len(piece), 1000):
        out += run.feed(piece[i : i + 1000])
        held.append(len(run.tokens))
    out += run.end()
    spell = {i: t for t, i in RANKS.items()}
    assert b"".join(spell[i] for i in out) == piece and max(held) < 300
    assert [spell[i] for i in out][:500] == merged(piece[:3000], RANKS)[:500]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=12) | st.text(max_size=6).map(str.encode), st.integers(1, 4))
def test_decoder_is_incremental(data, step):
    ids = [RANKS[bytes([b])] for b in data]
    decoder, parts = Decoder(RANKS), []
    for i in range(0, len(ids), step):
        parts.append(decoder.feed(ids[i : i + step]))
        assert len(decoder.held) < 4
    parts.append(decoder.end())
    assert b"".join(parts) == data
    assert "".join(p.decode("utf-8", "replace") for p in parts) == data.decode("utf-8", "replace")


def test_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_automaton_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, "x " * 200_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("'q' AS IDS", "0 AS n_tokens", "*", "1 AS `a``b`")
    got = sorted(((r.doc_id, r.n_tokens) for r in round_trip(frame, PATH).collect()), key=repr)
    assert got == sorted([(1, 0), (2, 0), (None, 2), (3, 2), (3, 2), (4, len(LIBRARY.encode_ordinary("x " * 200_000)))], key=repr)
    coded = encode(frame, PATH)
    assert coded.columns == ["n_tokens", "doc_id", "a`b", "ids"]
    assert [r.text for r in decode(coded, PATH).orderBy("doc_id").collect()] == ["a b", "", "", "a b", "a b", "x " * 200_000]
    odd = spark.createDataFrame([([64, None, 99_999, 65],), (None,)], "ids array<int>")
    assert [r.text for r in decode(odd, PATH).collect()] == [DECODER.decode([64, 65]), ""]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert round_trip(empty, PATH).collect() == [] and decode(encode(empty, PATH), PATH).collect() == []


def test_bytes_without_token_are_refused():
    with pytest.raises(ValueError):
        Transducer({b"a": 0}).piece(b"ab")
