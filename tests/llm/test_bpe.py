import hashlib
import random

import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.bpe import Decoder, Encoder, Transducer, Vocabulary, decode, encode, merge_all, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
VOCABULARY = Vocabulary.read(PATH)
ENCODER, DECODER = Encoder(VOCABULARY), Decoder(VOCABULARY)
PARTS = ["<|endoftext|>", "'re", "'r", "'", "a", "aa", " ", "  ", "\n", "　", "\x1c", "\x85", "é", "漢字", "😀", "12", "½", "!!", "=", "\t", " the", "ing", "̀", "zzzz", "<|endof"]


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=6), max_size=30).map("".join))
def test_same_as_the_library(text):
    ids = ENCODER.encode(text)
    assert ids == library(text)
    assert DECODER.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_long_texts_cross_windows():
    r = random.Random(3)
    for text in ["a" * 70_000, "".join(r.choice(PARTS) for _ in range(60_000)), "x" * 65_535 + "'re " * 3, " " * 66_000 + "y"]:
        assert ENCODER.encode(text) == library(text)


def test_tokens_leave_while_a_piece_is_read():
    r = random.Random(5)
    transducer, held = Transducer(VOCABULARY), []
    piece = "".join(r.choice("etaoinsrhld") for _ in range(30_000)).encode()
    out = []
    for run in transducer.run(piece[i : i + 64] for i in range(0, len(piece), 64)):
        out += run
        held.append(len(run))
    assert [VOCABULARY.tokens[i] for i in out] == merge_all(piece[:3000], VOCABULARY.rank)[:-20] + [VOCABULARY.tokens[i] for i in out][len(merge_all(piece[:3000], VOCABULARY.rank)) - 20 :]
    assert len(held) > 20 and b"".join(VOCABULARY.tokens[i] for i in out) == piece


def test_decoder_keeps_unfinished_sequences():
    byte = {t: i for i, t in VOCABULARY.tokens.items() if len(t) == 1}
    ids = [byte[bytes([b])] for b in "é😀".encode()]
    decoder = Decoder(VOCABULARY)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.end() == "é😀"
    assert decoder.decode(ids[:-1]) == "é�"


def test_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in round_trip(docs, PATH).collect():
        ids = library(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    coded = encode(docs, PATH)
    assert coded.columns == ["doc_id", "lang", "source", "n_chars", "ids"]
    assert {r.doc_id: r.text for r in decode(coded, PATH).collect()} == texts


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, "x " * 200_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS ids", "0 AS n_tokens")
    got = {(r.doc_id, r.n_tokens) for r in round_trip(frame, PATH).collect()}
    assert got == {(1, 0), (2, 0), (None, 2), (3, 2), (4, len(library("x " * 200_000)))}
    assert [r.text for r in decode(encode(frame, PATH), PATH).orderBy("doc_id").collect()] == ["a b", "", "", "a b", "a b", "x " * 200_000]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert round_trip(empty, PATH).collect() == [] and decode(encode(empty, PATH), PATH).collect() == []


def test_merge_lists_that_make_a_token_twice_are_refused():
    with pytest.raises(ValueError):
        Transducer(Vocabulary({0: b"a", 1: b"aa", 2: b"aaa"}, {(b"a", b"a"): 0, (b"aa", b"a"): 1, (b"a", b"aa"): 2}, {}))
