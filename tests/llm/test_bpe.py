import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from slotmeter.llm.bpe import Bpe, Decoder, Stream, decode_ids, encode_texts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = Bpe(open(PATH, encoding="utf-8").read())


def ids(text):
    [(raw, n)] = OWN.encode_many([text])
    found = [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw), 4)]
    assert len(found) == n
    return found


def decoded(some, names=False, step=None):
    decoder = Decoder(OWN, names)
    return "".join(decoder.feed(some[k : k + (step or len(some))]) for k in range(0, len(some), step or len(some) or 1)) + decoder.close()


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = ids(text)
    assert got == want
    assert decoded(got, names=True) == LIBRARY.decode(want, skip_special_tokens=False)


CASES = [
    "", " ", "Hello, World's 'tis we'll 123 ABC", "a<|endoftext|>b <|startoftext|>", "ΣΑΣ Σ İstanbul ß ẞ", "été ñ é", "x y z　w\x85v",
    "\x1c\x1d a\x1fb", "日本語 テスト 한국어 😀👍🏽 a😀b", "​﻿\u0000 \x00", "don't ''s 'S 'LL '", "ǅ ﬁ ½ ² ٣ Ⅷ", "…—“quotes”", "aaaa" * 50, "-" * 100,
]


@pytest.mark.parametrize("text", CASES)
def test_same_as_the_library_on_cases(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cn", "Cs"]), max_size=60))
def test_same_as_the_library_on_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeinorst'.1 é", max_size=80))
def test_same_as_the_library_on_letters(text):
    same(text)


def test_long_pieces_in_constant_memory():
    rng = random.Random(4)
    for alphabet in ("ab", "thinger", "abcdefghijklmnopqrstuvwxyzé"):
        piece = "".join(rng.choice(alphabet) for _ in range(30_000))
        letters = "".join(OWN.letters[b] for b in piece.encode())
        stream, got, held = Stream(OWN), [], 0
        for k in range(0, len(letters), 777):
            got += stream.feed(letters[k : k + 777])
            held = max(held, len(stream.letters))
        got += stream.close()
        assert got == LIBRARY.encode(piece, add_special_tokens=False).ids
        assert held <= 2 * (OWN.lookahead + OWN.longest) + 1024


def test_decoding_is_incremental_and_mends_bytes():
    some = ids("Héllo wörld 日本<|endoftext|>x")
    assert all(decoded(some, step=k) == "héllo wörld 日本 <|endoftext|>x " for k in (1, 2, 3, 50))
    assert all(decoded(some, names=True, step=k) == LIBRARY.decode(some, skip_special_tokens=False) for k in (1, 2, 50))
    half = OWN.ids[OWN.letters[0xE6]]
    decoder = Decoder(OWN)
    assert decoder.feed([half]) == "" and decoder.close() == "�" and decoder.feed(some[:1]) + decoder.close() == decoded(some[:1])
    with pytest.raises(ValueError):
        decoder.feed([10**6])


def test_frames(spark):
    rows = [(1, "The cat sat"), (1, "The cat sat"), (2, None), (3, ""), (None, "é" * 5000 + " word" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as ids", "text as decoded")
    got = decode_ids(encode_texts(docs, PATH), PATH).collect()
    assert len(got) == 5
    for r in got:
        want = LIBRARY.encode(dict(rows)[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == LIBRARY.decode(want, skip_special_tokens=False)
    assert decode_ids(encode_texts(docs.limit(0), PATH), PATH).collect() == []


def test_query_on_documents(spark):
    from slotmeter.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op8_bpe"](spark, "/root/testdata/sf0.001").collect():
        want = LIBRARY.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(want, skip_special_tokens=False)
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
