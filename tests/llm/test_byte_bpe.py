"""Encoding against the tiktoken library, exact round trips, appends and edits."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from sitewarden.llm import byte_bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "  \n\t x", "it's they're I'll", "a" * 700, " " * 500 + "b", "é𝕏日本語́ ½²٣", "\x1c\x1d\x1e\x1f\x85\xa0 ​x", "\x00\x01", "!!!???---" * 40,
       "ing" * 300, "<|endoftext|>", "ЖЖЖ" * 100, "\r\n\r\n", "'S 'T don'T"]


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_texts(library):
    encoder = B.TextEncoder(PATH, P.PATTERN)
    rng = random.Random(1)
    marks = "abcdehinort .,'\n\t é日0123456789ABC-"
    texts = ODD + ["".join(rng.choices(marks, k=rng.randint(1, 300))) for _ in range(300)]
    texts += ["".join(chr(c) for c in range(a, min(a + 97, 0x110000)) if not 0xD800 <= c < 0xE000) for a in range(1, 0x30000, 97)]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode_ordinary(t), t


def test_pieces_at_once_have_the_same_tables(vocabulary):
    rng = random.Random(4)
    pieces = [bytes(rng.choices(b"abthe ing\xc3\xa9\x00", k=rng.randint(1, 40))) for _ in range(300)] + [b"", b"a" * 2000]
    last, base = B.PieceEncoder(vocabulary).last_tokens(np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64), np.array([len(p) for p in pieces]))
    for p, at in zip(pieces, base):
        assert last[at:at + len(p) + 1].tolist() == B.PrefixEncoding(vocabulary, p).last


def test_appends_and_edits(vocabulary, library):
    rng = random.Random(2)
    for _ in range(60):
        data = bytes(rng.choices(b"aabbthe ing\xc3\xa9", k=rng.randint(0, 400)))
        e = B.PrefixEncoding(vocabulary, data[: len(data) // 2])
        e.append(data[len(data) // 2 :])
        assert e.ids() == B.PrefixEncoding(vocabulary, data).ids() == library._core_bpe.encode_single_piece(data) if data else e.ids() == []
        a = rng.randint(0, len(data))
        b = rng.randint(a, min(len(data), a + 5))
        new = bytes(rng.choices(b"the ing", k=rng.randint(0, 6)))
        done = e.replace(a, b, new)
        assert e.last == B.PrefixEncoding(vocabulary, data[:a] + new + data[b:]).last
        assert done <= len(new) + len(data) - b


def test_edit_stops_early(vocabulary):
    e = B.PrefixEncoding(vocabulary, b"xyz " * 2000)
    assert e.replace(40, 42, b"Q") < 400
    assert e.last == B.PrefixEncoding(vocabulary, e.data).last


def test_long_texts_and_pieces(library):
    encoder, rng = B.TextEncoder(PATH, P.PATTERN), random.Random(6)
    words = " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(250_000))
    run = "".join(rng.choices("abc", k=60_000))
    texts = ["short", words, "x " + run + " y", " " * 30_000 + "b", "end"]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode_ordinary(t)


def test_frames(spark, library):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([None, *ODD])] + [(None, "x", 2), (1, "twice", 1), (1, "twice", 1)], "doc_id long, text string, ids int")
    rows = B.decode(B.encode(docs, PATH, P.PATTERN), PATH).collect()
    texts = [None, *ODD]
    assert len(rows) == len(texts) + 3
    for r in rows[: len(texts)]:
        assert r.ids == library.encode_ordinary(texts[r.id] or "") and bytes(r.decoded) == (texts[r.id] or "").encode()
    assert B.decode(B.encode(docs.where("false"), PATH, P.PATTERN), PATH).collect() == []
    once = B.encode(docs, PATH, P.PATTERN, decoded=True).collect()
    assert sorted(map(str, once)) == sorted(map(str, rows))
