"""Packing: tokens against the library, places checked for gaps and overlaps, bin counts against the bound."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sitewarden.llm import packing
from sitewarden.llm.packing import WordTokenizer, best_fit, lower_bound, pack, pack_documents, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "Hello world's  we're!! 12½ don't", "É À ñandú ÇA Straße ŒUVRE", "日本語 İstanbul ΣΑΣ x\x85y", "<|startoftext|> a <|endoftext|>",
         "é combining ﬁ", "wörd " * 9000, "x" * 5000, " \n\t", "A.b!'s ''re l'eau", "tab\x0bform\x0cfeed"]


@pytest.fixture(scope="module")
def packed(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", 1), (2, TEXTS[2], 2), (2, TEXTS[2], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item int")
    return rows, pack_documents(docs, PATH, capacity=256, partition_items=12, with_ids=True)


def test_pieces_and_places(packed):
    rows, df = packed
    lib = Tokenizer.from_file(PATH)
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, p, a, len(ids[a:a + 256]), zlib.crc32(np.array(ids[a:a + 256], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 256))]
    got = df.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length, list(r.ids)))
    for parts in places.values():
        at = 0
        for offset, length, _ in sorted(parts, key=lambda x: x[0]):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 256) + 1
    whole = {r.sequence_id: r.ids for r in sequences(df).collect()}
    assert whole == {k: [x for _, _, ids in sorted(v, key=lambda x: x[0]) for x in ids] for k, v in places.items()}


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.parametrize("low,high,least", [(1, 300, 1.0), (300, 1900, 0.9), (1025, 2048, 1.0), (683, 700, 0.98)])
def test_rounds_reach_the_bound(spark, low, high, least):
    lengths = np.random.default_rng(low).integers(low, high + 1, 3000)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "item long, length long")
    got = pack(items, partition_items=200).collect()
    assert len(got) == 3000 and len({r.item for r in got}) == 3000
    fill = defaultdict(int)
    for r in got:
        fill[r.sequence_id] += int(lengths[r.item])
    assert max(fill.values()) <= 2048
    assert np.ceil(lower_bound(lengths, 2048) - 1e-9) / len(fill) >= least - 1e-3


def test_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 60, rng.integers(1, 80))
        where, offset, fill = best_fit(lengths, 60)
        assert lower_bound(lengths, 60) <= len(fill) + 1e-9
        assert fill.max() <= 60 and fill.sum() == lengths.sum()
        assert (np.bincount(where, lengths) == fill).all()


def test_every_latin_character_as_the_library():
    lib, own = Tokenizer.from_file(PATH), WordTokenizer(PATH, known_words=50)
    texts = [f"ab{chr(c)}cd {chr(c)}{chr(c)} X{chr(c)} {chr(c)}x '{chr(c)}s '{chr(c)}" for c in range(1, 0x251) if not 0xD800 <= c < 0xE000]
    texts += ["BAKI ƏHMED", "ÀƁ ɄɅ", "it's'S 're''RE 've'd'll'l 'm'm2's", "'", "''s", "'s", "x'", "x'l", "don't!'t", "½'s²'d", "a<|b", ""]
    ids, counts = own.encode_rows(texts)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_random_texts_as_the_library():
    rng = random.Random(9)
    letters = ["a", "S", "s", "t", "RE", "re", "ll", "'", "'", " ", " ", "\n", "é", "Ə", "1", "½", "!", "?", "<", "|", "ß", "ž", "word", "́", "日"]
    lib, own = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    texts = ["".join(rng.choices(letters[: 23 if i % 3 else 25], k=rng.randrange(40))) for i in range(3000)]
    ids, counts = own.encode_rows(texts)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    want = lib.encode_batch(texts, add_special_tokens=False)
    assert [(t, g) for t, g in zip(texts, got)] == [(t, e.ids) for t, e in zip(texts, want)]


def test_words_that_share_a_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(packing, "_STEPS", np.zeros_like(packing._STEPS))
    lib = Tokenizer.from_file(PATH)
    text = "one two three one four two seven"
    assert WordTokenizer(PATH).encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_certificates(spark):
    lengths = np.random.default_rng(4).integers(1, 1500, 2000)
    got = pack(spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "item long, length long"), partition_items=300).collect()
    assert all(r.bins >= r.bound > 0 for r in got)
    assert len({r.sequence_id for r in got}) >= np.ceil(lower_bound(lengths, 2048) - 1e-9)
