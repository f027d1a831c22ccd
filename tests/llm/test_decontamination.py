"""Winnowing against a scan of all windows: short items, long texts in segments, hot passages, nulls and clashing names."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from sitewarden.llm import decontamination as leaks
from sitewarden.llm.words import gram_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, window=10):
    windows = defaultdict(set)
    for key, text, *_ in items:
        w = words(text)
        m = min(window, len(w))
        for p in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[p : p + m])].add(key)
    out = []
    for key, text, *_ in docs:
        w, hit, of = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for p in range(len(w) - m + 1):
                if tuple(w[p : p + m]) in windows:
                    hit.update(range(p, p + m))
                    of |= windows[tuple(w[p : p + m])]
        out.append((key, len(w), len(hit), sorted(str(x) for x in of if x is not None)))
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string, row string, spans string")
    i = spark.createDataFrame(items, "item_id long, text string, family int")
    rows = leaks.find_leaks(d, i, **options).collect()
    assert len({r.row for r in rows}) == len(docs)
    for r in rows:
        assert all(a["to"] <= b["from"] for a, b in zip(r.spans, r.spans[1:]))
    return sorted([(r.doc_id, r.n_words, sum(s["to"] - s["from"] for s in r.spans), sorted(str(x) for x in r["items"])) for r in rows], key=str)


def sample(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "Bc", "dé", "x1", "ZZ", "ё", "w" * 80, "q_q"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " -- ", "\x00"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 14, 30])), 5) for i in range(6)]
    items += [(None, text(12), 1), (7, None, 1), (8, "", 2), (9, "!!", 3), (2, text(10), 1)]
    passages = [t for _, t, _ in items if t]
    docs = [(i, text(rng.randrange(30)) + rng.choice(passages) + " " + text(rng.randrange(30)), "r", None) for i in range(25)]
    docs += [(None, passages[4], "", ""), (30, None, "x", "y"), (31, "", "x", "y"), (3, docs[3][1], "r", None),
             (32, " ".join(text(40) + p for p in passages * 3), "r", None)]
    return docs, items


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"broadcast_rows": 0}), (3, {"block": 300}), (4, {"gram": 3, "broadcast_rows": 0, "block": 64})])
def test_equals_scan(spark, seed, options):
    docs, items = sample(seed)
    assert found(spark, docs, items, **options) == plain(docs, items)


def test_long_text_and_span_beyond_a_block(spark):
    rng = random.Random(5)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(12_000))
    docs = [(1, "before, " + long + " after", "", ""), (2, "w" * 5000 + " " + long[3000:9000], "", "")]
    items = [(1, long[2000:60_000], 0), (2, "w" * 5000, 0)]
    assert found(spark, docs, items, block=4096) == plain(docs, items)


def test_passage_in_most_documents(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(i, f"{i} {passage} {i}", "", "") for i in range(3000)]
    got = found(spark, docs, [(1, passage, 0), (2, passage + " twelve", 0)], broadcast_rows=0)
    assert len(got) == 3000 and {(n, hit, tuple(of)) for _, n, hit, of in got} == {(13, 11, ("1", "2"))}


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b", 0)]) == []
    assert found(spark, [(1, "a b c", "", "")], []) == [(1, 3, 0, [])]


def test_every_shared_span_shares_a_fingerprint():
    rng = np.random.default_rng(3)
    for _ in range(200):
        span = rng.integers(0, 4, 10).astype(np.uint64)
        sides = []
        for _ in range(2):
            lead = int(rng.integers(0, 20))
            whole = np.concatenate([rng.integers(0, 4, lead), span, rng.integers(0, 4, int(rng.integers(0, 20)))]).astype(np.uint64)
            hashes = gram_hashes(whole, 5, 10)
            places = leaks.winnow(hashes, 6, np.ones(len(hashes), bool))
            sides.append({int(p) - lead for p in places if lead <= p <= lead + 5})
        assert sides[0] & sides[1]
