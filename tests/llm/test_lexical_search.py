"""Ranked search against counting by regular expressions: ties, copies, long texts, several blocks of items, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sitewarden.llm import lexical_search as lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    rows = [(key, Counter(terms(t))) for key, t, *_ in docs]
    rows = [(key, c, sum(c.values())) for key, c in rows if c]
    total, length = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    asked = {}
    for key, t, *_ in items:
        asked.setdefault(key, set()).update(terms(t))
    out = []
    for key, wanted in asked.items():
        scored = []
        for doc, c, n in rows:
            m = 100 - 90 + (90 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, math.inf if doc is None else doc))
        out += [(key, r, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, score string")
    i = spark.createDataFrame(items, "item_id long, text string, rank int")
    return sorted([tuple(r) for r in lexical.rank_documents(d, i, **options).select("item_id", "rank", "doc_id", "score").collect()], key=str)


def sample(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["a", "Aa", "aaa", "é", "É", "ba", "nana", "x1", "1x", "ё", "日本", "long" * 30] + [f"w{i}" for i in range(40)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ",", "\n", "--", "_"]) for _ in range(n))
    docs = [(i, text(rng.randrange(40)), "x", None) for i in range(n)]
    docs += [(i + 1000, docs[7][1], "x", None) for i in range(30)] + [(None, docs[7][1], None, "y"), (7, docs[7][1], None, "y")]
    docs += [(500, None, "", ""), (501, "", "", ""), (502, " ,, ", "", ""), (503, text(4000), "", "")]
    items = [(i, text(rng.randrange(12)), 1) for i in range(8)] + [(3, "w1 w2", 2), (None, "aaa w3", 0), (50, None, 0), (51, "nowhere", 0)]
    return docs, items


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"block_chars": 60}), (3, {"k": 3}), (4, {"k": 200})])
def test_equals_count(spark, seed, options):
    docs, items = sample(seed)
    assert found(spark, docs, items, **options) == plain(docs, items, options.get("k", 10))


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SCAN_BYTES", 50)
    docs, items = sample(5)
    finder = lexical.automaton([b"w1", "é".encode(), b"aaa"])
    for _, text, *_ in docs:
        blank = (text or "").encode().translate(lexical._BYTES).decode("latin-1")
        counts = Counter(terms(text))
        assert dict(lexical._scanned(blank, finder)) == {i: counts[t] for i, t in enumerate(["w1", "é", "aaa"]) if counts[t]}


def test_empty_tables(spark):
    docs, items = sample(6, 10)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_large_sums_stay_exact():
    best = lexical.Best(1, 2)
    best.take(np.array([[1 << 60], [(1 << 60) + 1], [0]]), np.array([5, 6, 7]))
    assert best.id.tolist() == [6, 5]
    n = np.array([10**9])
    assert lexical._lengths_factor(n, 10**12, 10**15).tolist() == [10 + 90 * 10**21 // 10**15]
