"""Phrases from the graph against counts of all phrases; paths against repeated passages; long pieces, odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from sitewarden.llm import collocations as graph


def pieces(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n-\r]", low)]


def plain(docs, longest=5, least=100, k=2000):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in docs:
        for p in pieces(text):
            n[lang or "und"] += len(p)
            for size in range(1, longest + 1):
                counts[lang or "und"].update(tuple(p[i : i + size]) for i in range(len(p) - size + 1))
    out = []
    for lang, f in counts.items():
        often = {g: c for g, c in f.items() if 2 <= len(g) and c >= least}
        covered = set()
        for g, c in often.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g) and 100 * c >= 100 * f[g[i:j]]:
                        covered.add(g[i:j])
        rows = []
        for g, a in often.items():
            if g not in covered:
                score, _, left, right = min((1000 * a * n[lang] // (f[g[:c]] * f[g[c:]]), c, f[g[:c]], f[g[c:]]) for c in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, r, p.decode(), -a, le, ri, n[lang], -s) for r, (s, a, p, le, ri) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


SCHEMA = "doc_id long, text string, lang string, phrase string, f int"


def found(spark, docs, k=2000, **options):
    phrases, _ = graph.mine(spark.createDataFrame(docs, SCHEMA), **options)
    rows = graph.ranked(phrases, k, 3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    return sorted(tuple(r) for r in rows)


def sample(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "in", "é", "É", "дом", "\x00x", "nb sp"] + [f"w{i}" for i in range(30)]
    weights = [20] * 4 + [5] * 4 + [1] * 30
    text = lambda m: "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n"]) for w in rng.choices(vocabulary, weights, k=m))
    passage = "this very passage stands in many texts without any change at all"
    docs = [(i, text(rng.randrange(60)) + (passage if i % 3 == 0 else "") + text(5), rng.choice(["en", "de", None]), "x", None) for i in range(n)]
    return docs + [(None, None, "en", None, 1), (1, "", None, "", 2), (2, ".,;", "fr", "", 3), (3, docs[3][1], "de", "x", None), (4, "und word", "und", "", 1)]


@pytest.mark.parametrize("seed,options", [
    (1, {"least": 3}), (2, {"least": 5, "held": 20}), (3, {"least": 2, "block": 40}), (4, {"least": 4, "longest": 3}), (5, {"least": 1}), (6, {"least": 6, "longest": 2})])
def test_equals_counts(spark, seed, options):
    docs = sample(seed)
    want = {k: v for k, v in options.items() if k in ("least", "longest")}
    assert found(spark, docs, **options) == plain(docs, **want)


def test_first_of_each_language(spark):
    docs = sample(7)
    assert found(spark, docs, k=4, least=2) == plain(docs, least=2, k=4)


def test_one_endless_piece(spark):
    rng = random.Random(8)
    words = [rng.choice("abcde") * rng.randrange(1, 4) for _ in range(3000)] + ["x" * 500] + [rng.choice("ab") for _ in range(500)]
    docs = [(1, " ".join(words), "en", "", 0), (2, "\t".join(words[:700]), "en", "", 0)]
    assert found(spark, docs, least=3, block=256) == plain(docs, least=3)


def test_paths_are_whole_passages(spark):
    first = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron pi rho sigma tau".split()
    second = "one two three four five six".split()
    docs = [(i, " ".join(first), "en", "", 0) for i in range(5)] + [(i, " ".join(second + [f"end{i}"]), "en", "", 0) for i in range(4)]
    docs += [(i, "zz " * 9, "en", "", 0) for i in range(4)]
    _, paths = graph.mine(spark.createDataFrame(docs, SCHEMA), least=3)
    got = sorted((tuple(r.path), r.f) for r in paths.collect())
    assert got == sorted([(tuple(first), 5), (tuple(second), 4), (("zz",) * 5, 20)])


def test_empty_table(spark):
    assert found(spark, []) == []
