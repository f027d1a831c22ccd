"""Fingerprints and components against plain Python."""

import random

import numpy as np
import pytest
import xxhash

from sitewarden.llm import simhash_dedup as S


def plain_fp(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\r\x0b\x0c":
            words, word = words + [word] if word else words, ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=3):
    fps = [plain_fp(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        out.append((k, f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["wörd", "Alpha", "beta", "É", "gamma", "delta", "x", "yy", "zzz"]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40, 400]))) for _ in range(60)]
    texts = base + [t + " " + rng.choice(words) for t in base] + base[:20] + [None, "", " \n\t\x0b", " ", "a\x1cb c d e"]
    out = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    return out + [(None, "alone without id " * 9), (None, texts[0]), out[5], out[5]]


@pytest.mark.parametrize("leaf", [4, 40, 32_768])
def test_components(spark, rows, leaf):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = S.near_duplicates(docs, leaf=leaf).withColumn("fp", S.fingerprint_hex()).select("doc_id", "fp", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_components(rows)


def test_long_text_in_blocks():
    text = " ".join(str(i % 977) for i in range(70_000))
    assert S.simhash(text) & (1 << 64) - 1 == plain_fp(text)


def test_links_of_close_fingerprints(spark):
    """Random families and chains give the components of all pairs, with leaves of any size, also dealt out in blocks."""
    rng = np.random.default_rng(3)
    seeds = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = set(seeds) | {0, (1 << 64) - 1}
    for s in seeds[:20]:
        for _ in range(12):
            x = s
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    from sitewarden.llm.components import components

    for leaf, block in ((32_768, 65_536), (32_768, 7), (16, 65_536), (16, 5)):
        got = {r.node: r.root for r in components(S.links(df, leaf=leaf, block=block)).collect()}
        label = {x: x for x in fps}

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        for i, x in enumerate(fps):
            for y in fps[:i]:
                if (x ^ y).bit_count() <= 3:
                    label[find(x)] = find(y)
        want = {}
        for x in fps:
            want.setdefault(find(x), set()).add(S._signed(x))
        mine = {}
        for x in fps:
            mine.setdefault(got.get(S._signed(x), S._signed(x)), set()).add(S._signed(x))
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_visits_cover_every_near_pair_and_stay_few():
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 1 << 63, 30_000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 30_000).astype(np.uint64)
    tree = S.Tree(rng.permutation(fps)[:8192], 8)
    flips = np.zeros(len(fps), np.uint64)
    for _ in range(3):
        flips |= np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64)
    sides = []
    for side in (fps, fps ^ flips):
        leaf, row, own = tree.descend(side, 3)
        assert (np.bincount(row[own], minlength=len(side)) == 1).all()
        sides.append((set(zip(row.tolist(), leaf.tolist())), dict(zip(row[own].tolist(), leaf[own].tolist()))))
    for i in range(len(fps)):
        later = max(sides[0][1][i], sides[1][1][i])
        assert (i, later) in sides[0][0] and (i, later) in sides[1][0]
    home = np.bincount([*sides[0][1].values()], minlength=512)[256:]
    assert home.max() < 12 * len(fps) / 256  # the medians keep the leaves alike
    assert len(sides[0][0]) < 40 * len(fps)


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_drop_keeps_one_of_each(spark):
    rows = [(3, "the same words here in a row " * 5), (1, "THE same words here in a row " * 5), (2, "other things entirely are said now")]
    kept = S.drop_near_duplicates(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, _key int"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == ["doc_id", "text", "_key"]
