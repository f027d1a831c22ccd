"""Neighbours against brute force: recall, scores, ties, unusable vectors, split buckets."""

import numpy as np
import pytest

from sitewarden.llm import cross_polytope as C

SCHEMA = "vec_id long, embedding array<float>, cell int"


def product(x, y):
    total = 0.0
    for a, b in zip(x, y):  # sum() would compensate
        total += a * b
    return total


def brute(rows, queries, k):
    out = {}
    for q, x in queries:
        scored = [(-product(x, y), i) for i, y in rows if i != q]
        out[q] = sorted(scored)[:k]
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scaled:
        x *= rng.uniform(0.7, 1.3, (len(x), 1)).astype(np.float32)
    x[100:160] = x[7]  # many equal rows: ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = C.search(df.where("vec_id % 20 = 0"), df, k=20, bucket_rows=40).collect()
    want = brute(rows, rows[::20], 20)
    hits = 0
    for q, best in want.items():
        mine = sorted((r["rank"], r.id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        scores = {i: -s for s, i in brute(rows, [rows[q]], len(rows))[q]}
        assert all(m[2] == scores[m[1]] for m in mine)
        assert [m[1] for m in mine] == sorted((m[1] for m in mine), key=lambda i: (-scores[i], i))
        hits += len({m[1] for m in mine} & {i for _, i in best})
    assert hits / (20 * len(want)) >= 0.9
    top = sorted((r["rank"], r.id) for r in got if r.query_id == 100)
    assert [i for _, i in top] == [7] + list(range(101, 120))


@pytest.mark.parametrize("norms", ["double", "tenfold", "hundredfold", "lognormal"])
def test_recall_with_uneven_norms(spark, norms):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "lognormal":
        x *= rng.lognormal(0, 0.5, (len(x), 1))
    else:
        x[7] *= {"double": 2, "tenfold": 10, "hundredfold": 100}[norms]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))], SCHEMA)
    got = C.search(df.where("vec_id % 20 = 0"), df, k=20).collect()
    scores = x[::20] @ x.T
    scores[np.arange(100), np.arange(0, 2000, 20)] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    assert len({(r.query_id, r.id) for r in got} & {(20 * q, int(i)) for q, row in enumerate(best) for i in row}) >= 0.9 * 2000


@pytest.mark.parametrize("count", [10, 15, 21])
def test_few_rows_are_all_found(spark, count):
    x = np.random.default_rng(count).normal(size=(count, 64)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = C.search(df.where("vec_id % 20 = 0"), df).collect()
    for q, best in brute(rows, rows[::20], 20).items():
        mine = sorted((r["rank"], r.id, -r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, min(20, count - 1) + 1))
        assert [(s, i) for _, i, s in mine] == best


def test_unusable_rows(spark):
    good = [(i, [1.0, float(i), 0.5]) for i in range(8)]
    bad = [(20, None), (40, []), (60, [0.0, 0.0, 0.0]), (80, [1.0, None, 2.0]), (100, [float("nan"), 1.0, 1.0]), (120, [float("inf"), 1.0, 1.0]),
           (140, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in good + bad], SCHEMA)
    got = C.search(df.where("vec_id % 20 = 0"), df, probes=6).collect()
    assert {r.query_id for r in got} == {0} and [r.id for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5, 6, 7]
    assert [r.score for r in sorted(got, key=lambda r: r["rank"])] == [1.25] * 7
    assert C.search(df.where("false"), df.where("false")).collect() == []
    assert C.search(df.where("false"), df).collect() == []


def test_hadamard_is_orthogonal():
    h = C.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(C.hadamard(h), np.eye(16))
