"""Language identification: held-out accuracy, letterless texts, no look at labels while predicting."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from sitewarden.llm import language_id as L
from sitewarden.llm import queries

FOLDER = "/root/testdata/sf0.01"


def plain_kernel(a, b):
    grams = lambda t: {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    x, y = grams(a.lower()), grams(b.lower())
    return len(x & y) / np.sqrt(len(x) * len(y))


def test_kernel_and_regression():
    texts = ["the cat sat on the mat", "un chat est assis là", "the dog and the bird", "le chien et l'oiseau là"]
    labels, marks = np.array([0, 1, 0, 1]), np.arange(4)
    model = L.fit_kernel([L.ngrams(t) for t in texts], labels, marks, ["en", "fr"], ridge=0.01)
    k = np.array([[plain_kernel(a, b) for b in texts] for a in texts])
    dual = np.linalg.solve(k + 0.04 * np.eye(4), np.where(labels[:, None] == [0, 1], 1.0, -1.0))
    new = "the mat là 日本 \U0001f600"
    want = np.array([plain_kernel(new, t) for t in texts]) @ dual
    assert np.allclose(model.scores([new])[0], want, atol=1e-4)


@pytest.fixture(scope="module")
def predicted(spark):
    return queries.op5(spark, FOLDER).collect()


def test_held_out_accuracy(predicted):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}
    out = [r for r in predicted if r.held_out]
    assert len(predicted) == len(lang) and 0.15 < len(out) / len(lang) < 0.35
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in predicted)


def test_odd_texts(spark):
    docs = [(i, t, l) for i, (t, l) in enumerate([("hello there my friend", "en"), ("bonjour mon ami là", "fr")] * 20)]
    docs += [(100, None, "en"), (101, "", "en"), (102, "123 !? ½", "en"), (None, "hello friend", None), (103, "日本語", None), (104, "hello " * 200_000, "en")]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, lang string, score double")
    model = L.fit(df.where("doc_id < 40"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(df, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (100, 101, 102))
    assert got[None][0] == got[104][0] == "en" and got[103][0] in ("en", "fr") and got[1][0] == "fr"
    assert L.fit(df.where("doc_id in (100, 102)")) is None
    assert {r.lang_pred for r in L.predict(df, None).collect()} == {"und"}
    kept = L.keep_recognised(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()}.isdisjoint({100, 101, 102})
    assert L.predict(df.where("false"), model).collect() == []


def test_scripts_outside_the_alphabet(spark):
    rng = np.random.default_rng(3)
    kinds = {"en": range(97, 123), "fr": range(0xDF, 0x100), "cs": range(0x101, 0x137, 2), "vi": range(0x1EA0, 0x1EF0), "ko": range(0xAC00, 0xAC60), "th": range(0x0E01, 0x0E30)}
    docs = []
    for lang, points in kinds.items():
        words = ["".join(chr(points[j]) for j in rng.integers(0, len(points), 4)) for _ in range(40)]
        docs += [(lang, " ".join(rng.choice(words, 30 if lang in ("en", "fr", "cs") else 6))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string")
    model = L.fit(df.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r.lang_pred for r in L.predict(df, model).collect()}
    assert np.mean([got[i] == docs[i][0] for i in range(2, len(docs), 4)]) > 0.9


def test_blocks(monkeypatch):
    text = "".join(chr(97 + i * i % 23) for i in range(1000)) + "日本語 ёЁ" * 20
    whole = L.ngrams(text)
    low = text.lower()
    assert len(whole) == len({low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)})
    monkeypatch.setattr(L, "_BLOCK", 7)
    assert (L.ngrams(text) == whole).all()


def test_many_languages(spark):
    rng = np.random.default_rng(4)
    docs = []
    for k in range(230):
        points = [int(c) for c in rng.choice(np.arange(0x4E00, 0x9000), 12)]
        docs += [(f"l{k:03}", "".join(chr(points[j]) for j in rng.integers(0, 12, 40))) for _ in range(3)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string")
    model = L.fit(df.where("doc_id % 3 < 2"), landmarks=2)
    assert len(model.languages) == 230
    got = {r.doc_id: r.lang_pred for r in L.predict(df, model).collect()}
    assert np.mean([got[i] == docs[i][0] for i in range(2, len(docs), 3)]) > 0.9
