"""The chain: optimiser against the gradient, use of earlier categories, accuracy on labels that were not fitted."""

import numpy as np
import pyarrow.parquet as pq

from sitewarden.llm import queries
from sitewarden.llm import toxicity as T

FOLDER = "/root/testdata/sf0.1"


def test_fit_reaches_the_minimum():
    rng = np.random.default_rng(0)
    row = np.repeat(np.arange(200), 5)
    index = rng.integers(0, 30, 1000)
    y = rng.integers(0, 2, 200).astype(float)
    dense = rng.normal(size=(200, 1))
    x = T.fit_logistic((index, row), dense, y, 30, steps=300)
    value, grad = T._loss(x, (index, row), dense, y, 30, T.PENALTY)
    assert np.abs(grad).max() < 0.5
    for _ in range(20):
        assert T._loss(x + rng.normal(size=len(x)) * 0.05, (index, row), dense, y, 30, T.PENALTY)[0] >= value - 1e-3


def test_later_models_use_earlier_categories():
    rng = np.random.default_rng(1)
    first = rng.random(600) < 0.5
    columns = [np.array([0] if f else [1]) for f in first]
    chain = T.fit_chain(columns, np.column_stack([first, first]), ["a", "b"], {10: 0, 11: 1})
    p = chain.predict([np.array([0]), np.array([1]), np.array([], int)])
    assert (p[0] > 0.9).all() and (p[1] < 0.1).all()
    assert abs(chain.models[1][len(chain.index)]) > 0.1  # the weight of the earlier probability


def test_held_out_labels(spark, monkeypatch):
    monkeypatch.setattr(T, "ROWS", 2000)
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    marks = labels.selectExpr("doc_id", "1 - quality as low_quality", "toxic")
    chain = T.fit(docs, marks.where("doc_id % 3 <> 0"), ["low_quality", "toxic"])
    got = {r.doc_id: r for r in T.predict(docs, chain, ["low_quality", "toxic"]).collect()}
    truth = [r for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist() if r["doc_id"] % 3 == 0]
    toxic = np.array([r["toxic"] for r in truth]) == 1
    found = np.array([got[r["doc_id"]].p_toxic >= 0.5 for r in truth])
    assert found[toxic].mean() > 0.88 and found[~toxic].mean() < 0.01
    assert len(got) == docs.count()


def test_bound_of_labelled_rows(spark, monkeypatch):
    docs = spark.range(6500).selectExpr("id as doc_id", "concat('word', id % 7) as text")
    labels = spark.range(6500).selectExpr("id as doc_id", "int(id % 7 = 0) as toxic")
    seen = []
    monkeypatch.setattr(T, "fit_chain", lambda columns, *rest: seen.append(len(columns)))
    T.fit(docs, labels, ["toxic"])
    T.fit(docs, labels, ["toxic"], rows=500)
    assert seen == [6000, 500]


def test_held_out_labels_of_a_bounded_sample(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    marks = labels.selectExpr("doc_id", "1 - quality as low_quality", "toxic").where("doc_id % 3 <> 0")
    chain = T.fit(docs, marks, ["low_quality", "toxic"], rows=2000)
    got = {r.doc_id: r for r in T.predict(docs, chain, ["low_quality", "toxic"]).collect()}
    truth = [r for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist() if r["doc_id"] % 3 == 0]
    toxic = np.array([r["toxic"] for r in truth]) == 1
    found = np.array([got[r["doc_id"]].p_toxic >= 0.5 for r in truth])
    assert found[toxic].mean() > 0.85 and found[~toxic].mean() < 0.01


def test_odd_rows(spark):
    rows = [(i, "you vile moron here" if i % 2 else "a fine kind day", 0.0) for i in range(40)] + [(50, None, 1.0), (51, "", 1.0), (None, "moron", 1.0), (3, "you vile moron here", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic double")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)] + [(3, 0, 1), (50, 1, 1), (60, 0, 0), (None, 1, 1), (52, None, 1)], "doc_id long, low_quality int, toxic int")
    chain = T.fit(docs, labels, ["low_quality", "toxic"])
    got = [(r.doc_id, r.p_toxic) for r in T.predict(docs, chain, ["low_quality", "toxic"]).collect()]
    assert len(got) == len(rows) and all((p > 0.5) == bool(i % 2) for i, p in got if i is not None and i < 40)
    assert dict(got)[None] > 0.5
    assert T.fit(docs, labels.where("false"), ["toxic"]) is None
    assert {r.p_toxic for r in T.predict(docs, None, ["toxic"]).collect()} == {0.0}
    assert T.predict(docs.where("false"), chain, ["low_quality", "toxic"]).collect() == []


def test_query_shape(spark):
    df = queries.op2(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "p_low_quality", "p_toxic", "toxic"] and df.count() == 200
