"""Repeated strings against a dictionary of all windows."""

import random

import numpy as np
import pytest

from sitewarden.llm import suffix_dedup as D


def brute(rows, length):
    """Removed byte positions per row; rows as (order, text bytes), equal orders being one document."""
    seen, out = {}, {}
    for order, data in sorted(set(rows)):
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            w = data[p:p + length]
            if w in seen:
                gone[p:p + length] = True
            else:
                seen[w] = (order, p)
        out[order] = gone
    return out


def texts():
    rng = random.Random(8)
    letters = "abé dß"
    line = "".join(rng.choices(letters, k=90))
    passage = "".join(rng.choices(letters, k=400))
    docs = ["".join(rng.choices(letters, k=rng.randint(0, 600))) for _ in range(30)]
    for i in range(25):
        a, b = rng.randint(0, 200), rng.randint(200, 400)
        docs.append("".join(rng.choices(letters, k=rng.randint(0, 120))) + passage[a:b] + "".join(rng.choices(letters, k=rng.randint(0, 120))))
        docs.append(docs[i][: len(docs[i]) // 2] + "!" + docs[i][len(docs[i]) // 2:])
    docs += [line * 5, "x" * 700, "xy" * 300 + "z", docs[3], docs[3], "", None, "\x00" * 150 + "\x01" * 150, passage + passage, "short", "x" * 99, "x" * 100]
    return docs


@pytest.mark.parametrize("hot", [500, 2])
def test_whole_tables(spark, hot):
    docs = texts()
    rows = [(i * 7 % 1000, t, 1) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, number int").repartition(5)
    got = D.remove_repeats(df, hot=hot).collect()
    want = brute([(i, (t or "").encode()) for i, t, _ in rows], 100)
    data = {i: (t or "").encode() for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        gone = want[r.doc_id]
        mine = np.zeros(len(gone), bool)
        for s in r.spans:
            assert not mine[max(0, s["from"] - 1):s["to"] + 1].any()
            mine[s["from"]:s["to"]] = True
        assert (mine == gone).all(), (r.doc_id, np.flatnonzero(mine != gone)[:5])
        assert bytes(r.kept) == bytes(np.frombuffer(data[r.doc_id], np.uint8)[~gone]) and r.n_bytes == len(gone)


def test_ids_null_and_repeated(spark):
    rng = random.Random(3)
    a, b = ("".join(rng.choices("abcdef ", k=300)) for _ in range(2))
    rows = [(None, a), (4, a), (4, a), (9, b), (9, b + "tail"), (None, b)]
    got = D.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = sorted((str(r.doc_id), len(r.kept)) for r in got)
    nine = [n for k, n in left if k == "9"]
    assert [x for x in left if x[0] == "4"] == [("4", 300)] * 2 and [x for x in left if x[0] == "None"] == [("None", 0)] * 2
    assert sorted(nine) in ([0, 304], [4, 300])  # one of the two stays whole


def test_empty(spark):
    assert D.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(D, "_CHUNK", 500)
    rng = random.Random(1)
    data = [bytes(rng.choices(b"abc", k=n)) for n in (2300, 40, 100, 0, 700)]
    text, first, windows, anchor, context = D.text_runs(data)
    covered = sorted((t, f + i) for t, f, w in zip(text.tolist(), first.tolist(), windows.tolist()) for i in range(w))
    assert covered == [(t, p) for t, d in enumerate(data) for p in range(len(d) - 99)]


def test_suffix_order_and_expansion():
    rng = np.random.default_rng(2)
    for n, values in ((1, 2), (60, 2), (500, 3), (300, 1)):
        text = rng.integers(0, values, n).astype(np.uint16)
        raw = text.tolist()
        assert D.suffix_order(text).tolist() == sorted(range(n), key=lambda i: raw[i:])
        for length in (1, 3, 9):
            at, group = D.equal_windows(text, length)
            mine = {}
            for p, g in zip(at.tolist(), group.tolist()):
                if p + length <= n:
                    mine.setdefault(g, set()).add(p)
            want = {}
            for p in range(n - length + 1):
                want.setdefault(tuple(raw[p:p + length]), set()).add(p)
            assert sorted(map(sorted, (v for v in mine.values() if len(v) > 1))) == sorted(sorted(v) for v in want.values() if len(v) > 1)
