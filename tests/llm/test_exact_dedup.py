"""Exact duplicates against a dictionary, with forced hash collisions, nulls, copies and clashing column names."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sitewarden.llm.exact_dedup import drop_exact_copies, exact_groups, md5_128

ROWS = [(1, "Abc", "x"), (2, "aBC", None), (3, None, "y"), (4, "", "y"), (5, "É", "z"), (6, "é", "z"), (None, "abc", "q"), (7, "w " * 60000, ""),
        (8, "W " * 60000, ""), (7, "w " * 60000, ""), (None, "alone", None), (9, "ünique", None)]
SCHEMA = "doc_id long, text string, _sha string"


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def plain(rows, pick):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[low(t)].append(i)
    out = []
    for i, t, _ in rows:
        ids = [x for x in groups[low(t)] if x is not None]
        keep = pick(ids) if ids else None
        out.append((i, keep, len(groups[low(t)]), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
@pytest.mark.parametrize("hashed", [md5_128, lambda t: F.lit(b"same")])
def test_groups(spark, keep, pick, hashed):
    got = exact_groups(spark.createDataFrame(ROWS, SCHEMA), keep=keep, content_hash=hashed)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain(ROWS, pick)


def test_drop(spark):
    kept = drop_exact_copies(spark.createDataFrame(ROWS, SCHEMA), keep="largest")
    assert kept.columns == ["doc_id", "text", "_sha"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "5", "6", "8", "9", "None"]


def test_empty(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []
