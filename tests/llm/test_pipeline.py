"""The pipeline stage by stage against plain versions, on the smallest sample with odd rows added."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sitewarden.llm.common import staged
from tests.llm.test_secret_scan import plain as plain_spans
from tests.llm.test_simhash import plain_components

FOLDER = "/root/testdata/sf0.001"
EXTRA = [(9001, None, "en"), (9002, "", "en"), (9003, "123 456", None), (9004, "token = 'abcdef123456789' and the rest of the thing", "en")]


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


@pytest.fixture(scope="module")
def stages(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()]
    rows += [(i, t, lang, "src0", len(t or "")) for i, t, lang in EXTRA] + [(9500 + i, rows[i][1].swapcase() if rows[i][1].isascii() else rows[i][1], "en", None, 1) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [("documents", docs, {r[0]: r for r in rows})]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, FOLDER))
        out.append((name, docs, None if name == "pack" else {r.doc_id: tuple(r) for r in docs.collect()}))
    return out


def test_names_and_columns(stages):
    assert [s[0] for s in stages[1:]] == ["language_id", "exact_dedup", "simhash", "secret_scan", "pack"]
    assert all(s[1].columns == stages[0][1].columns for s in stages[:-1])


def test_language_stage_rejects_what_has_no_letter(stages):
    gone = set(stages[0][2]) - set(stages[1][2])
    assert {9001, 9002, 9003} <= gone and len(gone) <= 5
    assert all(stages[0][2][k] == v for k, v in stages[1][2].items())


def test_exact_stage(stages):
    best = defaultdict(int)
    for k, r in stages[1][2].items():
        best[low(r[1])] = max(best[low(r[1])], k)
    assert {k: r for k, r in stages[1][2].items() if best[low(r[1])] == k} == stages[2][2]


def test_near_stage(stages):
    kept = {k for k, _, c in plain_components([(k, r[1]) for k, r in stages[2][2].items()]) if k == c}
    assert {k: r for k, r in stages[2][2].items() if k in kept} == stages[3][2]


def test_secret_stage(stages):
    owners = defaultdict(set)
    runs = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
    found = {}
    for k, r in stages[3][2].items():
        spans = [(s, e, re.split(r"[:=]\x20*[\"']?", r[1][s:e], maxsplit=1)[1] if kind == "assign" else r[1][s:e], "base") for s, _, e, kind in plain_spans(r[1])]
        spans += [(m.start(), m.end(), m[0], "run") for m in runs.finditer(r[1]) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])
                  and not any(s < m.end() and m.start() < e for s, e, *_ in spans)]
        found[k] = spans
        for s in spans:
            owners[s[2]].add(r[3])
    for k, r in stages[3][2].items():
        hide = sorted((s, e) for s, e, value, _ in found[k] if len(owners[value]) <= 2)
        text, at = "", 0
        for s, e in hide:
            text += r[1][at:s] + "[SECRET]" if s >= at else ""
            at = max(at, e)
        text += r[1][at:]
        assert stages[4][2][k] == (k, text, r[2], r[3], len(text) if hide else r[4])
    assert stages[4][2][9004][1] == "[SECRET]' and the rest of the thing"


def test_pack_stage(stages):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for k, r in stages[4][2].items():
        ids = lib.encode(r[1], add_special_tokens=False).ids + [0]
        want += [(k, p, a, len(ids[a:a + 2048]), zlib.crc32(np.array(ids[a:a + 2048], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 2048))]
    got = stages[5][1].collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist()
        assert sum(n for _, n in parts) <= 2048
    assert len(fill) <= -(-sum(r.length for r in got) // 2048) + 1


def test_run_and_empty_table(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, FOLDER))
    assert docs.count() == 0
