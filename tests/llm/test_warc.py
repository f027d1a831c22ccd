"""Archives: rows against a dictionary, byte-identical files on every run, damage and leftovers."""

import gzip
import hashlib
import pathlib

import pytest

from sitewarden.llm import warc

BIG = "<p>é same page</p>" * 20
ROWS = [(5, "http://a/5", BIG), (2, "http://a/2 x\r\ny", BIG), (9, None, BIG), (1, "u", None), (3, "u", ""), (4, "u", "x" * 99), (6, "u", "x" * 99),
        (7, "u", "y" * 100), (8, "u", "y" * 100), (8, "u", "y" * 100), (None, "u", BIG), (10, "u", "\r\n\r\n" * 60), (11, "u", "z" * 500_000),
        (7, "other", "w" * 200)] + [(100 + i, f"h{i}", f"<b>{i}</b>" * (i % 40)) for i in range(300)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, shard int")


def want():
    out = []
    for i, _, h in ROWS:
        data = (h or "").encode()
        ids = [k for k, _, x in ROWS if x == h and k is not None]
        first = min(ids) if ids and len(data) >= 100 else None
        refers = first if i is not None and first is not None and i > first else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes,file_bytes", [(1 << 30, 1 << 30), (20_000, 3_000)])
def test_round_trip(spark, shard_bytes, file_bytes):
    got = warc.archive_round_trip(frame(spark), shard_bytes=shard_bytes, file_bytes=file_bytes)
    rows = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in rows), key=str) == want()


def test_same_files_each_time(spark, tmp_path):
    seen = []
    for k, parts in enumerate((1, 5)):
        folder = tmp_path / f"w{k}"
        manifest = warc.write_archives(frame(spark).repartition(parts), f"file://{folder}", shard_bytes=30_000, file_bytes=2_000)
        files = {p.name: p.read_bytes() for p in folder.glob("*.warc.gz")}
        assert len(files) > 3 and not (folder / "_temporary").exists()
        for r in manifest.collect():
            data = files[pathlib.Path(r.final).name]
            assert (r.bytes, r.sha256) == (len(data), hashlib.sha256(data).hexdigest())
            assert gzip.decompress(data).count(b"WARC/1.1\r\n") == r.records + 1
        seen.append(files)
        warc.commit(manifest, f"file://{folder}")  # may be repeated
    assert seen[0] == seen[1]


def test_one_id_and_no_id_are_spread(spark, tmp_path):
    rows = [(None, "u", f"<p>{i}</p>" * 40) for i in range(200)] + [(5, "u", f"<b>{i}</b>" * 40) for i in range(200)] + [(6, "u", "<b>7</b>" * 40)]
    manifest = warc.write_archives(frame(spark, rows), f"file://{tmp_path}/w", shard_bytes=8_000, file_bytes=1 << 20).collect()
    assert len(manifest) > 8 and max(r.records for r in manifest) < 100
    back = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert len(back) == 401 and [(r.page_id, r.refers_to) for r in back if r.record_type == "revisit"] == [(6, 5)]


def test_damage_is_found():
    data = warc.record(1, "u", b"payload", None)
    assert warc.parsed(data)[:1] == (1,)
    with pytest.raises(ValueError):
        warc.parsed(data.replace(b"payload", b"paylord"))
    with pytest.raises(ValueError):
        list(warc.members(warc.compressed(data)[:-4]))


def test_empty(spark):
    assert warc.archive_round_trip(frame(spark, [])).collect() == []
