"""Web archives: a deterministic sharded writer and its reader.

Records are sorted by id in ranges of about equal volume. Range limits come from a hash-chosen subset of the ids, so they
depend on the data alone, and identifiers, dates and compression are fixed too: the same table gives the same files, byte
for byte, however often tasks run. A task writes files under temporary names, rolled by compressed size, and returns one
manifest row for each; only rows of the attempt Spark accepts survive, and only their files are renamed. The text is
shuffled once: revisits travel as marker rows that sort just before their page.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarden.llm.common import staged, staged_folder

LEAST_SHARED = 100
SHARD_BYTES = 16 << 20
FILE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
SAMPLED = 1 << 16
#: A row without an id sorts first.
_NO_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "shard int, number int, temporary string, final string, records long, bytes long, sha256 string"
_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"

# --- records --------------------------------------------------------------------------------------------------------


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _lines(first: str, headers: dict[str, object]) -> bytes:
    return "".join([first + "\r\n", *(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None), "\r\n"]).encode()


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with the payload, or a revisit of ``refers_to`` without it. The digests are computed here."""
    digest = hashlib.sha256(payload).hexdigest()
    head = _lines("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload)})
    block = head if refers_to is not None else head + payload
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": _uri(url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Refers-To": None if refers_to is None else record_id(refers_to, digest),
        "X-Page-Id": page_id,
        "X-Refers-To-Page-Id": refers_to,
        "X-Payload-Length": len(payload),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    return _lines("WARC/1.1", headers) + block + b"\r\n\r\n"


def compressed(data: bytes, level: int = 6) -> bytes:
    """One gzip member without a time stamp."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def members(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of an archive, one at a time."""
    view, at = memoryview(content), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            chunk = view[at : at + step]
            if not len(chunk):
                raise ValueError("archive ends within a record")
            parts.append(unpack.decompress(chunk))
            at += len(chunk) - len(unpack.unused_data)
        yield b"".join(parts)


def parsed(data: bytes) -> tuple | None:
    """The row of a record, with length and digest taken from the payload where there is one; null for other types."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = headers["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(headers["Content-Length"])]
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    digest, length = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        digest, length = hashlib.sha256(payload).hexdigest(), len(payload)
    number = lambda k: int(headers[k]) if k in headers else None
    return number("X-Page-Id"), headers["WARC-Target-URI"], kind, length, digest, number("X-Refers-To-Page-Id")


# --- writer ---------------------------------------------------------------------------------------------------------


class _Files:
    """The archive files of one task, rolled by compressed size; ``done`` collects their manifest rows."""

    def __init__(self, folder: str, file_bytes: int):
        from pyarrow import fs

        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.file_bytes, self.attempt = file_bytes, uuid.uuid4().hex
        self.store.create_dir(f"{self.path}/_temporary", recursive=True)
        self.done: list[tuple] = []
        self.shard: int | None = None
        self.out: BinaryIO | None = None

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        elif self.out is not None and self.size >= self.file_bytes:
            self.close()
            self.number += 1
        if self.out is None:
            name = f"part-{shard:06d}-{self.number:06d}.warc.gz"
            self.temporary, self.final = f"{self.path}/_temporary/{self.attempt}-{name}", f"{self.path}/{name}"
            self.out, self.size, self.records, self.hash = self.store.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            info = b"software: sitewarden\r\nformat: WARC File Format 1.1\r\n"
            self._write(compressed(_lines("WARC/1.1", {
                "WARC-Type": "warcinfo", "WARC-Record-ID": record_id(None, name), "WARC-Date": DATE, "WARC-Filename": name,
                "Content-Type": "application/warc-fields", "Content-Length": len(info)}) + info + b"\r\n\r\n"))
        self._write(compressed(data))
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.number, self.temporary, self.final, self.records, self.size, self.hash.hexdigest()))
            self.out = None


def _id():
    return F.coalesce("page_id", F.lit(_NO_ID).cast("long"))


def _range_limits(seen: DataFrame, shards: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of id and digest hash that part the table into ranges of about equal numbers; some ``SAMPLED`` pairs are looked at, however large it is."""
    if shards < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = seen.select(_id().alias("i"), F.xxhash64("digest").alias("h"))
    some = pairs.where(F.pmod(F.xxhash64("i", "h"), F.lit(max(1, rows // SAMPLED))) == 0).distinct()
    found = sorted((r.i, r.h) for r in some.collect())
    chosen = sorted({found[len(found) * k // shards] for k in range(1, shards)}) if found else []
    return np.array([i for i, _ in chosen], np.int64), np.array([h for _, h in chosen], np.int64)


def shard_of(ids: np.ndarray, hashes: np.ndarray, limits: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The range of each pair: the limits at or below it."""
    low, high = np.searchsorted(limits[0], ids, "left"), np.searchsorted(limits[0], ids, "right")
    for a in np.unique(low[low < high]).tolist():  # ids that several ranges share
        here = np.flatnonzero((low == a) & (high > low))
        b = int(high[here[0]])
        low[here] = a + np.searchsorted(limits[1][a:b], hashes[here], "right")
    return low


def revisits(seen: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``page_id, digest, refers_to`` of every record that repeats an earlier payload of at least ``least`` bytes."""
    shared = seen.where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    first = shared.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return shared.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` to ``folder`` and return the manifest, one row per file.

    ``folder`` is new and in storage all executors share. Null html is an empty payload, null url is about:blank. Of equal payloads of at
    least 100 bytes the row with the smallest id is the response and those with larger ids revisit it; rows that repeat id
    and payload are alike; a row without id is always a response. An empty table gives no file. The manifest is also
    written to ``folder/_manifest`` once all files have their final names.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("payload"),
    )
    seen = staged(rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes")))
    total, count = seen.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    shards = max(1, -(-(total or 0) // shard_bytes))
    limits = pages.sparkSession.sparkContext.broadcast(_range_limits(seen, shards, count))

    @F.pandas_udf("int")
    def shard(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(shard_of(ids.to_numpy(np.int64), hashes.to_numpy(np.int64), limits.value).astype(np.int32))

    marks = revisits(seen).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to")
    both = marks.unionByName(rows.withColumns({"digest": F.sha2("payload", 256), "refers_to": F.lit(None).cast("long")}))
    # Ranges of (id, digest): a mark lies with the page it is for, and rows without id, or with one id, are spread by what they hold.
    dealt = both.withColumn("shard", shard(_id(), F.xxhash64("digest"))).withColumn("page", F.col("payload").isNotNull())
    dealt = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "page_id", "digest", "page", "url")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, of, known = _Files(folder, file_bytes), None, {}
        for batch in batches:
            for page_id, url, payload, digest, refers_to, number, page in zip(
                batch["page_id"].astype("Int64"), batch["url"], batch["payload"], batch["digest"], batch["refers_to"].astype("Int64"), batch["shard"], batch["page"]
            ):
                page_id = None if page_id is pd.NA else int(page_id)
                if page_id != of:
                    of, known = page_id, {}
                if not page:
                    known[digest] = int(refers_to)
                else:
                    files.add(number, record(page_id, url, bytes(payload), known.get(digest)))
        files.close()
        yield pd.DataFrame(files.done, columns=[f.split()[0] for f in _MANIFEST.split(", ")])

    manifest = staged(dealt.select("page_id", "url", "payload", "digest", "refers_to", "shard", "page").mapInPandas(write, _MANIFEST))
    commit(manifest, folder)
    return manifest


def commit(manifest: DataFrame, folder: str) -> None:
    """Give the accepted files their final names, write the manifest, drop what other attempts left. May be repeated."""

    def rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for a, b in zip(batch["temporary"], batch["final"]):
                if store.get_file_info(a).type != fs.FileType.NotFound:
                    store.move(a, b)
                elif store.get_file_info(b).type == fs.FileType.NotFound:
                    raise FileNotFoundError(a)
            yield batch[["final"]]

    done = manifest.select("temporary", "final").mapInPandas(rename, "final string").count()
    if done != manifest.count():
        raise ValueError("files are missing")
    manifest.drop("temporary").write.mode("overwrite").parquet(f"{folder}/_manifest")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{path}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{path}/_temporary")


# --- reader ---------------------------------------------------------------------------------------------------------


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per response or revisit record of the archives in ``folder``; digests are checked on the way."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = [r for m in members(content) if (r := parsed(m)) is not None]
                out = pd.DataFrame(rows, columns=[f.split()[0] for f in _RECORD.split(", ")])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("content").mapInPandas(parse, _RECORD)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new folder below the shared one and read the archives back."""
    spark = pages.sparkSession
    folder = staged_folder(spark, "warc")
    if write_archives(pages, folder, **options).isEmpty():
        return spark.createDataFrame([], _RECORD)
    return read_archives(spark, folder)
