"""Repeated byte strings of a least length, with Burrows-Wheeler interval expansion.

Every byte covered by a string of ``length`` bytes that also starts earlier (in a smaller id, or earlier in the same text) goes.

1. *Anchors.* Of the ``k``-byte strings inside a window of ``length`` bytes the one with the least hash is the window's anchor, so
   equal windows have equal anchors. Consecutive windows with the same anchor are one run, the bytes under them its context.
   Anchors that occur once in the corpus are done with.
2. *Classes.* Runs of equal anchor and equal context are one class; every member but the first is a repeat as a whole.
3. *Expansion.* Anchors with several classes have their first members' contexts gathered in shards. In a shard, suffixes are sorted,
   and a breadth-first backward extension on the Burrows-Wheeler transform marks, for growing n, where neighbouring
   suffixes differ within n bytes; rows alone in their interval drop out, and at ``length`` it stops. What is still
   together are equal windows, and all but the earliest are repeats. An anchor with very many contexts would not fit a shard: its
   windows are compared by hash in an aggregation instead.
4. Repeats are merged per document and cut out.

Scale: texts are scanned in parallel; only anchors (about one in 40 bytes) are shuffled, texts twice, compressed. Hot anchors are
pre-aggregated or the repeated side of a join that may be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.common import staged, whole_text

LENGTH, ANCHOR = 100, 24
#: Contexts of one anchor beyond which they are compared by hash; bytes of contexts in one shard.
HOT_CONTEXTS, SHARD_BYTES = 20_000, 1 << 20
_CHUNK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)

# --- anchors --------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, powers of an odd number modulo 2^64, and their inverses."""
    values = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    up, down = np.full(n, _ODD), np.full(n, inverse)
    up[0] = down[0] = 1
    return values, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Hashes:
    """Hashes of any substring of ``data`` in constant time, modulo 2^64 over random byte values."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(20, int(len(data) + 1).bit_length())
        values, self.up, self.down = _tables(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * self.up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def of(self, begin, end) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin])

    def rolling(self, k: int) -> np.ndarray:
        return _mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def runs(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of the texts concatenated in ``data`` (``ends``: where each stops): text, first window, windows, anchor, context.

    First windows count from the start of their text. Windows do not cross texts.
    """
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    if len(data) < length:
        return none
    hashes = Hashes(data)
    grams = hashes.rolling(k)
    place = np.arange(len(grams), dtype=np.uint64)
    low = _sliding_min((grams & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - place), length - k + 1)
    anchor = np.uint64(0xFFFFFF) - (low & np.uint64(0xFFFFFF))
    text = np.searchsorted(ends, np.arange(len(low)), side="right")
    inside = np.flatnonzero(np.arange(length, length + len(low)) <= ends[text])
    if not len(inside):
        return none
    text, anchor = text[inside], anchor[inside]
    cut = np.flatnonzero((text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])) + 1
    first = np.r_[0, cut]
    last = np.r_[cut, len(inside)] - 1
    begin, end, at = inside[first], inside[last] + length, anchor[first].astype(np.int64)
    shape = (at - begin).astype(np.uint64) << np.uint64(32) | (end - begin).astype(np.uint64)
    context = _mix(hashes.of(begin, end) + shape * _ODD)
    start = np.r_[0, ends[:-1]][text[first]]
    return text[first], begin - start, last - first + 1, grams[at].view(np.int64), context.view(np.int64)


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``data, ends, text, offset``: the texts in chunks of a bounded size; parts of a long text overlap by ``length - 1`` bytes."""
    parts, size = [], 0
    for t, raw in enumerate(texts):
        for at in range(0, max(1, len(raw) - length + 1), _CHUNK):
            parts.append((t, at, raw[at : at + _CHUNK + length - 1]))
            size += len(parts[-1][2])
            if size >= _CHUNK:
                yield _joined(parts)
                parts, size = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    return data, np.cumsum([len(p[2]) for p in parts]), np.array([p[0] for p in parts]), np.array([p[1] for p in parts])


def text_runs(texts: list[bytes], length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """``runs`` of whole texts. A run may be split where a long text was: each part is a run of its own."""
    found = []
    for data, ends, number, offset in _chunks(texts, length):
        text, first, count, anchor, context = runs(data, ends, length, k)
        found.append((number[text], first + offset[text], count, anchor, context))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.empty(0, np.int64) for _ in range(5))


# --- Burrows-Wheeler transform of a shard ---------------------------------------------------------------------------


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of ``text`` (values below 512), by prefix doubling from seven values packed into one number."""
    n = len(text)
    padded = np.r_[text.astype(np.int64) + 1, np.zeros(7, np.int64)]
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = (key << 9) | padded[i : i + n]
    order = np.argsort(key)
    ordered = key[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]][:n]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))  # a suffix ranks where its equals begin
    step = 7
    slots = slots[~(new & np.r_[new[1:], True][:n])]
    while len(slots):  # only suffixes that still tie are sorted again, within their places
        tied = order[slots]
        after = tied + step
        key = rank[tied] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        order[slots] = tied
        new = np.r_[True, key[1:] != key[:-1]]
        rank[tied] = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        slots = slots[~(new & np.r_[new[1:], True])]
        step *= 2
    return order


def equal_windows(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next ``length`` values also follow another position, and a number for each set of equal ones.

    Breadth-first backward extension: F marks the rows of the suffix array that differ from the row above within n
    values. Rows with the same preceding value keep their order when it is put in front, so two of them differ within n + 1 values
    exactly if F has a mark between the rows they come from.
    """
    text = np.r_[text.astype(np.int32) + 1, 0]  # an end that is unlike all values
    order = suffix_order(text)
    before = text[order - 1]  # the transform
    source = np.argsort(before.astype(np.uint16), kind="stable")  # row of the suffix that each row extends
    column = before[source]
    mark = np.r_[True, column[1:] != column[:-1]]
    rows, lost = np.arange(len(order)), np.empty(0, np.int64)
    for n in range(1, length):
        if n in (2, 4, 8, 12, 16, 24, 32, 48, 64, 80):  # rows alone in their interval stay alone
            together = np.flatnonzero(~mark | ~np.r_[mark[1:], True])
            renumber = np.full(len(mark), -1)
            renumber[together] = np.arange(len(together))
            mark, rows, source = mark[together], rows[together], renumber[source[together]]
            lost = np.flatnonzero(source < 0)  # they extend a row that is alone, so from the next level on they are too
            source[lost] = 0
        if not len(rows):
            break
        seen = np.cumsum(mark, dtype=np.int32)[source]
        mark[1:] |= seen[1:] != seen[:-1]
        mark[0] = mark[lost] = True
        mark[lost[lost + 1 < len(mark)] + 1] = True
    together = ~mark | ~np.r_[mark[1:], True] if len(rows) else np.empty(0, bool)
    return order[rows[together]], np.cumsum(mark)[together]


def repeated_windows(contexts: list[bytes], number: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """``number, window`` of every window of the contexts that also occurs earlier among them.

    ``number``, ``start``: document and place of each context. Windows given twice at one place are one.
    """
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + 1
    text = np.insert(data, np.cumsum(sizes), 0)  # a mark below all bytes ends each context
    begins = np.cumsum(sizes + 1) - sizes - 1
    at, group = equal_windows(text, length)
    owner = np.searchsorted(begins, at, side="right") - 1
    offset = at - begins[owner]
    inside = offset + length <= sizes[owner]
    owner, offset, group = owner[inside], offset[inside], group[inside]
    doc, place = number[owner], start[owner] + offset
    by = np.lexsort((place, doc, group))
    doc, place, group = doc[by], place[by], group[by]
    new = np.r_[True, group[1:] != group[:-1]][: len(group)]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(group) else new.astype(int)
    later = (doc != doc[lead]) | (place != place[lead])
    return doc[later], place[later]


def _ranges(doc: np.ndarray, window: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, from, to``: merged byte ranges of single windows."""
    by = np.lexsort((window, doc))
    doc, window = doc[by], window[by]
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (window[1:] > window[:-1] + length)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(doc)] - 1
    return (doc[first], window[first], window[last] + length) if len(doc) else (doc, window, window)


# --- frames ---------------------------------------------------------------------------------------------------------


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``number, id, text``: numbers in the order of ids, null last; rows of one id follow the hash of their texts.

    The id itself serves where it is unique. Otherwise distinct rows are sorted and counted; equal rows share a number.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    repeated = rows.groupBy("id").count().where(F.col("id").isNull() | (F.col("count") > 1))
    if repeated.isEmpty():
        return rows.select(F.col("id").alias("number"), "id", "text")
    keyed = rows.withColumn("key", F.xxhash64("text"))
    places = keyed.select("id", "key").distinct().orderBy(F.col("id").asc_nulls_last(), "key").rdd.zipWithIndex()
    numbers = staged(places.map(lambda x: (x[0][0], x[0][1], x[1])).toDF("id long, key long, number long"))
    same = keyed["id"].eqNullSafe(numbers["id"]) & (keyed["key"] == numbers["key"])
    return keyed.join(numbers, same).select("number", keyed["id"], "text")


def _occurrences(texts: DataFrame, length: int, k: int) -> DataFrame:
    """``number, first, windows, anchor, context`` of every run."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            text, first, windows, anchor, context = text_runs(raw, length, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[text].astype(np.int64)), pa.array(first), pa.array(windows), pa.array(anchor), pa.array(context)],
                names=["number", "first", "windows", "anchor", "context"])

    return texts.select("number", "text").mapInArrow(scan, "number long, first long, windows long, anchor long, context long")


def _packed(texts: DataFrame) -> DataFrame:
    """``number, id, packed``: texts compressed for the shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw = batch.column(2).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([zip_.compress(r) for r in raw], pa.binary())],
                                             names=["number", "id", "packed"])

    return texts.select("number", "id", "text").mapInArrow(pack, "number long, id long, packed binary")


def repeats(docs: DataFrame, texts: DataFrame, length: int, k: int, hot: int) -> DataFrame:
    """``number, from, to``: byte ranges that earlier strings of ``length`` bytes cover."""
    spark = docs.sparkSession
    often = _occurrences(texts, length, k).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = staged(often.select(F.col("anchor").alias("a")))
    shared = staged(_occurrences(texts, length, k).join(often, F.col("anchor") == F.col("a")).drop("a"))

    place = F.min(F.struct("number", "first", "windows")).alias("lead")
    classes = staged(shared.groupBy("anchor", "context").agg(place, F.count(F.lit(1)).alias("n")))
    leads = classes.where("n > 1").select(
        F.col("anchor").alias("a"), F.col("context").alias("c"), F.col("lead.number").alias("n"), F.col("lead.first").alias("f"))
    copied = shared.join(leads, (F.col("anchor") == F.col("a")) & (F.col("context") == F.col("c")))
    copied = copied.where((F.col("number") != F.col("n")) | (F.col("first") != F.col("f"))).select(
        "number", F.col("first").alias("from"), (F.col("first") + F.col("windows") + length - 1).alias("to"))

    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1").select(F.col("anchor").alias("a"), "contexts")
    firsts = classes.join(several, F.col("anchor") == F.col("a")).select("anchor", "contexts", "lead.*")
    total = firsts.agg(F.sum(F.col("windows") + length - 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    wanted = firsts.groupBy("number").agg(F.collect_list(F.struct("anchor", "contexts", "first", "windows")).alias("runs"))
    wanted = wanted.select("number", *[F.col(f"runs.{c}").alias(f"{c}_of") for c in ("anchor", "contexts", "first", "windows")])
    met = wanted.join(_packed(texts).select(F.col("number").alias("n"), "packed"), F.col("number") == F.col("n"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for number, packed, *found in zip(*(batch[c] for c in ("number", "packed", "anchor_of", "contexts_of", "first_of", "windows_of"))):
                raw = unzip.decompress(packed)
                out += [(a, c, number, f, raw[f : f + w + length - 1]) for a, c, f, w in zip(*found)]
            yield pd.DataFrame(out, columns=["anchor", "contexts", "number", "first", "bytes"])

    contexts = staged(met.drop("n").mapInPandas(cut, "anchor long, contexts long, number long, first long, bytes binary"))
    few = contexts.where(F.col("contexts") <= hot).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    ranges = "number long, from long, to long"

    def expand(rows: pd.DataFrame) -> pd.DataFrame:
        doc, window = repeated_windows([bytes(b) for b in rows["bytes"]], rows["number"].to_numpy(), rows["first"].to_numpy(), length)
        return pd.DataFrame(dict(zip(("number", "from", "to"), _ranges(doc, window, length))))

    expanded = few.groupBy("shard").applyInPandas(expand, ranges)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [bytes(b) for b in batch["bytes"]]
            sizes = np.array([len(r) for r in raw])
            if not len(raw):
                continue
            hashes = Hashes(np.frombuffer(b"".join(raw), np.uint8))
            count = sizes - length + 1
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(np.cumsum(sizes) - sizes, count) + offset
            yield pd.DataFrame({
                "anchor": np.repeat(batch["anchor"].to_numpy(), count), "window": hashes.of(at, at + length).view(np.int64),
                "number": np.repeat(batch["number"].to_numpy(), count), "first": np.repeat(batch["first"].to_numpy(), count) + offset,
            })

    each = contexts.where(F.col("contexts") > hot).select("anchor", "bytes", "number", "first").mapInPandas(
        windows, "anchor long, window long, number long, first long")
    lead = each.groupBy("anchor", "window").agg(F.min(F.struct("number", "first")).alias("l"), F.count(F.lit(1)).alias("n")).where("n > 1")
    lead = lead.select(F.col("anchor").alias("a"), F.col("window").alias("w"), "l")
    later = each.join(lead, (F.col("anchor") == F.col("a")) & (F.col("window") == F.col("w"))).where(F.struct("number", "first") > F.col("l"))
    hashed = later.select("number", F.col("first").alias("from"), (F.col("first") + length).alias("to"))
    return copied.unionByName(expanded).unionByName(hashed)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = ANCHOR,
                   hot: int = HOT_CONTEXTS) -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes``, ``spans`` (merged removed ranges, from and to), ``kept`` bytes.

    Strings are judged on the input; ranges that touch are one span. Null text is empty; texts shorter than ``length`` stay
    whole. Ids order the texts, null last; rows of one id and different texts are different documents in the order of their
    texts' hashes, rows of one id and text are one document. An empty table gives no rows.
    """
    texts = numbered(docs, id_col, text_col)
    found = repeats(docs, texts, length, k, hot)
    per_text = found.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("ranges"))
    per_text = per_text.select(F.col("number").alias("n"), F.col("ranges.from").alias("begins"), F.col("ranges.to").alias("ends"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for key, packed, begins, ends in zip(batch["id"].astype("Int64"), batch["packed"], batch["begins"], batch["ends"]):
                raw, spans = unzip.decompress(packed), []
                for a, b in zip(begins.tolist(), ends.tolist()) if begins is not None else ():
                    if spans and a <= spans[-1]["to"]:
                        spans[-1]["to"] = max(b, spans[-1]["to"])
                    else:
                        spans.append({"from": a, "to": b})
                edges = [0, *(x for s in spans for x in (s["from"], s["to"])), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((key, len(raw), spans, kept))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "spans", "kept"]).astype({"id": "Int64"})

    met = _packed(texts).join(per_text, F.col("number") == F.col("n"), "left").select("id", "packed", "begins", "ends")
    return met.mapInPandas(cut, "id long, n_bytes long, spans array<struct<from:long,to:long>>, kept binary").withColumnRenamed("id", id_col)
