"""Benchmark decontamination by winnowing.

Of every window of consecutive k-gram hashes the least (the last of equal ones) is a fingerprint. Two texts that share a
span of ``window`` words have the same hashes there, hence the same fingerprint within the span: with ``k``-grams and windows
of ``window - k + 1`` hashes no shared span is missed. Fingerprints of the corpus meet those of the benchmark by an equi-join on
hash and words, and each hit is extended word by word to both sides, as far as a window can reach; spans of ``window`` words
or more count. An item of fewer words is one window; its length is a family of its own, in which every gram is kept.

Scale: texts are read once. A bitmap of the benchmark's hashes (16 MB at most) lets a fingerprint out of the task
only if the benchmark may hold it. What passes meets the items by a broadcast join while there are few item
fingerprints (counted first), else by a join salted on the document's side, so that a passage in a third of all
documents is spread. Hits are merged per block of words, so no task holds all hits of a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.common import staged, whole_text
from sitewarden.llm.words import (
    BLOCK_BYTES, SHORT_WORD, Words, alphabet, filter_of, gram_hashes, joined, passes, row_blocks, segments, text_buffer, words_of,
)

WINDOW, GRAM = 10, 5
#: Item fingerprints (of some 500 bytes) up to which they are broadcast, parts of a hot passage beyond it, and words of a block.
BROADCAST_ROWS, SALTS, BLOCK_WORDS = 40_000, 16, 4096
#: Rows of one output batch.
OUT_ROWS = 20_000

#: Words are digits, letters a to z and whatever is not ASCII.
PLAIN_WORDS = alphabet(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) and b != 10))

_CANDIDATE = "family int, hash long, pos long, gram string, before array<string>, after array<string>"


def winnow(hashes: np.ndarray, width: int, whole: np.ndarray) -> np.ndarray:
    """Places of the last least hash of every window of ``width`` hashes that ``whole`` marks as lying in one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = hashes[:n].copy()
    for d in range(1, width):
        np.minimum(least, hashes[d : d + n], out=least)
    chosen, open_ = np.zeros(len(hashes), bool), whole[:n].copy()
    for d in range(width - 1, -1, -1):
        here = open_ & (hashes[d : d + n] == least)
        chosen[d : d + n] |= here
        open_ &= ~here
    return np.flatnonzero(chosen)


def _fingerprints(words: Words, text: np.ndarray, families: list[int], window: int, gram: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``family, k, places, hashes``; ``text`` numbers the text of each word."""
    n = len(text)
    for family in families:
        k = min(family, gram) if family == window else family
        hashes = gram_hashes(words.hashes, k, family)
        if family == window:
            whole = text[: max(0, n - window + 1)] == text[window - 1 :]
            places = winnow(hashes, window - k + 1, whole)
        else:
            places = np.flatnonzero(text[: len(hashes)] == text[k - 1 :]) if len(hashes) else np.empty(0, np.int64)
        yield family, k, places, hashes[places]


def _shown(word: bytes) -> str:
    """The word itself, or 256 bits in place of a very long one."""
    return word.decode("utf-8", "replace") if len(word) <= SHORT_WORD else "\x01" + hashlib.blake2b(word, digest_size=32).hexdigest()


def _candidates(words: Words, text: np.ndarray, first: np.ndarray, families: list[int], window: int, gram: int, bits: np.ndarray | None):
    """``text, family, hash, word number, gram, before, after`` of fingerprints; ``first`` is the number of each word in its text."""
    n = len(text)
    for family, k, places, hashes in _fingerprints(words, text, families, window, gram):
        if bits is not None:
            wanted = passes(bits, hashes)
            places, hashes = places[wanted], hashes[wanted]
        reach = window - k if family == window else 0
        for p, h in zip(places.tolist(), hashes.view(np.int64).tolist()):
            low, high = p, p + k
            while low > 0 and p - low < reach and text[low - 1] == text[p]:
                low -= 1
            while high < n and high - p - k < reach and text[high] == text[p]:
                high += 1
            shown = [_shown(words.slice(i, i)) for i in range(low, high)]
            yield int(text[p]), family, h, int(first[p]), " ".join(shown[p - low : p - low + k]), shown[: p - low][::-1], shown[p - low + k :]


def _read(texts: DataFrame, families: list[int] | None, window: int, gram: int, bits: np.ndarray | None, block: int) -> DataFrame:
    """Per text a row ``row, id, n_words`` (``family`` null), and a row for each fingerprint that passes ``bits``.

    ``families`` None: those of the text's own length (for items).
    """
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, n_words long, {_CANDIDATE}"
    shared = None if bits is None else texts.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if shared is None else np.frombuffer(shared.value, np.uint8)
        key = TaskContext.get().partitionId() << 40
        layout = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, layout)], schema=layout)

        for batch in batches:
            layout = layout or pa.schema([
                ("row", pa.int64()), ("id", batch.schema.field("id").type), ("n_words", pa.int64()), ("family", pa.int32()), ("hash", pa.int64()),
                ("pos", pa.int64()), ("gram", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])
            ids = batch.column("id").to_pylist()
            data, bounds = text_buffer(batch.column("text"))
            rows: list[tuple] = []
            for a, b in row_blocks(bounds, block):
                found: Iterator
                if b == a + 1 and bounds[b] - bounds[a] > block:
                    counted = 0
                    for words, lead, more in segments(data[bounds[a] : bounds[b]], PLAIN_WORDS, window - 1, block):
                        n = len(words.raw)
                        place = np.arange(counted - lead, counted - lead + n)
                        of = families or [window if lead or more else min(window, n)] * (n > 0)
                        for x in _candidates(words, np.zeros(n, np.int64), place, of, window, gram, own):
                            rows.append((key + a, ids[a], None) + x[1:])
                            if len(rows) >= OUT_ROWS:
                                yield out(rows)
                                rows = []
                        counted += n - lead
                    rows.append((key + a, ids[a], counted) + (None,) * 6)
                    continue
                raw, begins = joined(data, bounds, a, b)
                words = words_of(raw, PLAIN_WORDS)
                text = np.searchsorted(begins, words.raw, "right") - 1
                counts = np.bincount(text, minlength=b - a) if len(text) else np.zeros(b - a, np.int64)
                place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
                if families is None:  # items: each in the family of its own length
                    sizes = {min(window, int(c)) for c in counts if c}
                    found = (x for f in sorted(sizes) for x in _candidates(words, text, place, [f], window, gram, own)
                             if min(window, int(counts[x[0]])) == f)
                else:
                    found = _candidates(words, text, place, families, window, gram, own)
                for x in found:
                    rows.append((key + a + x[0], ids[a + x[0]], None) + x[1:])
                    if len(rows) >= OUT_ROWS:
                        yield out(rows)
                        rows = []
                rows += [(key + a + i, ids[a + i], int(c)) + (None,) * 6 for i, c in enumerate(counts)]
                if len(rows) >= OUT_ROWS:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)
            key += len(ids)

    return texts.mapInArrow(run, schema)


def _common(a: str, b: str) -> F.Column:
    """How many leading elements two arrays share."""
    return F.expr(f"aggregate(sequence(1, greatest(1, least(size({a}), size({b})))), 0, (n, i) -> if(n = i - 1 and get({a}, n) = get({b}, n), n + 1, n))")


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS,
               block: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: ``row`` (unique), id, ``n_words``, ``spans`` and ``items``.

    ``spans`` are ``from, to`` in words, the end excluded, in order, merged (and cut at every 4 096th word); ``items`` the distinct
    ids of the items that have a window in the text, unordered. Null and empty texts have no words, and rows that repeat are
    judged each for itself. Rows of ``items`` with one id are one item with the windows of all; an item without id marks words but
    is not listed, one without words takes no part. Either table may be empty; other columns play no part.
    """
    if not 1 <= gram <= window:
        raise ValueError("a gram has 1 to window words")
    asked = staged(_read(items.select(F.col(item_col).alias("id"), whole_text(item_text).alias("text")), None, window, gram, None, block))
    prints = asked.where("family is not null").groupBy("family", "hash", "gram", "before", "after").agg(
        F.collect_set("id").alias("items"))
    prints = staged(prints)
    families = sorted(r.family for r in prints.select("family").distinct().collect())  # at most ``window`` values
    bits = filter_of(prints.select("hash").distinct())
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    read = staged(_read(texts, families or [window], window, gram, bits, block))
    few = prints.count() <= broadcast_rows
    hits = read.where("family is not null").select("row", "pos", F.col("family").alias("f"), F.col("hash").alias("h"), F.col("gram").alias("g"),
                                                   F.col("before").alias("b"), F.col("after").alias("a"))
    same = (F.col("family") == F.col("f")) & (F.col("hash") == F.col("h")) & (F.col("gram") == F.col("g"))
    if few:
        met = hits.join(F.broadcast(prints), same)
    else:
        salted = prints.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = hits.withColumn("_s", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_s") == F.col("salt")))
    left, right = _common("before", "b"), _common("after", "a")
    k = F.when(F.col("family") == window, F.lit(min(gram, window))).otherwise(F.col("family"))
    met = staged(
        met.select("row", "pos", "family", left.alias("left"), right.alias("right"), k.alias("k"), "items")
        .where("left + right + k >= family")
        .select("row", (F.col("pos") - F.col("left")).alias("from"), (F.col("pos") + F.col("k") + F.col("right")).alias("to"), "items"))
    size = F.lit(BLOCK_WORDS)
    cut = met.select("row", "from", "to").distinct().select(
        "row", "from", "to", F.explode(F.expr(f"sequence(from div {BLOCK_WORDS}, (to - 1) div {BLOCK_WORDS})")).alias("block"))
    cut = cut.select("row", "block", F.greatest("from", F.col("block") * size).alias("from"), F.least("to", (F.col("block") + 1) * size).alias("to"))
    merged = cut.groupBy("row", "block").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("s")).select("row", "block", F.expr(
        "aggregate(s, cast(array() as array<struct<from: bigint, to: bigint>>), (acc, x) -> "
        "if(size(acc) > 0 and element_at(acc, -1).to >= x.from, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('from', element_at(acc, -1).from, 'to', greatest(element_at(acc, -1).to, x.to)))), "
        "concat(acc, array(x))))").alias("s"))
    spans = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("block", "s"))).alias("parts")).select(
        F.col("row").alias("_row"), F.flatten(F.transform("parts", lambda p: p["s"])).alias("spans"))
    named = met.select("row", F.explode("items").alias("item")).distinct().groupBy(F.col("row").alias("_named")).agg(
        F.collect_list("item").alias("items"))
    base = read.where("family is null").select("row", F.col("id").alias(id_col), "n_words")
    kind = items.schema[item_col].dataType.simpleString()
    return (
        base.join(spans, F.col("row") == F.col("_row"), "left").join(named, F.col("row") == F.col("_named"), "left")
        .select("row", id_col, "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<from: bigint, to: bigint>>)")).alias("spans"),
                F.coalesce("items", F.expr(f"cast(array() as array<{kind}>)")).alias("items"))
    )
