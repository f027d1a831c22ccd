"""Best-fit packing with certified bin counts.

Items (documents, or pieces of the long ones) are dealt into partitions and packed best-fit decreasing. Dual-feasible
functions bound from below how many bins a partition needs: one that meets its bound, rounded up, is certified and stays as it is, but for
its emptiest bin, which rounding may have cost. Partitions with a gap give the items of all their unfilled bins. What is given away
is dealt anew into fewer partitions and packed again, until the bins of all together meet the bound of all
items, or a round saves nothing. Every sequence carries the bins and the bound of the partition that packed it.

Tokens: blocks of text are cut into words on arrays of code points, each distinct word of a block goes through the tokenizer's model
alone, and ids are gathered by word numbers. Texts with characters beyond the Latin blocks go through it whole.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.common import staged, whole_text
from sitewarden.llm.words import row_blocks, text_buffer

CAPACITY = 2048
END = 0
#: Items of one partition.
PARTITION_ITEMS = 40_000
#: Bytes of text that are cut into words at once, and words that a task remembers (some 50 MB with their ids, freed with the task).
BLOCK_BYTES, KNOWN_WORDS = 1 << 21, 250_000

# --- tokens ---------------------------------------------------------------------------------------------------------

#: Code points that are cut into words here: printable ASCII, tab and line ends, Latin letters to U+024F that stay there in lower case.
_LAST = 0x250
_SPACE, _LETTER, _NUMBER, _OTHER, _OUTSIDE = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind, lower = np.full(_LAST + 1, _OUTSIDE, np.uint8), np.arange(_LAST + 1, dtype=np.uint32)
    for c in [9, 10, 13, *range(32, 127), *range(0xA1, _LAST)]:
        low = chr(c).lower()
        if len(low) == 1 and ord(low) < _LAST:
            lower[c] = ord(low)
            kind[c] = {"L": _LETTER, "N": _NUMBER, "Z": _SPACE, "C": _SPACE if c < 32 else _OTHER}.get(unicodedata.category(low)[0], _OTHER)
    return kind, lower


_KIND, _LOWER = _tables()


def _shown_bytes() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 characters themselves, the others from 256 on in order."""
    plain = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_SHOWN_BYTES = _shown_bytes()
#: What an apostrophe that begins a word takes along.
_CONTRACTIONS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]
_STEPS = np.random.default_rng(20_240_301).integers(1, 1 << 63, 2 * 64, np.uint64) | np.uint64(1)


class WordTokenizer:
    """The ids of a word-level tokenizer file for many texts at once."""

    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.known_words = known_words
        self.known: dict[bytes, bytes] = {}

    def encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of lower-cased words in UTF-8, as little-endian 32-bit numbers; the first ``known_words`` words are remembered."""
        known, tokenize, out = self.known, self.model.tokenize, []
        for w in words:
            ids = known.get(w)
            if ids is None:
                shown = w.decode() if w.isascii() else w.decode("latin-1").translate(_SHOWN_BYTES)
                ids = np.array([t.id for t in tokenize(shown)], "<u4").tobytes()
                if len(known) < self.known_words:
                    known[w] = ids
            out.append(ids)
        return out

    @staticmethod
    def _cut(low: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each word: runs of letters, single numbers, runs of others, apostrophes with what they take along."""
        begins = kind != _SPACE
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        ends = kind != _SPACE
        ends[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] == _NUMBER)
        quotes = np.flatnonzero((low == 39) & begins)
        for tail in _CONTRACTIONS:
            n = len(tail)
            at = quotes[quotes + n < len(low)]
            for j, c in enumerate(tail, 1):
                at = at[low[at + j] == c]
            begins[at + 1] = False
            ends[at] = False
            after = at[at + n + 1 < len(low)] + n + 1
            begins[after[kind[after] == _LETTER]] = True
            ends[at + n] = True
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def encode_rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        bounds = np.cumsum(sizes) - sizes
        clipped = np.minimum(codes, _LAST)
        kind, low = _KIND[clipped], _LOWER[clipped]
        strange = np.flatnonzero(kind == _OUTSIDE)
        special = np.flatnonzero((codes[:-1] == 60) & (codes[1:] == 124))  # the opening of a special token
        apart = np.unique(np.searchsorted(bounds, np.concatenate([strange, special]), "right") - 1)
        for i in apart.tolist():
            kind[bounds[i] : bounds[i] + sizes[i]] = _SPACE
        begins, ends = self._cut(low, kind)
        row = np.searchsorted(bounds, begins, "right") - 1
        ids, counts = self._gather(low, begins, ends)
        per_row = np.bincount(row, counts, len(texts)).astype(np.int64)
        if len(apart):
            parts = np.split(ids, np.cumsum(per_row)[:-1])
            for i in apart.tolist():
                parts[i] = self.encode_whole(texts[i])
                per_row[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, per_row

    def _gather(self, low: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has."""
        n = len(begins)
        if not n:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        lengths = ends - begins
        first = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        letters = low[np.repeat(begins, lengths) + within]
        hashes = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * _STEPS[within % 128] * (within // 128 * 2 + 1).astype(np.uint64), first)
        _, sample, number = np.unique(hashes * np.uint64(0x9E3779B97F4A7C15) ^ hashes >> np.uint64(29), return_index=True, return_inverse=True)
        # Words count as one only if they are equal letter by letter to the one that stands for them.
        alike = lengths == lengths[sample][number]
        cover = np.minimum(first[sample][number], len(letters) - 1)
        same = letters[np.minimum(np.repeat(cover, lengths) + within, len(letters) - 1)] == letters
        alike &= np.logical_and.reduceat(same, first)
        odd = np.flatnonzero(~alike)
        if len(odd):
            sample = np.concatenate([sample, odd])
            number[odd] = np.arange(len(sample) - len(odd), len(sample))
        whole = letters.tobytes().decode("utf-32-le")
        found = self._ids_of([whole[a : a + k].encode() for a, k in zip(first[sample].tolist(), lengths[sample].tolist())])
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        counts = size[number]
        begin = np.cumsum(counts) - counts
        return flat[np.repeat(at[number] - begin, counts) + np.arange(int(counts.sum()))], counts

    def encode(self, text: str) -> np.ndarray:
        return self.encode_rows([text])[0]


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 with_ids: bool = True, block: int = BLOCK_BYTES) -> DataFrame:
    """One row per piece: ``item`` (unique), id, ``piece``, ``start``, ``length``, ``ids_crc32``, and the ``ids`` if wanted.

    A document is its ids and a final 0; only one longer than ``capacity`` is cut. Null and empty texts are one piece of one id.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"item long, id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(tokenizer)
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            column = batch.column("text")
            _, bounds = text_buffer(column)
            for a, b in row_blocks(bounds, block):
                ids, sizes = words.encode_rows(column.slice(a, b - a).to_pylist())
                closed = np.insert(ids.astype("<u4"), np.cumsum(sizes), END)  # every document ends in END
                sizes = sizes + 1
                begin = np.cumsum(sizes) - sizes
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                at = begin[row] + start
                raw = memoryview(closed.tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * i : 4 * (i + n)]) for i, n in zip(at.tolist(), length.tolist())), np.int64, len(row))
                columns = {
                    "item": pa.array(np.arange(item, item + len(row))), "id": batch.column("id").take(pa.array(a + row)), "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, len(closed)).astype(np.int32)), pa.array(closed.view("<i4")))
                item += len(row)
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)


# --- bins -----------------------------------------------------------------------------------------------------------


def lower_bound(lengths: np.ndarray, capacity: int) -> float:
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> float:
    """The best of the dual-feasible bounds on the number of bins, not rounded up, from the number of items of each size.

    A dual-feasible function maps any set of sizes that fits one bin to values of at most 1 in all, so the values'
    sum never exceeds the number of bins. Two families: sizes above ``capacity - t`` count 1 and those below ``t`` nothing;
    and sizes rounded to k-ths of a bin.
    """
    size = np.arange(capacity + 1)
    up_to, tokens = np.cumsum(counts), np.cumsum(counts * size)
    t = np.arange(1, capacity // 2 + 1)
    large = up_to[capacity] - up_to[capacity - t]
    middle = tokens[capacity - t] - tokens[t - 1]
    best = max(float(tokens[-1]) / capacity, float((large + middle / capacity).max(initial=0.0)))
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size / capacity, scaled // capacity / k)
        best = max(best, float((counts * value).sum()))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms, fill = 0, []  # bit r of rooms: some bin has room r
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> n
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + n
            b = open_at[room].pop()
            if not open_at[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        if room > n:
            open_at[room - n].append(b)
            rooms |= 1 << (room - n)
    return where, offset, np.array(fill, np.int64)


def _pack_round(items: DataFrame, parts: int, number: int, capacity: int) -> DataFrame:
    """Items packed in ``parts`` partitions: ``item, length, sequence_id, offset, room, first``, and of the partition its ``bins``, its
    ``bound`` and whether the row is in its ``emptiest`` bin."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "item"], ascending=[False, True])
        lengths = rows["length"].to_numpy()
        where, offset, fill = best_fit(lengths, capacity)
        part = int(rows["part"].iloc[0])
        return pd.DataFrame({
            "item": rows["item"], "length": lengths, "sequence_id": (number << 56 | part << 32) + where, "offset": offset,
            "room": capacity - fill[where], "first": offset == 0, "bins": len(fill), "bound": math.ceil(lower_bound(lengths, capacity) - 1e-9),
            "emptiest": where == fill.argmin(),
        })

    dealt = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(
        run, "item long, length long, sequence_id long, offset long, room long, first boolean, bins long, bound long, emptiest boolean")


def pack(items: DataFrame, capacity: int = CAPACITY, partition_items: int = PARTITION_ITEMS) -> DataFrame:
    """``item, sequence_id, offset, bins, bound`` for every row of ``items`` (``item``: unique long; ``length``: 1 to ``capacity``).

    ``bins`` and ``bound`` are the certificate of the partition that packed the sequence.
    """
    items = items.select("item", "length")
    sizes = items.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        counts[r["length"]] = r["count"]
    n = int(counts.sum())
    fewest = math.ceil(bound_of_counts(counts, capacity) - 1e-9) if n else 0
    parts = max(1, -(-n // partition_items))
    placed = staged(_pack_round(items, parts, 0, capacity))
    done: list[DataFrame] = []
    total = placed.where("first").count()
    number = 0
    while parts > 1 and total > fewest:
        given = (F.col("room") > 0) & ((F.col("bins") > F.col("bound")) | F.col("emptiest"))
        pool = placed.where(given)
        held = pool.agg(F.count(F.lit(1)), F.count_if("first")).first()
        if held[1] <= 1:
            break
        number += 1
        again_parts = max(1, min(parts // 2, -(-held[0] // partition_items)))
        again = staged(_pack_round(pool, again_parts, number, capacity))
        bins = again.where("first").count()
        if bins >= held[1]:
            break
        done.append(placed.where(~given))
        total += bins - held[1]
        placed, parts = again, again_parts
    out = placed
    for d in done:
        out = out.unionByName(d)
    return out.select("item", "sequence_id", "offset", "bins", "bound")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   partition_items: int = PARTITION_ITEMS, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``,
    ``bins`` and ``bound`` of the partition (and ``ids``, if wanted).

    Null text is empty and still takes its final 0; ids may be null or repeat (each row is packed for itself); very long texts are cut
    into pieces and each text fits its worker on its own; an empty table gives no rows; other columns play no part.
    """
    pieces = staged(token_pieces(docs, tokenizer, id_col, text_col, capacity, with_ids))
    placed = pieces.join(pack(pieces, capacity, partition_items), "item")
    return placed.drop("item").withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token ids of each sequence, from packed pieces with their ``ids``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
