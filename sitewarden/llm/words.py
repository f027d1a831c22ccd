"""Words of many texts at once: bytes of an Arrow batch, word bounds, hashes and a filter of fixed size, in numpy.

Texts are handled in blocks of a fixed number of bytes, whatever the number of rows; a longer text is cut between words
into segments that share some words, so that a worker's memory does not grow with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are handled at once.
BLOCK_BYTES = 1 << 20
#: Words up to this many bytes are hashed by arithmetic on arrays, longer ones singly.
SHORT_WORD = 64

_draw = np.random.default_rng(20_240_229)
_VALUE = _draw.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_PLACE = np.append(_draw.integers(1, 1 << 63, SHORT_WORD, np.uint64) | np.uint64(1), np.uint64(0))
_STEP = _draw.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Alphabet:
    """Which bytes make words, which end a piece of text, and what each byte becomes."""

    word: np.ndarray
    ends_piece: np.ndarray
    lower: np.ndarray


def alphabet(separators: bytes, piece_ends: bytes = b"\n") -> Alphabet:
    """Words are runs of other bytes than ``separators`` and ``piece_ends``; A to Z become lower case."""
    word, ends = np.ones(256, bool), np.zeros(256, bool)
    ends[list(piece_ends)] = True
    word[list(separators + piece_ends)] = False
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return Alphabet(word, ends, lower)


@dataclass
class Words:
    """Words of a block: lower-cased bytes with one blank between words, bounds there, place in the block, piece, hash."""

    blob: bytes
    starts: np.ndarray
    ends: np.ndarray
    raw: np.ndarray
    piece: np.ndarray
    hashes: np.ndarray

    def slice(self, first: int, last: int) -> bytes:
        return self.blob[self.starts[first] : self.ends[last]]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``k`` words from the hashes of words."""
    n = max(0, len(words) - k + 1)
    total = np.full(n, seed, np.uint64)
    for j in range(k):
        total += words[j : j + n] * _STEP[j % 64] + np.uint64(j // 64)
    return mixed(total)


def words_of(data: np.ndarray, kind: Alphabet, hashed: bool = True) -> Words:
    word = kind.word[data]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    raw, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = stop - raw
    low = kind.lower[data]
    low[~word] = 32
    kept = word.copy()
    kept[stop[stop < len(data)]] = True
    blob = low[kept].tobytes()
    starts = np.cumsum(lengths + 1) - lengths - 1
    piece = np.cumsum(kind.ends_piece[data], dtype=np.int32)[raw] if len(raw) else np.empty(0, np.int32)
    found = Words(blob, starts, starts + lengths, raw, piece, np.empty(0, np.uint64))
    if hashed and len(raw):
        at = np.cumsum(lengths) - lengths
        place = np.minimum(np.arange(int(lengths.sum())) - np.repeat(at, lengths), SHORT_WORD)
        found.hashes = mixed(np.add.reduceat(_VALUE[low[word]] * _PLACE[place], at) + lengths.astype(np.uint64))
        for i in np.flatnonzero(lengths > SHORT_WORD).tolist():
            found.hashes[i] = xxhash.xxh64_intdigest(found.slice(i, i))
    return found


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column without nulls, and where each row begins and ends in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, wide)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), bounds.astype(np.int64)


def row_blocks(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``limit`` bytes together; a longer row stands alone."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, last
        first = last


def joined(data: np.ndarray, bounds: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some rows with a line feed after each, and where each row begins in them."""
    n, lead = int(bounds[last] - bounds[first]), np.arange(last - first)
    out = np.full(n + last - first, 10, np.uint8)
    inside = np.ones(len(out), bool)
    begins = bounds[first:last] - bounds[first] + lead
    inside[bounds[first + 1 : last + 1] - bounds[first] + lead] = False
    out[inside] = data[bounds[first] : bounds[last]]
    return out, begins


def segments(data: np.ndarray, kind: Alphabet, shared: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[Words, int, bool]]:
    """The words of one long text in segments: words, how many of them the segment before had too, whether more follow."""
    begin, lead, size = 0, 0, limit
    while True:
        end = min(len(data), begin + size)
        while end < len(data) and kind.word[data[end]]:
            part = kind.word[data[end : end + 4096]]
            end += len(part) if part.all() else int(part.argmin())
        found = words_of(data[begin:end], kind)
        more = end < len(data)
        if more and len(found.raw) <= 2 * shared:  # words too long for this size
            size *= 2
            continue
        yield found, lead, more
        if not more:
            return
        begin, lead, size = begin + int(found.raw[len(found.raw) - shared]) if shared else end, shared, limit


# --- a filter of fixed size -----------------------------------------------------------------------------------------

#: Bits of the largest filter (16 MB); beyond it more foreign hashes pass, and no wanted one is ever lost.
MOST_BITS = 27


def filter_of(hashes: DataFrame, column: str = "hash") -> np.ndarray:
    """A bitmap of the hashes (32 bits for each, a power of two, 16 MB at most), put together by the executors."""
    n = hashes.count()
    log = min(MOST_BITS, max(15, (32 * max(1, n) - 1).bit_length()))
    place = F.shiftrightunsigned(F.col(column), 64 - log) + 1
    parts = hashes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    bits = np.zeros(1 << (log - 3), np.uint8)
    for row in parts:  # at most 4 096 rows of 4 kB
        at = (row.bucket - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(row.bits, np.uint8)
    return bits


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
