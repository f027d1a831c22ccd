"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has exactly one valid encoding, so it is enough to store that encoding's last token: a token ends
prefix i if it is compatible with the last token of the prefix before it. Two tokens are compatible if no merge across
their border comes before the merges that build the two. Appending bytes only adds entries, and after an edit the entries are recomputed until
they agree with the old ones over the longest token's length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.common import whole_text

#: Pieces that a worker remembers, the longest of them, and the texts, characters and pieces of a text that are split at once.
CACHED_PIECES, LONG_PIECE, TEXTS_AT_ONCE, CHARS_AT_ONCE, PIECES_AT_ONCE = 200_000, 64, 128, 1 << 19, 50_000
#: Bytes of new pieces that are encoded together, and the size from which a piece is encoded on its own, byte after byte.
NEW_BYTES, ALONE = 1 << 19, 1024
CACHED_PAIRS = 500_000


class Vocabulary:
    """Ranks of a tiktoken file: bytes to id, id to bytes, and the two parts each token is merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts = {i: self._parts(b, i) for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self._pairs: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _parts(self, data: bytes, rank: int) -> tuple[int, int] | None:
        """What is left of the token's bytes after all merges before its own; null for single bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                raise ValueError(f"token {rank} is not the result of merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of the two encode to the two.

        Backwards in time: the later of the two merges is undone, down to the single bytes at the border. At each moment the
        tokens that then touch the border must not merge before the next event, which was the merge just undone. Of equal
        ranks the one further left comes first.
        """
        key = left << 32 | right
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self._separate(left, right)
        return found

    def _separate(self, left: int, right: int) -> bool:
        ranks, tokens, parts = self.ranks, self.tokens, self.parts
        a, b, until = left, right, 1 << 62  # a crossing merge of a rank below this comes first
        while True:
            across = ranks.get(tokens[a] + tokens[b])
            if across is not None and across < until:
                return False
            of_a, of_b = parts[a], parts[b]
            if of_a is not None and (of_b is None or a > b):
                until, a = a, of_a[1]  # the merge into a stands left of the border
            elif of_b is not None:
                until, b = b + 1, of_b[0]
            else:
                return True


class PrefixEncoding:
    """One piece with the last token of each of its prefixes."""

    __slots__ = ("vocabulary", "data", "last")

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        for i in range(len(self.last), len(self.data) + 1):
            self.last.append(self._last(i))

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Replace bytes ``start`` to ``end``; the number of entries that were recomputed."""
        kept, old_tail = self.last[: start + 1], self.last[end + 1 :]
        self.data = self.data[:start] + data + self.data[end:]
        self.last = kept
        same, done = 0, 0
        first = start + len(data) + 1  # the first prefix that ends in the unchanged tail
        for i in range(start + 1, len(self.data) + 1):
            self.last.append(self._last(i))
            done += 1
            if i >= first:
                same = same + 1 if self.last[i] == old_tail[i - first] else 0
                if same >= self.vocabulary.longest:
                    self.last += old_tail[i - first + 1 :]
                    break
        return done

    def _last(self, i: int) -> int:
        """The only token that validly ends the first ``i`` bytes."""
        data, ranks, last, compatible = self.data, self.vocabulary.ranks, self.last, self.vocabulary.compatible
        for n in range(min(i, self.vocabulary.longest), 0, -1):
            token = ranks.get(data[i - n : i])
            if token is not None and (n == i or compatible(last[i - n], token)):
                return token
        raise ValueError("the vocabulary lacks single bytes")

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= self.vocabulary.sizes[out[-1]]
        return out[::-1]


class IntMap:
    """Whole numbers to whole numbers for arrays of keys: open addressing, -1 where a key is missing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = int(2 * len(keys) + 1).bit_length()
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self._keys[at] < 0
            self._keys[at[free]] = keys[left[free]]  # of several that want a place the last gets it
            won = self._keys[at] == keys[left]
            self._values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & self._mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        seen = self._keys[at]
        out = np.where(seen == keys, self._values[at], -1)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self._mask
            seen = self._keys[at]
            hit = seen == keys[left]
            out[left[hit]] = self._values[at[hit]]
            more = ~hit & (seen >= 0)
            left, at = left[more], at[more]
        return out


class PieceEncoder:
    """The prefix tables of many pieces at once, one array for all: position by position, every token that ends there."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.width = max(v.tokens) + 1
        self.sizes, self.left, self.right = (np.zeros(self.width, np.int64) for _ in range(3))
        self.single = np.ones(self.width, bool)
        for i, b in v.tokens.items():
            self.sizes[i] = len(b)
            if v.parts[i] is not None:
                self.left[i], self.right[i] = v.parts[i]
                self.single[i] = False
        joins = [(v.ranks[b[:k]] * self.width + v.ranks[b[k:]], i) for i, b in v.tokens.items() for k in range(1, len(b)) if b[:k] in v.ranks and b[k:] in v.ranks]
        self.joins = IntMap(*np.array(joins, np.int64).reshape(-1, 2).T)
        nodes, edges, token = {b"": 0}, [], [-1]
        for i, b in v.tokens.items():
            for k in range(1, len(b) + 1):
                if b[:k] not in nodes:
                    edges.append((nodes[b[: k - 1]] * 256 + b[k - 1], len(nodes)))
                    nodes[b[:k]] = len(nodes)
                    token.append(-1)
            token[nodes[b]] = i
        self.edges, self.token = IntMap(*np.array(edges, np.int64).T), np.array(token)

    def separate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Vocabulary.compatible`` of paired tokens."""
        result, left = np.ones(len(a), bool), np.arange(len(a))
        until = np.full(len(a), 1 << 62)
        while len(left):
            across = self.joins.get(a * self.width + b)
            crossed = (across >= 0) & (across < until)
            result[left[crossed]] = False
            go = ~crossed & ~(self.single[a] & self.single[b])
            left, a, b = left[go], a[go], b[go]
            of_a = ~self.single[a] & (self.single[b] | (a > b))
            until = np.where(of_a, a, b + 1)
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
        return result

    def last_tokens(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``last, base``: the last token of prefix i of piece p stands at ``base[p] + i``. ``data``: the pieces' bytes."""
        begins = np.cumsum(sizes) - sizes
        piece = np.repeat(np.arange(len(sizes)), sizes)
        offset = np.arange(len(data)) - begins[piece]
        start, node, found = np.arange(len(data)), np.zeros(len(data), np.int64), []
        depth = 0
        while len(start):  # walk the tokens' tree from every byte at once
            node = self.edges.get(node * 256 + data[start + depth])
            depth += 1
            go = node >= 0
            start, node = start[go], node[go].astype(np.int64)
            token = self.token[node]
            ends = token >= 0
            found.append((start[ends], np.full(int(ends.sum()), depth), token[ends]))
            go = offset[start] + depth < sizes[piece[start]]
            start, node = start[go], node[go]
        start, length, token = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        base = begins + np.arange(len(sizes))
        end = offset[start] + length
        order = np.argsort(end, kind="stable")
        cuts = np.searchsorted(end[order], np.arange(1, int(sizes.max(initial=0)) + 2))
        last = np.full(len(data) + len(sizes), -1, np.int64)
        for k in range(1, len(cuts)):
            m = order[cuts[k - 1] : cuts[k]]
            before = offset[start[m]]
            at = base[piece[start[m]]]
            valid = before == 0
            inner = np.flatnonzero(~valid)
            valid[inner] = self.separate(last[at[inner] + before[inner]], token[m[inner]])
            last[at[valid] + k] = token[m[valid]]
        return last, base

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit numbers."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        last, base = self.last_tokens(data, sizes)
        left, at, found, turn = np.arange(len(pieces)), sizes.copy(), [], 0
        while True:
            go = at > 0
            left, at = left[go], at[go]
            if not len(left):
                break
            token = last[base[left] + at]
            found.append((left, np.full(len(left), -turn), token))
            at, turn = at - self.sizes[token], turn + 1
        if not found:
            return [b""] * len(pieces)
        piece, turns, token = (np.concatenate(x) for x in zip(*found))
        ids = token[np.lexsort((turns, piece))].astype("<i4").tobytes()
        ends = 4 * np.cumsum(np.bincount(piece, minlength=len(pieces)))
        return [ids[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]


class TextEncoder:
    """Whole texts, split by the pattern; each distinct piece is encoded once while it is remembered."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = Vocabulary.load(path)
        self.pieces = PieceEncoder(self.vocabulary)
        # White space as Unicode defines it, whatever the regular expression library takes it for.
        compiled = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self._find, self._each = compiled.findall, compiled.finditer
        self._known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit numbers; the new pieces of a few texts are encoded together, a very long text in parts."""
        out: list[bytes] = []
        some: list[str] = []
        for text in texts:
            if some and (len(some) == TEXTS_AT_ONCE or sum(map(len, some)) + len(text) > CHARS_AT_ONCE):
                out += self._joined([self._find(t) for t in some])
                some = []
            if len(text) > CHARS_AT_ONCE:
                out.append(b"".join(self._joined([part])[0] for part in self._parts(text)))
            else:
                some.append(text)
        return out + self._joined([self._find(t) for t in some])

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The pieces of a long text, a limited number and size at once."""
        part, size = [], 0
        for found in self._each(text):
            part.append(found.group())
            size += len(part[-1])
            if len(part) == PIECES_AT_ONCE or size > CHARS_AT_ONCE:
                yield part
                part, size = [], 0
        if part:
            yield part

    def _joined(self, split: list[list[str]]) -> list[bytes]:
        known = self._known
        new = list(set().union(*split) - known.keys())
        for at in self._batches(new):
            known.update(zip(at, self.pieces.encode([p.encode() for p in at])))
        out = [b"".join([known[p] for p in pieces]) for pieces in split]
        for p in new:
            if len(p) > LONG_PIECE:
                del known[p]
        if len(known) > CACHED_PIECES:
            known.clear()
        return out

    def _batches(self, new: list[str]) -> Iterator[list[str]]:
        """New pieces, some bytes at once; a very long one is encoded right here, by its plain prefix table."""
        batch, size = [], 0
        for p in new:
            if len(p) >= ALONE:
                self._known[p] = np.array(PrefixEncoding(self.vocabulary, p.encode()).ids(), "<i4").tobytes()
                continue
            batch.append(p)
            size += len(p)
            if size > NEW_BYTES // 4:  # up to four bytes a character
                yield batch
                batch, size = [], 0
        if batch:
            yield batch


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(path, pattern)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)


def _encoded(encoder: TextEncoder, texts: pa.Array) -> pa.ListArray:
    parts = encoder.encode(texts.to_pylist())
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _decoded(tokens: dict[int, bytes], ids: pa.ListArray) -> pa.Array:
    offsets, values = ids.offsets.to_pylist(), ids.values.to_numpy()
    return pa.array([b"".join([tokens[i] for i in values[a:b].tolist()]) for a, b in zip(offsets, offsets[1:])], pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id`` and ``ids`` (array of int) of every whole text; null and empty texts give an empty array.

    With ``decoded`` the ids are decoded again in the same task, as ``decode`` would. Ids of rows may be null or repeat, each row is encoded for itself; an
    empty table gives no rows; very long texts and pieces are encoded in parts of limited size; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            ids = _encoded(encoder, batch.column(1))
            columns = {"id": batch.column(0), "ids": ids}
            if decoded:
                columns["decoded"] = _decoded(encoder.vocabulary.tokens, ids)
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>" + (", decoded binary" if decoded else "")
    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``id``, ``ids`` and the ``decoded`` bytes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _vocabulary(path).tokens
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(tokens, batch.column(1))], names=["id", "ids", "decoded"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, ids array<int>, decoded binary")
