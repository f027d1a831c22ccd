"""Pairwise text similarity: the Ratcliff/Obershelp ratio and a native alternative."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Similarity = Callable[..., Column]
#: Numbers of pairs, and the ratios of their texts.
Found = tuple[np.ndarray, np.ndarray]

#: Cells of one table of run lengths, and the length from which very common characters of the second text start no block.
_CELLS, _LONG_TEXT = 1 << 20, 200


class _Texts:
    """Code points of texts one after another."""

    def __init__(self, texts: list[str]):
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.int32)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(self.sizes) - self.sizes

    def window(self, which: np.ndarray, low: np.ndarray, high: np.ndarray, filler: int) -> np.ndarray:
        """Rows ``text[low:high]``, filled up to the longest."""
        at = np.arange(int((high - low).max()))
        place = (self.begin[which] + low)[:, None] + at
        return np.where(at < (high - low)[:, None], self.codes[np.minimum(place, len(self.codes) - 1)], filler)


def _common(texts: _Texts) -> np.ndarray:
    """Which characters are so common in a long text that no block starts from them."""
    mark = np.zeros(len(texts.codes), bool)
    for t in np.flatnonzero(texts.sizes >= _LONG_TEXT).tolist():
        span = slice(texts.begin[t], texts.begin[t] + texts.sizes[t])
        _, number, count = np.unique(texts.codes[span], return_inverse=True, return_counts=True)
        mark[span] = count[number] > texts.sizes[t] // 100 + 1
    return mark


def _longest_blocks(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the longest run that both windows share, the first in the left one, then in the right one: begins and length."""
    n, wide = right.shape
    run, before = np.zeros((n, wide + 1), np.int32), np.zeros((n, wide + 1), np.int32)
    best, at_left, at_right = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(left.shape[1]):
        np.multiply(before[:, :-1] + 1, left[:, i : i + 1] == right, out=run[:, 1:])
        longest = run.max(axis=1)
        better = np.flatnonzero(longest > best)
        if len(better):
            j = run[better].argmax(axis=1)
            best[better], at_left[better], at_right[better] = longest[better], i + 1, j
        run, before = before, run
    return at_left - best, at_right - best, best


def ratcliff_ratios(left: list[str], right: list[str], needed: np.ndarray | None = None) -> np.ndarray:
    """Twice the characters in common blocks over both lengths, for many pairs of texts at once.

    The longest common block of a pair, then those to the left and to the right of it, and so on; every round treats the open
    parts of all pairs together. Equals the standard library's ``SequenceMatcher(None, left, right).ratio()``, also in that
    very common characters of a text of 200 or more start no block. A pair whose open parts cannot lift it to ``needed`` is
    given up; its ratio is then some value below.
    """
    a, b = _Texts(left), _Texts(right)
    total = a.sizes + b.sizes
    matched = np.zeros(len(total), np.int64)
    common = _common(b)
    hidden = common.any()
    pair = np.flatnonzero((a.sizes > 0) & (b.sizes > 0))
    part = np.stack([pair, np.zeros_like(pair), a.sizes[pair], np.zeros_like(pair), b.sizes[pair]])  # pair, left from-to, right from-to
    while part.shape[1]:
        if needed is not None:
            room = np.minimum(part[2] - part[1], part[4] - part[3])
            most = 2 * (matched + np.bincount(part[0], room, len(total)))
            part = part[:, (most >= needed * total - 1e-6)[part[0]]]
            if not part.shape[1]:
                break
        part = part[:, np.argsort(np.maximum(part[2] - part[1], part[4] - part[3]), kind="stable")]
        later, at = [], 0
        while at < part.shape[1]:
            # As many parts as fit the table when filled up to the longest of them.
            sizes = (part[4] - part[3])[at:]
            fits = np.flatnonzero(np.maximum.accumulate(sizes) * np.arange(1, len(sizes) + 1) <= _CELLS)
            end = at + max(1, int(fits[-1]) + 1 if len(fits) else 1)
            which, a0, a1, b0, b1 = now = part[:, at:end]
            mine, other = a.window(which, a0, a1, -1), b.window(which, b0, b1, -2)
            shown = other
            if hidden:
                place = np.minimum((b.begin[which] + b0)[:, None] + np.arange(other.shape[1]), len(common) - 1)
                shown = np.where(common[place], -2, other)
            i, j, size = _longest_blocks(mine, shown)
            if hidden:
                i, j, size = _widened(mine, other, i, j, size, a1 - a0, b1 - b0)
            np.add.at(matched, which, size)
            hit = size > 0
            later.append(np.stack([which, a0, a0 + i, b0, b0 + j])[:, hit & (i > 0) & (j > 0)])
            later.append(np.stack([which, a0 + i + size, a1, b0 + j + size, b1])[:, hit & (a0 + i + size < a1) & (b0 + j + size < b1)])
            at = end
        part = np.concatenate(later, axis=1)
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)


def _widened(left, right, i, j, size, left_size, right_size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks grown to both sides by equal characters, common ones included."""
    rows = np.arange(len(i))
    for back in (True, False):
        while True:
            x, y = (i - 1, j - 1) if back else (i + size, j + size)
            inside = (x >= 0) & (y >= 0) & (x < left_size) & (y < right_size)
            grows = inside & (left[rows, np.clip(x, 0, left.shape[1] - 1)] == right[rows, np.clip(y, 0, right.shape[1] - 1)])
            if not grows.any():
                break
            size = size + grows
            if back:
                i, j = i - grows, j - grows
    return i, j, size


def _scored(left: pd.Series, right: pd.Series, needed: pd.Series | None = None) -> pd.Series:
    """Ratios of a batch; a pair of texts that repeats is compared once, for the least that any of its rows needs."""
    rows = pd.DataFrame({"a": left, "b": right, "n": needed if needed is not None else 0.0})
    known = rows.dropna(subset=["a", "b"])
    pairs = known.groupby(["a", "b"], sort=False)["n"].min().reset_index()
    if pairs.empty:
        return pd.Series(np.full(len(rows), np.nan))
    pairs["ratio"] = ratcliff_ratios(pairs["a"].tolist(), pairs["b"].tolist(), None if needed is None else pairs["n"].to_numpy(float))
    return rows[["a", "b"]].merge(pairs, on=["a", "b"], how="left")["ratio"].astype("float64")


@F.pandas_udf(T.DoubleType())
def _ratcliff(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield _scored(left, right)


@F.pandas_udf(T.DoubleType())
def _ratcliff_needed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right, needed in batches:
        yield _scored(left, right, needed)


def ratcliff(a: Column, b: Column, needed: Column | None = None) -> Column:
    """Ratio of two texts, argument order kept (it is not symmetric); undefined where one is null.

    With ``needed``, a ratio below it may come out as any value below it.
    """
    return _ratcliff(a, b) if needed is None else _ratcliff_needed(a, b, needed)


def levenshtein_ratio(a: Column, b: Column, needed: Column | None = None) -> Column:
    """``1 - distance / longer length``; native, used where a SQL engine must agree.

    With ``needed``, the distance is followed only as far as that allows, and a ratio below it comes out as -1.
    """
    longer = F.greatest(F.length(a), F.length(b))
    if needed is None:
        distance = F.levenshtein(a, b)
    else:
        most = F.floor((F.lit(1.0) - needed) * longer + F.lit(1e-6)).cast("int")
        distance = F.call_function("levenshtein", a, b, F.greatest(most, F.lit(0)))
    ratio = F.lit(1.0) - distance.cast("double") / longer.cast("double")
    return F.when(longer == 0, F.lit(1.0)).otherwise(ratio if needed is None else F.when(distance >= 0, ratio).otherwise(F.lit(-1.0)))


def ratcliff_bound(a: Column, b: Column) -> Column:
    """No ratio exceeds twice the shorter length over the summed lengths."""
    total = F.length(a) + F.length(b)
    return F.lit(2.0) * F.least(F.length(a), F.length(b)) / F.greatest(total, F.lit(1))


def levenshtein_bound(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.lit(1.0) - F.abs(F.length(a) - F.length(b)) / longer


def bag(text: Column) -> Column:
    """The characters of a text, each with its number among its like: sets of these intersect as bags of characters do."""
    letters = F.array_sort(F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long")))
    return F.transform(letters, lambda c, i: F.shiftleft(c, 32) + (i + 1 - F.array_position(letters, c)))


def ratcliff_bag_bound(common: Column, a: Column, b: Column) -> Column:
    """Matching blocks hold no more characters than the two bags share."""
    return F.lit(2.0) * common / F.greatest(F.length(a) + F.length(b), F.lit(1))


#: Ratio, bound from the lengths, and bound from the number of shared characters where the ratio costs more than counting them.
SIMILARITIES: dict[str, tuple[Similarity, Similarity, Callable[[Column, Column, Column], Column] | None]] = {
    "ratcliff": (ratcliff, ratcliff_bound, ratcliff_bag_bound),
    "levenshtein": (levenshtein_ratio, levenshtein_bound, None),
}


# --- many pairs of some texts at once, for searches inside a task --------------------------------------------------------

#: Letters that one machine word holds, letters up to which texts are compared by words, and pairs compared together.
_WORD, _LONG, _TOGETHER = 64, 256, 1 << 13
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


class Words:
    """Distinct texts that go by their numbers: sizes, letters as small numbers by place, and which letters they hold once and twice."""

    def __init__(self, texts: list[str]):
        coded = _Texts(texts)
        letters, number = np.unique(coded.codes, return_inverse=True)
        self.texts, self.sizes, self.n_letters = texts, coded.sizes, len(letters)
        number = number.astype(np.min_scalar_type(self.n_letters))
        self.letters = np.full((min(_LONG, int(self.sizes.max(initial=0))), len(texts)), self.n_letters, number.dtype)  # by place and text; the last number is no letter
        for p, column in enumerate(self.letters):
            reaching = np.flatnonzero(self.sizes > p)
            column[reaching] = number[coded.begin[reaching] + p]
        once, twice = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
        for column in self.letters:
            bit = np.where(column < self.n_letters, np.uint64(1) << (column % 32).astype(np.uint64), np.uint64(0))
            twice |= once & bit
            once |= bit
        self.held = np.where(self.sizes <= _LONG, once | twice << np.uint64(32), np.uint64(0))

    def lacking(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters, at least, that the left texts hold and the right ones lack, and the other way; long texts tell nothing."""
        a, b = self.held[left], self.held[right]
        told = (a != 0) & (b != 0)
        return np.bitwise_count(a & ~b) * told, np.bitwise_count(b & ~a) * told

    def _tables(self, which: np.ndarray, words: int) -> np.ndarray:
        """Per machine word, text and letter the places of the letter, as bits."""
        table, rows = np.zeros((words, len(which), self.n_letters + 1), np.uint64), np.arange(len(which))
        for p in range(int(self.sizes[which].max(initial=0))):
            table[p // _WORD, rows, self.letters[p][which]] |= np.uint64(1 << p % _WORD)
        table[:, :, self.n_letters] = 0
        return table.reshape(words, -1)

    def _by_bits(self, left: np.ndarray, right: np.ndarray, step: Callable[..., None], begin: tuple[int, ...]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Run ``step`` over the letters of the right texts; gives slices of the pairs, their state (a row per machine word) at the end and the left texts' bits."""
        together = max(256, min(_TOGETHER, (1 << 21) // (self.n_letters + 1)))
        for low in range(0, len(left), together):
            part = slice(low, low + together)
            a, b = left[part], right[part]
            new = np.ones(len(a), bool)
            new[1:] = a[1:] != a[:-1]
            words = max(1, -(-int(self.sizes[a].max()) // _WORD))
            tables, base = self._tables(a[new], words), (np.cumsum(new) - 1) * (self.n_letters + 1)
            size = self.sizes[b]
            state = np.stack([np.full((words, len(a)), x, np.uint64) for x in begin])
            ended = state.copy()
            for j in range(int(size.max())):
                step(np.take(tables, base + self.letters[j][b], axis=1), state)
                if (last := size == j + 1).any():
                    np.copyto(ended, state, where=last)
            own = np.clip(self.sizes[a] - _WORD * np.arange(words)[:, None], 0, _WORD)
            yield part, ended, np.where(own > 0, _ALL >> ((_WORD - own) % _WORD).astype(np.uint64), np.uint64(0))

    def _comparable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pairs that words can compare, those of shorter left texts first."""
        able = np.flatnonzero((self.sizes[left] <= _LONG) & (self.sizes[right] <= _LONG))
        words = -(-self.sizes[left[able]] // _WORD)
        return able if (words <= 1).all() else able[np.argsort(words, kind="stable")]

    def distances(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Levenshtein distances; a column of the table is two rows of bits (Myers), very long texts take the table itself."""
        out, able = np.zeros(len(left), np.int64), self._comparable(left, right)
        for part, (up, down), mask in self._by_bits(left[able], right[able], _column, (_ALL, 0)):
            change = np.bitwise_count(up & mask).astype(np.int64) - np.bitwise_count(down & mask)
            out[able[part]] = self.sizes[right[able[part]]] + change.sum(axis=0)
        if len(able) < len(out):
            long = np.flatnonzero((self.sizes[left] > _LONG) | (self.sizes[right] > _LONG))
            out[long] = _long_distances([self.texts[i] for i in left[long].tolist()], [self.texts[i] for i in right[long].tolist()])
        return out

    def in_order(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Letters, at most, that two texts share in the same order."""
        out, able = np.minimum(self.sizes[left], self.sizes[right]), self._comparable(left, right)
        for part, (rest,), mask in self._by_bits(left[able], right[able], _shared, (_ALL,)):
            out[able[part]] = np.bitwise_count(~rest & mask).sum(axis=0)
        return out


def _column(equal: np.ndarray, state: np.ndarray) -> None:
    """Differences down a column, from those of the column before; what rises or falls at the end of a word goes into the next."""
    one, last = np.uint64(1), np.uint64(_WORD - 1)
    rises, falls = one, np.uint64(0)
    for word, e in enumerate(equal):
        up, down = state[:, word]
        vertical = e | down
        if word:
            e = e | falls
        across = (((e & up) + up) ^ up) | e
        rise, fall = down | ~(across | up), up & across
        risen = (rise << one) | rises
        state[0, word], state[1, word] = (fall << one) | falls | ~(vertical | risen), risen & vertical
        if word + 1 < len(equal):
            rises, falls = rise >> last, fall >> last


def _shared(equal: np.ndarray, state: np.ndarray) -> None:
    carry = None
    for word, e in enumerate(equal):
        rest = state[0, word]
        hit = rest & e
        whole = rest + hit
        over = whole < rest
        if carry is not None:
            more = whole + carry
            over, whole = over | (more < whole), more
        state[0, word] = whole | (rest - hit)
        if word + 1 < len(equal):
            carry = over.astype(np.uint64)


def _long_distances(left: list[str], right: list[str]) -> np.ndarray:
    """A row of the tables of many pairs at a time; what a row passes on to its right is a running minimum."""
    a, b = _Texts(left), _Texts(right)
    out, order = np.zeros(len(left), np.int64), np.argsort(np.maximum(a.sizes, b.sizes), kind="stable")
    while len(order):
        sizes = np.maximum(a.sizes, b.sizes)[order] + 1
        now = order[: max(1, int(np.searchsorted(sizes * np.arange(1, len(sizes) + 1), _CELLS, "right")))]
        order, zero = order[len(now) :], np.zeros(len(now), np.int64)
        mine, other = a.window(now, zero, a.sizes[now], -1), b.window(now, zero, b.sizes[now], -2)
        at = np.arange(other.shape[1] + 1)
        row = np.broadcast_to(at, (len(now), len(at)))
        out[now] = b.sizes[now]
        for i in range(mine.shape[1]):
            new = np.empty((len(now), len(at)), np.int64)
            new[:, 0] = i + 1
            np.minimum(row[:, 1:] + 1, row[:, :-1] + (other != mine[:, i : i + 1]), out=new[:, 1:])
            row = np.minimum.accumulate(new - at, axis=1) + at
            done = np.flatnonzero(a.sizes[now] == i + 1)
            out[now[done]] = row[done, b.sizes[now[done]]]
    return out


@dataclass(frozen=True)
class Kernel:
    """A similarity for numbers of ``Words``.

    ``ratios`` of pairs; ``unequal``: no two different texts of at most that size are more alike; ``bound``: no pair is more alike;
    ``search`` gives pairs by number with their ratios, leaving out such as cannot reach what ``needed`` says of their numbers then.
    """

    ratios: Callable[[Words, np.ndarray, np.ndarray], np.ndarray]
    unequal: Callable[[np.ndarray], np.ndarray]
    bound: Callable[[Words, np.ndarray, np.ndarray], np.ndarray]
    search: Callable[[Words, np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]], Iterator[Found]]


def _levenshtein_ratios(words: Words, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    longer = np.maximum(words.sizes[left], words.sizes[right])
    return np.where(longer > 0, 1.0 - words.distances(left, right) / np.maximum(longer, 1), 1.0)


def _levenshtein_most(words: Words, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    a, b = words.sizes[left], words.sizes[right]
    apart = np.maximum(np.maximum(*words.lacking(left, right)), np.abs(a - b))
    return 1.0 - apart / np.maximum(np.maximum(a, b), 1)


def _levenshtein_search(words: Words, left: np.ndarray, right: np.ndarray, owner: np.ndarray, needed: Callable) -> Iterator[Found]:
    yield np.arange(len(left)), _levenshtein_ratios(words, left, right)


def _ratcliff_of(words: Words, left: np.ndarray, right: np.ndarray, needed: np.ndarray | None = None) -> np.ndarray:
    return ratcliff_ratios([words.texts[i] for i in left.tolist()], [words.texts[i] for i in right.tolist()], needed)


def _ratcliff_most(words: Words, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    a, b = words.sizes[left], words.sizes[right]
    only_a, only_b = words.lacking(left, right)
    return 2.0 * np.minimum(a - only_a, b - only_b) / np.maximum(a + b, 1)


def _ratcliff_search(words: Words, left: np.ndarray, right: np.ndarray, owner: np.ndarray, needed: Callable) -> Iterator[Found]:
    """Matching blocks are in order: pairs that share most letters in order come first, one per owner, then two, then four."""
    most = 2.0 * words.in_order(left, right) / np.maximum(words.sizes[left] + words.sizes[right], 1)
    open_ = np.flatnonzero(most >= needed(np.arange(len(left))))
    spare = most[open_] - needed(open_)
    open_ = open_[np.lexsort((-spare, owner[open_]))]
    new = np.ones(len(open_), bool)
    new[1:] = owner[open_][1:] != owner[open_][:-1]
    place = np.arange(len(open_)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    turn, now = np.frexp(place + 1.0)[1], 1
    while len(open_):
        mine = turn == now
        some, open_, turn, now = open_[mine], open_[~mine], turn[~mine], now + 1
        able = needed(some)
        some = some[most[some] >= able]
        if len(some):
            yield some, _ratcliff_of(words, left[some], right[some], needed(some))


KERNELS: dict[str, Kernel] = {
    "ratcliff": Kernel(_ratcliff_of, lambda size: 1.0 - 0.5 / np.maximum(size, 1), _ratcliff_most, _ratcliff_search),
    "levenshtein": Kernel(_levenshtein_ratios, lambda size: 1.0 - 1.0 / np.maximum(size, 1), _levenshtein_most, _levenshtein_search),
}
