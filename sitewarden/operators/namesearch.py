"""Best incidents of a block of acts: what one task of the matching does, in numpy over a block whose size Spark bounds.

Rows of one date and one kind (company, region, severity) are a context. Two contexts are scored once but for the name, which
gives the most that a pair of theirs can reach. An act meets equal names first, then the contexts that offer most, and goes on
only where that could lift it to the threshold and to what it has. Names are compared where their lengths and letters allow it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sitewarden.functions.similarity import KERNELS, Words

ACT_KEY = ("a_date", "a_company", "a_region", "a_class", "a_name")
PARTS = ("s_date", "s_company", "s_region", "s_injury")
#: Pairs treated together: of contexts, of acts and contexts, of names.
_CELLS, _ROWS, _PAIRS = 1 << 20, 1 << 19, 1 << 17
#: Ends of the bands in which the contexts of an act are searched, as shares of the way from the best of them down to the threshold.
_BANDS = (1e-9, 0.0625, 0.125, 0.25, 0.5)
_SLACK = 1e-9


@dataclass(frozen=True)
class Rule:
    """What the score is made of; ``weights`` are those of date, name, company, region, injury."""

    threshold: float
    days: int
    similarity: str
    weights: tuple[float, float, float, float, float]
    contained: float
    mismatch: float

    def total(self, date: Any, name: Any, company: Any, region: Any, injury: Any) -> Any:
        w = self.weights
        return w[0] * date + w[1] * name + w[2] * company + w[3] * region + w[4] * injury


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbours whose sizes sum up to ``most``, one at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(at, to)
        at = to


def _expanded(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` numbers from ``first`` on: whose it is, and the number."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) + (first - (np.cumsum(n) - n))[owner]


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _turns(owner: np.ndarray) -> Iterator[np.ndarray]:
    """Of sorted owners the first entry of each, then the next two, then four: what the first give may spare the rest."""
    begins = _begins(owner)
    place = np.arange(len(owner)) - np.repeat(begins, np.diff(begins, append=len(owner)))
    turn = np.frexp(place + 1.0)[1]
    for t in np.unique(turn):
        yield np.flatnonzero(turn == t)


def _coded(*columns: pa.ChunkedArray) -> tuple[list[str], list[np.ndarray]]:
    """Distinct texts of some columns, and the columns as numbers of these."""
    whole = pa.chunked_array([part for c in columns for part in c.chunks]).combine_chunks().dictionary_encode()
    ends = np.cumsum([len(c) for c in columns])[:-1]
    return whole.dictionary.to_pylist(), np.split(whole.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends)


class _TextScores:
    """Scores of two texts: 0.9 if one contains the other, else their ratio; empty scores 0.

    Kept from block to block, since dates repeat the same companies and regions, as long as all pairs are few enough.
    """

    def __init__(self, rule: Rule):
        self.rule, self.left, self.right, self.scores = rule, {}, {}, np.full((64, 64), np.nan)

    def of(self, left: list[str], right: list[str]) -> np.ndarray:
        """Scores of every left with every right text, none of them twice."""
        if len(self.left.keys() | left) * len(self.right.keys() | right) > _KEPT:
            self.__init__(self.rule)
        i, j = (np.array([known.setdefault(t, len(known)) for t in texts], np.int64) for known, texts in ((self.left, left), (self.right, right)))
        if (grown := np.maximum(self.scores.shape, (len(self.left), len(self.right)))).tolist() != list(self.scores.shape):
            more = np.full(np.where(grown > self.scores.shape, grown * 3 // 2, grown), np.nan)
            more[: self.scores.shape[0], : self.scores.shape[1]] = self.scores
            self.scores = more
        a, b = np.nonzero(np.isnan(self.scores[i[:, None], j]))
        if len(a):
            self.scores[i[a], j[b]] = self._computed(left, right, a, b)
        return self.scores[i[:, None], j]

    def _computed(self, left: list[str], right: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs = ((left[x], right[y]) for x, y in zip(a.tolist(), b.tolist()))
        score = np.array([0.0 if not x or not y else self.rule.contained if x in y or y in x else -1.0 for x, y in pairs])
        if len(open_ := np.flatnonzero(score < 0)):
            words = Words(list(dict.fromkeys([*left, *right])))
            at = {t: n for n, t in enumerate(words.texts)}
            x, y = np.array([at[t] for t in left])[a[open_]], np.array([at[t] for t in right])[b[open_]]
            score[open_] = KERNELS[self.rule.similarity].ratios(words, x, y)
        return score


#: Scores of texts that this Python worker has met: of companies and of regions, by rule.
_met: dict[tuple[str, Rule], _TextScores] = {}
_KEPT = 1 << 23


class _Block:
    """Acts and incidents sorted by context, and the best incident that each act has found."""

    def __init__(self, acts: pa.Table, incidents: pa.Table, rule: Rule):
        self.rule, self.kernel = rule, KERNELS[rule.similarity]
        days = [t.column(c).cast(pa.int32()).to_numpy().astype(np.int64) for t, c in ((acts, "a_date"), (incidents, "day"))]
        companies, (a_company, i_company, i_dzo) = _coded(acts.column("a_company"), incidents.column("i_company"), incidents.column("i_dzo"))
        regions, (a_region, i_region) = _coded(acts.column("a_region"), incidents.column("i_region"))
        classes, (a_class, i_class) = _coded(acts.column("a_class"), incidents.column("i_class"))
        names, (a_name, i_name) = _coded(acts.column("a_name"), incidents.column("i_name"))
        self.unclassed = classes.index("") if "" in classes else -1
        self.words = Words(names)
        self.texts = {"company": companies, "region": regions}

        self.a_order = np.lexsort((a_class, a_region, a_company, days[0]))
        self.i_order = np.lexsort((i_class, i_region, i_dzo, i_company, days[1]))
        a_day, a_company, a_region, a_class, self.a_name = (c[self.a_order] for c in (days[0], a_company, a_region, a_class, a_name))
        i_day, i_company, i_dzo, i_region, i_class, self.i_name = (c[self.i_order] for c in (days[1], i_company, i_dzo, i_region, i_class, i_name))
        self.i_rank = pc.rank(incidents.column("incident_id"), "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)[self.i_order]

        self.a_first = _begins(a_day, a_company, a_region, a_class)
        self.a_count = np.diff(self.a_first, append=len(a_day))
        self.i_first = _begins(i_day, i_company, i_dzo, i_region, i_class)
        self.i_count = np.diff(self.i_first, append=len(i_day))
        self.a_kind = [c[self.a_first] for c in (a_day, a_company, a_region, a_class)]
        self.i_kind = [c[self.i_first] for c in (i_day, i_company, i_dzo, i_region, i_class)]
        self.longest = np.maximum.reduceat(self.words.sizes[self.i_name], self.i_first)

        n = len(a_day)
        self.score, self.rank, self.found = np.zeros(n), np.zeros(n, np.int64), np.full(n, -1)
        self.parts, self.ratio = np.zeros((len(PARTS), n)), np.zeros(n)

    def search(self) -> None:
        dates = self.a_kind[0]
        for begin, end in zip(at := _begins(dates), np.append(at[1:], len(dates))):
            low, high = np.searchsorted(self.i_kind[0], (dates[begin] - self.rule.days, dates[begin] + self.rule.days + 1))
            if low < high:
                step = max(1, _CELLS // int(high - low))
                for c in range(begin, end, step):
                    self._contexts(np.arange(c, min(c + step, end)), np.arange(low, high))

    def _texts_scored(self, what: str, left: np.ndarray, *right: np.ndarray) -> list[np.ndarray]:
        """Scores of every left with every right number of a text, for some columns of these."""
        texts, known = self.texts[what], _met.setdefault((what, self.rule), _TextScores(self.rule))
        (a, at), (b, to) = np.unique(left, return_inverse=True), np.unique(np.concatenate(right), return_inverse=True)
        scores = known.of([texts[i] for i in a.tolist()], [texts[i] for i in b.tolist()])
        return [scores[at[:, None], part] for part in np.split(to, len(right))]

    def _contexts(self, mine: np.ndarray, others: np.ndarray) -> None:
        """Search for the acts of some contexts of one date in the contexts of the dates around."""
        rule = self.rule
        (a_day, a_company, a_region, a_class), (i_day, i_company, i_dzo, i_region, i_class) = [c[mine] for c in self.a_kind], [c[others] for c in self.i_kind]
        date = np.broadcast_to(1.0 - np.abs(i_day - a_day[0]) / 4.0, (len(mine), len(others)))
        company = np.maximum(*self._texts_scored("company", a_company, i_company, i_dzo))
        (region,) = self._texts_scored("region", a_region, i_region)
        injury = np.where(a_class[:, None] == i_class, 1.0, rule.mismatch) * ((a_class != self.unclassed)[:, None] & (i_class != self.unclassed))
        ceiling = rule.total(date, 1.0, company, region, injury)
        a, i = np.nonzero(ceiling >= rule.threshold - _SLACK)
        if not len(a):
            return
        self._equal_names(mine, others, ceiling, (date, company, region, injury))
        best = ceiling.max(axis=1)[a]
        band = np.searchsorted(_BANDS, (best - ceiling[a, i]) / np.maximum(best - rule.threshold, _SLACK))
        parts = np.stack([x[a, i] for x in (date, company, region, injury)])
        rest = rule.total(parts[0], 0.0, *parts[1:])
        for b in range(len(_BANDS) + 1):
            here = np.flatnonzero(band == b)
            for turn in _turns(a[here]):
                for cells in _parts(self.a_count[mine[a[here[turn]]]], _ROWS):
                    now = here[turn[cells]]
                    self._similar_names(mine[a[now]], others[i[now]], rest[now], parts[:, now])

    def _equal_names(self, mine: np.ndarray, others: np.ndarray, ceiling: np.ndarray, parts: tuple[np.ndarray, ...]) -> None:
        a_own, acts = _expanded(self.a_first[mine], self.a_count[mine])
        i_own, incidents = _expanded(self.i_first[others], self.i_count[others])
        order = np.argsort(self.i_name[incidents], kind="stable")
        named = self.i_name[incidents][order]
        first = np.searchsorted(named, self.a_name[acts])
        n = np.searchsorted(named, self.a_name[acts], "right") - first
        for some in _parts(n, _ROWS):
            own, at = _expanded(first[some], n[some])
            x, y = a_own[some][own], i_own[order[at]]
            self._keep(acts[some][own], incidents[order[at]], ceiling[x, y], np.ones(len(x)), np.stack([p[x, y] for p in parts]), np.arange(len(x)))

    def _needed(self, acts: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Ratio of names that lifts an act to the threshold and to what it has."""
        return (np.maximum(self.rule.threshold, self.score[acts]) - _SLACK - rest) / self.rule.weights[1]

    def _similar_names(self, a: np.ndarray, i: np.ndarray, rest: np.ndarray, parts: np.ndarray) -> None:
        sizes = self.words.sizes
        cell, act = _expanded(self.a_first[a], self.a_count[a])
        most = self.kernel.unequal(np.maximum(sizes[self.a_name[act]], self.longest[i[cell]]))
        able = most >= self._needed(act, rest[cell])
        cell, act, most = cell[able], act[able], most[able]
        for some in _parts(self.i_count[i[cell]], _PAIRS):
            open_ = most[some] >= self._needed(act[some], rest[cell[some]])
            c, x = cell[some][open_], act[some][open_]
            if not len(c):
                continue
            needed, name = self._needed(x, rest[c]), self.a_name[x]
            row, incident = _expanded(self.i_first[i[c]], self.i_count[i[c]])
            other = self.i_name[incident]
            close = np.flatnonzero(self.kernel.bound(self.words, name[row], other) >= needed[row])
            row, incident, other = row[close], incident[close], other[close]
            for some_pairs, ratio in self.kernel.search(self.words, name[row], other, x[row], lambda p: self._needed(x[row[p]], rest[c[row[p]]])):
                r, at = row[some_pairs], c[row[some_pairs]]
                score = self.rule.total(parts[0, at], ratio, *parts[1:, at])
                self._keep(x[r], incident[some_pairs], score, ratio, parts, at)

    def _keep(self, act: np.ndarray, incident: np.ndarray, score: np.ndarray, ratio: np.ndarray, parts: np.ndarray, at: np.ndarray) -> None:
        """The higher score stays, of equal ones the lower incident."""
        good = np.flatnonzero(score >= np.maximum(self.rule.threshold, self.score[act]))
        for value in (lambda: score[good], lambda: -self.i_rank[incident[good]]):  # the best of each run of an act's pairs
            if len(good):
                begins = _begins(act[good])
                most = np.maximum.reduceat(value(), begins)
                good = good[value() == np.repeat(most, np.diff(begins, append=len(good)))]
        good = good[np.lexsort((self.i_rank[incident[good]], -score[good], act[good]))]
        if not len(good):
            return
        good = good[_begins(act[good])]
        a, rank = act[good], self.i_rank[incident[good]]
        better = (score[good] > self.score[a]) | (rank < self.rank[a]) | (self.found[a] < 0)
        good, a, rank = good[better], a[better], rank[better]
        self.score[a], self.rank[a], self.found[a], self.ratio[a] = score[good], rank, incident[good], ratio[good]
        self.parts[:, a] = parts[:, at[good]]


def best_in_block(acts: pa.Table, incidents: pa.Table, rule: Rule) -> pa.Table:
    """Acts that reach the threshold, each with its best incident, the parts of the score and the ratio of the names."""
    if acts.num_rows and incidents.num_rows:
        block = _Block(acts, incidents, rule)
        block.search()
        hit = np.flatnonzero(block.found >= 0)
        which, of, parts, ratio = block.a_order[hit], block.i_order[block.found[hit]], block.parts[:, hit], block.ratio[hit]
    else:
        which = of = np.zeros(0, np.int64)
        parts, ratio = np.zeros((len(PARTS), 0)), np.zeros(0)
    own, met = acts.select(ACT_KEY).take(which), incidents.select(("incident_id", "i_name")).take(of)
    return pa.table(dict(zip(own.column_names, own.columns)) | dict(zip(met.column_names, met.columns)) | {n: pa.array(p) for n, p in zip(PARTS, parts)} | {"s_name": pa.array(ratio)})
