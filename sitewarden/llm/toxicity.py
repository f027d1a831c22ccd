"""Toxicity categories by a chain of linear models.

Categories are predicted one after the other. Each model sees a text's word features and the probabilities of the
categories before it. While fitting, those probabilities come from models that have not seen the row (out of
fold), so later models learn from values as they will be at prediction.

The chain is fitted on a bounded sample of labelled rows (``rows``) and of features (``features``), whatever the size of the
tables; scoring reads every whole text once, in parallel, without a shuffle.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.common import staged, whole_text

#: Fitting: labelled rows, features (the most frequent of the sample, in at least so many of its texts), folds.
ROWS, FEATURES, LEAST_TEXTS, FOLDS = 6_000, 60_000, 3, 3
#: A model uses the features whose frequency among its positive rows is so many standard deviations off the expected one.
DEVIATIONS, PENALTY = 3.0, 0.3
#: Occurrences of a feature that are told apart: one, two, three or more.
LEVELS = 3
CACHED_WORDS = 300_000
_MARKS = string.punctuation


def word_features(word: str) -> list[int]:
    """The word without its marks, its beginnings of three to six characters, and the marks it ends in."""
    bare = word.strip(_MARKS)
    end = word[len(word.rstrip(_MARKS)) :]
    names = [f"<{bare}>", *(f"<{bare[:n]}" for n in (3, 4, 5, 6) if len(bare) >= n)] if bare else []
    return [zlib.crc32(n.encode("utf-8", "replace")) for n in ([*names, f"end:{end}"] if end else names)]


def text_features(text: str) -> set[int]:
    """Hashes of the features with their levels: a feature that occurs twice is present at levels 0 and 1."""
    counts: Counter[int] = Counter()
    for w, n in Counter(text.lower().split()).items():
        for f in word_features(w):
            counts[f] += n
    return {f << 2 | level for f, n in counts.items() for level in range(min(n, LEVELS))}


def _loss(x: np.ndarray, rows, dense: np.ndarray, y: np.ndarray, features: int, penalty: float) -> tuple[float, np.ndarray]:
    index, row = rows
    w, v, b = x[:features], x[features:-1], x[-1]
    z = np.bincount(row, w[index], len(y)) + dense @ v + b
    p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    error = p - y
    value = float(np.logaddexp(0, z).sum() - y @ z + penalty / 2 * (x[:-1] @ x[:-1]))
    grad = np.concatenate([np.bincount(index, error[row], features), dense.T @ error, [error.sum()]])
    grad[:-1] += penalty * x[:-1]
    return value, grad


def fit_logistic(rows, dense: np.ndarray, y: np.ndarray, features: int, penalty: float = PENALTY, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression on present features (``rows``: feature and row of each) and dense columns, by L-BFGS."""
    x = np.zeros(features + dense.shape[1] + 1)
    value, grad = _loss(x, rows, dense, y, features, penalty)
    memory: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, a = grad.copy(), []
        for s, g, r in reversed(memory):
            a.append(r * (s @ q))
            q -= a[-1] * g
        q *= (memory[-1][0] @ memory[-1][1]) / (memory[-1][1] @ memory[-1][1]) if memory else 1 / max(1.0, float(np.abs(grad).max()))
        for (s, g, r), c in zip(memory, reversed(a)):
            q += s * (c - r * (g @ q))
        step, slope = 1.0, float(grad @ q)
        while step > 1e-8:
            new = x - step * q
            new_value, new_grad = _loss(new, rows, dense, y, features, penalty)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, g = new - x, new_grad - grad
        if s @ g > 1e-12:
            memory = [*memory[-9:], (s, g, 1 / float(s @ g))]
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x


def fit_selected(rows, dense: np.ndarray, y: np.ndarray, features: int) -> np.ndarray:
    """``fit_logistic`` on the features that these rows associate with ``y``; all others get weight 0."""
    index, row = rows
    share, seen = y.mean() if len(y) else 0.0, np.bincount(index, minlength=features)
    spread = np.sqrt(np.maximum(seen, 1) * (1 - seen / max(1, len(y)) + 1e-9) * max(share * (1 - share), 1e-9))
    chosen = np.flatnonzero(np.abs(np.bincount(index, y[row], features) - seen * share) >= DEVIATIONS * spread)
    place = np.full(features, -1)
    place[chosen] = np.arange(len(chosen))
    used = place[index] >= 0
    x = fit_logistic((place[index[used]], row[used]), dense, y, len(chosen))
    whole = np.zeros(features + dense.shape[1] + 1)
    whole[chosen], whole[features:] = x[: len(chosen)], x[len(chosen) :]
    return whole


@dataclass
class Chain:
    categories: list[str]
    index: dict[int, int]  # feature hash to column
    models: list[np.ndarray]

    def predict(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Probabilities, one row per text and one column per category; ``columns``: the features of each text."""
        n, features = len(columns), len(self.index)
        row = np.repeat(np.arange(n), [len(c) for c in columns])
        index = np.concatenate(columns).astype(np.int64) if n else np.empty(0, np.int64)
        out = np.zeros((n, len(self.models)))
        for k, x in enumerate(self.models):
            z = np.bincount(row, x[index], n) + out[:, :k] @ x[features:-1] + x[-1]
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        return out


def fit_chain(columns: Sequence[np.ndarray], labels: np.ndarray, categories: list[str], index: dict[int, int], folds: int = FOLDS) -> Chain:
    """``labels``: one 0/1 column per category, in the order of the chain."""
    n, features = len(columns), len(index)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in columns])
    flat = np.concatenate(columns).astype(np.int32) if n else np.empty(0, np.int32)
    fold = np.arange(n) % folds
    earlier, models = np.zeros((n, 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(fit_selected((flat, row), earlier, y, features))
        if k + 1 == labels.shape[1]:
            break
        unseen = np.zeros(n)
        for f in range(folds):
            train = fold[row] != f
            place = np.cumsum(fold != f) - 1
            x = fit_selected((flat[train], place[row[train]]), earlier[fold != f], y[fold != f], features)
            z = np.bincount(row, x[flat], n) + earlier @ x[features:-1] + x[-1]
            unseen[fold == f] = (1 / (1 + np.exp(-np.clip(z, -35, 35))))[fold == f]
        earlier = np.column_stack([earlier, unseen])
    used = np.flatnonzero(np.any([x[:features] != 0 for x in models], axis=0))
    place = {int(c): i for i, c in enumerate(used)}
    kept = {f: place[c] for f, c in index.items() if c in place}
    return Chain(categories, kept, [np.r_[x[:features][used], x[features:]] for x in models])


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS,
        features: int = FEATURES) -> Chain | None:
    """A chain over the 0/1 columns ``categories`` of ``labels``; null where no labelled row has a text.

    The sample is the ``rows`` labelled ids with the smallest hash. Rows without id, label or text are left out; of labels
    that repeat an id the largest values count.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*[F.max(c).alias(c) for c in categories])
    for c in categories:
        known = known.where(F.col(c).isNotNull())
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)  # so many rows at most
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.array(sorted(text_features(t)), np.int64) for t in batch["_text"]]
            yield pd.concat([batch.drop(columns="_text"), pd.Series(found, index=batch.index, name="features")], axis=1)

    kinds = ", ".join(f"`{c}` double" for c in categories)
    sample = texts.join(F.broadcast(chosen), "_id").select("_id", *[F.col(c).cast("double") for c in categories], "_text")
    kind = docs.schema[id_col].dataType.simpleString()
    sample = staged(sample.mapInPandas(present, f"_id {kind}, {kinds}, features array<long>"))
    counts = sample.select(F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TEXTS)
    index = {r.f: i for i, r in enumerate(counts.orderBy(F.desc("n"), "f").limit(features).collect())}

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["features"] = [np.array([index[f] for f in x if f in index], "<i4").tobytes() for x in batch["features"]]
            yield batch

    found = sample.mapInPandas(select, f"_id {kind}, {kinds}, features binary").orderBy(F.xxhash64("_id"), "_id").collect()
    if not found:
        return None
    y = np.array([[r[c] > 0 for c in categories] for r in found])
    return fit_chain([np.frombuffer(r.features, "<i4") for r in found], y, categories, index)


def predict(docs: DataFrame, chain: Chain | None, categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and one probability ``p_<category>`` for every row; null text is empty, and without a chain all are 0.

    Rows that repeat get the same probabilities, a tie at 0.5 is left to the caller, very long texts are read whole, an empty table gives no rows, and other
    columns play no part.
    """

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            if chain is None:
                yield pd.Series([np.zeros(len(categories))] * len(texts))
                continue
            index, found = chain.index, []
            bases = {f >> 2 for f in index}
            for text in texts:
                counts: dict[int, int] = {}
                for w, n in Counter(text.lower().split()).items():
                    features = known.get(w)
                    if features is None:
                        if len(known) >= CACHED_WORDS:
                            known.clear()
                        features = known[w] = tuple(f for f in word_features(w) if f in bases)
                    for f in features:
                        counts[f] = counts.get(f, 0) + n
                here = (f << 2 | level for f, n in counts.items() for level in range(min(n, LEVELS)))
                found.append(np.array(sorted(index[x] for x in here if x in index), np.int64))
            yield pd.Series(list(chain.predict(found)))

    scored = docs.select(F.col(id_col), of(whole_text(text_col)).alias("_p"))
    return scored.select(id_col, *[F.col("_p")[k].alias(f"p_{c}") for k, c in enumerate(categories)])
