"""Ranked lexical search without a document index: an Aho-Corasick automaton counts the terms of all items in the text.

The terms of a block of items, each with a blank on both sides, make one automaton, which travels to the tasks. Texts are
lower-cased and every separator becomes a blank, so a term is found exactly where it stands as a whole word, and neighbours
may share a blank. One scan gives each document its length and the counts of the items' terms; document frequencies and
totals are sums over that, and a second pass over the counts (not the texts) scores them. An automaton output
leads to the items that hold the term, and a task keeps the best documents of each item only.

Scale: the items are dealt into blocks so that a block's automaton has some million characters whatever the number of
items; each block scans the texts once. A task emits ``k`` rows per item; those meet in two steps, first within
groups of tasks, so no task receives the rows of all others.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewarden.llm.common import staged, whole_text
from sitewarden.llm.words import row_blocks, text_buffer

#: Characters of the items of a block, bytes of text that are scanned at once, cells of a score matrix, groups of the last step.
BLOCK_CHARS, SCAN_BYTES, CELLS, GROUPS = 1_000_000, 1 << 20, 4_000_000, 64

_IN_WORD = [48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]
#: A to Z in lower case, separators a blank, every other byte as it is.
_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if w else 32 for b, w in enumerate(_IN_WORD))
_second = itemgetter(1)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_BYTES).split()


def automaton(terms: list[bytes]):
    """Finds every ``b' term '``; its value is the place in ``terms``. Bytes stand as the characters 0 to 255."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(f" {t.decode('latin-1')} ", i)
    found.make_automaton()
    return found


def _scanned(text: str, finder) -> Counter:
    """Counts of the automaton's outputs in a text whose separators are blanks, part by part."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= SCAN_BYTES else text.find(" ", at + SCAN_BYTES)
        end = len(text) if end < 0 else end
        counts.update(map(_second, finder.iter(f" {text[at:end]} ")))
        at = end
    return counts


def scan(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Per row of ``docs`` (``id``, ``text``): id, ``n`` (its terms, with repeats), ``found`` and ``tf`` (places in ``terms``, counts)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton(shared.value) if shared.value else None
        for batch in batches:
            data, bounds = text_buffer(batch.column("text"))
            for a, b in row_blocks(bounds, SCAN_BYTES):
                raw = data[bounds[a] : bounds[b]].tobytes().translate(_BYTES)
                word = np.frombuffer(raw, np.uint8) != 32
                first = word.copy()
                first[1:] &= ~word[:-1]
                cuts = bounds[a : b + 1] - bounds[a]
                inner = cuts[:-1][cuts[:-1] < len(word)]
                first[inner] |= word[inner]  # a row begins a word whatever ends the row before
                total = np.concatenate([[0], np.cumsum(first)])
                text = raw.decode("latin-1")
                found, tf = [], []
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    counts = _scanned(text[i:j], finder) if finder else {}
                    found.append(list(counts.keys()))
                    tf.append(list(counts.values()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(total[cuts[1:]] - total[cuts[:-1]]), pa.array(found, pa.list_(pa.int32())),
                     pa.array(tf, pa.list_(pa.int64()))], names=["id", "n", "found", "tf"])

    return docs.mapInArrow(run, "id long, n long, found array<int>, tf array<long>")


def _lengths_factor(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """``10 + (90 n N) div L`` exactly, also where the product passes 64 bits."""
    if documents and int(n.max(initial=0)) * 90 * documents >= 1 << 62:
        return np.array([10 + 90 * int(x) * documents // max(1, length) for x in n], np.int64)
    return 10 + 90 * n * documents // max(1, length)


class Best:
    """The ``k`` best documents of each item so far: highest score first, then the smaller id, a null id last."""

    _NO_ID = np.iinfo(np.int64).max

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items, np.int64)
        self.item = self.score = self.id = np.empty(0, np.int64)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` has a row per document, a column per item; scores of 0 do not count."""
        doc, item = np.nonzero(scores >= np.maximum(self.least, 1))
        item, score, key = (np.concatenate(x) for x in ((self.item, item), (self.score, scores[doc, item]), (self.id, ids[doc])))
        order = np.lexsort((key, -score, item))
        item, score, key = item[order], score[order], key[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = item[rank == self.k - 1]
        self.least[last] = score[rank == self.k - 1]
        kept = rank < self.k
        self.item, self.score, self.id = item[kept], score[kept], key[kept]


def _best_of_tasks(scanned: DataFrame, weights: np.ndarray, holders: list[np.ndarray], items: int, documents: int, length: int, k: int) -> DataFrame:
    """``item`` (place), ``id``, ``score``, ``part``: the best of each task."""
    degree = np.array([len(h) for h in holders], np.int64)
    flat = np.concatenate(holders) if holders else np.empty(0, np.int64)
    shared = scanned.sparkSession.sparkContext.broadcast((weights, degree, np.cumsum(degree) - degree, flat))
    most = int(np.bincount(flat, minlength=max(1, items)).max(initial=0))  # terms of the longest item
    exact = most * int(weights.max(initial=0)) * 1_000_000 < 1 << 53  # sums of floats are exact up to there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, degree, begin, flat = shared.value
        best = Best(items, k)
        step = max(1, min(CELLS // max(1, items), 2 * CELLS // max(1, len(flat))))
        for batch in batches:
            ids = batch.column("id").fill_null(Best._NO_ID).to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            m = _lengths_factor(n, documents, length)
            found, tf = batch.column("found"), batch.column("tf").flatten().to_numpy(zero_copy_only=False)
            sizes = found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.concatenate([[0], np.cumsum(sizes)])
            found = found.flatten().to_numpy(zero_copy_only=False)
            for a in range(0, len(ids), step):
                b = min(len(ids), a + step)
                term, count = found[cut[a] : cut[b]], tf[cut[a] : cut[b]]
                doc = np.repeat(np.arange(b - a), sizes[a:b])
                part = weight[term] * (1_000_000_000 * count // (1000 * count + 8 * m[a:b][doc]))
                times = degree[term]
                at = np.repeat(begin[term] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
                cell, part = np.repeat(doc, times) * items + flat[at], np.repeat(part, times)
                if exact:
                    scores = np.bincount(cell, part, (b - a) * items).astype(np.int64)
                else:
                    scores = np.zeros((b - a) * items, np.int64)
                    np.add.at(scores, cell, part)
                best.take(scores.reshape(b - a, items), ids[a:b])
        if len(best.item):
            own = np.full(len(best.item), TaskContext.get().partitionId(), np.int64)
            nothing = best.id == Best._NO_ID
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.item), pa.array(best.id, mask=nothing), pa.array(best.score), pa.array(own)], names=["item", "id", "score", "part"])

    return scanned.where(F.size("found") > 0).mapInArrow(run, "item long, id long, score long, part long")


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of each item with a score above 0.

    Ids of documents are whole numbers. Null texts have no term. Equal scores rank by ascending id, null ids last; rows that
    repeat are documents of their own with one rank each. Rows of ``items`` with one id (null included) are one item with
    the terms of all. Texts of any length are counted whole. Empty tables give no rows; other columns play no part.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item"), whole_text(item_text).alias("text"))
    chars = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    dealt = staged(asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))))
    kind = asked.schema["item"].dataType.simpleString()
    out = None
    for number in range(blocks):
        held: dict = {}
        for row in dealt.where(F.col("block") == number).select("item", "text").collect():  # some ``block_chars`` bytes
            held.setdefault(row.item, set()).update(terms_of(row.text))
        names = list(held)
        terms = sorted(set().union(*held.values())) if held else []
        place = {t: i for i, t in enumerate(terms)}
        holders: list[list[int]] = [[] for _ in terms]
        for j, name in enumerate(names):
            for t in held[name]:
                holders[place[t]].append(j)
        if number and not terms:
            continue
        scanned = staged(scan(texts, terms))
        documents, length = scanned.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        for row in scanned.select(F.explode("found").alias("t")).groupBy("t").count().collect():  # one row per term of the block
            df[row.t] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        best = _best_of_tasks(scanned, weights, [np.array(h, np.int64) for h in holders], len(names), documents, length, k)
        grouped = _top(best.withColumn("part", F.col("part") % GROUPS), ["item", "part"], k).select("item", "id", "score")
        last = _top(grouped, ["item"], k)
        listed = spark.createDataFrame(list(enumerate(names)), f"item long, name {kind}")
        part = staged(last.join(F.broadcast(listed), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
        out = part if out is None else out.unionByName(part)
    return out
