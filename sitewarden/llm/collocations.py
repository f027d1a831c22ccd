"""Phrases that stand out, from a weighted de Bruijn graph of the longest grams.

Edges are the longest grams (``longest`` words), nodes the grams one word shorter that overlap in them; an edge weighs its
occurrences. Only the edges are counted in the text, and with them the grams that end a stretch of words, as those have no
edge to the next word. Counts of shorter phrases follow from the graph: the flow through a node is the weight of the edges
that leave it and of the stretches that end there; nodes are the edges of the next shorter level. Frequent edges along nodes
through which all flow passes straight on (unary paths) are compacted into one path of words each. A phrase is part
of an equally frequent longer one exactly if a single edge into or out of its node carries its whole flow.

Scale: a phrase that reaches ``least`` is made of words and neighbouring pairs that do. Words, then pairs, are counted first (by hash), and a
stretch is cut wherever a pair is known to be rarer, by a bitmap of fixed size that errs only towards not cutting. So edges grow
with the text that frequent phrases cover, not with all text; every count stays exact. Repeats are added up in the
task and before each shuffle. Tokenising works on blocks of a fixed size, whatever the length of a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewarden.llm.common import staged, whole_text
from sitewarden.llm.words import BLOCK_BYTES, Words, alphabet, filter_of, gram_hashes, joined, passes, row_blocks, segments, text_buffer, words_of

LONGEST, LEAST = 5, 100
#: Different phrases that a task adds up before it hands them on, hashes that it sorts at once, and parts of a very common word.
HELD, HASHES, SALTS = 500_000, 3_000_000, 16

#: Words are separated by blanks and tabs; pieces by punctuation and line ends.
PIECES = alphabet(b" \t", b".,;:!?\n\x0b\x0c\r")


def _marked(hashes: np.ndarray, lang: str) -> np.ndarray:
    return hashes ^ np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "replace")))


class _Stretch:
    """Words of one segment, in one language: ``lead`` of them belong to the segment before, ``more`` follow."""

    def __init__(self, words: Words, lead: int, more: bool, lang: str):
        self.words, self.lead, self.more, self.lang = words, lead, more, lang
        self.n = len(words.raw)

    def singles(self) -> np.ndarray:
        return _marked(gram_hashes(self.words.hashes, 1, 1), self.lang)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of neighbouring words, and whether both are in one piece."""
        return _marked(gram_hashes(self.words.hashes, 2, 2), self.lang), self.words.piece[:-1] == self.words.piece[1:]


def _stretches(batch: pa.RecordBatch, shared: int, block: int) -> Iterator[_Stretch]:
    langs = np.array(batch.column("lang").to_pylist(), object)
    column = batch.column("text")
    for lang in sorted(set(langs.tolist())):
        data, bounds = text_buffer(column.take(pa.array(np.flatnonzero(langs == lang))))
        for a, b in row_blocks(bounds, block):
            if b == a + 1 and bounds[b] - bounds[a] > block:
                for words, lead, more in segments(data[bounds[a] : bounds[b]], PIECES, shared, block):
                    yield _Stretch(words, lead, more, lang)
            else:
                yield _Stretch(words_of(joined(data, bounds, a, b)[0], PIECES), 0, False, lang)


def _counted(texts: DataFrame, longest: int, block: int, held: int, phrases) -> DataFrame:
    """``lang, words, phrase, f``: what ``phrases(stretch)`` yields as (words, phrases or their counts), added up over the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, words), found in counts.items():
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array(np.full(n, words, np.int32)), pa.array(list(found), pa.binary()).cast(pa.string()),
                     pa.array(list(found.values()), pa.int64())], names=["lang", "words", "phrase", "f"])
            counts.clear()

        for batch in batches:
            for stretch in _stretches(batch, longest - 1, block):
                for words, found in phrases(stretch):
                    counts.setdefault((stretch.lang, words), Counter()).update(found)
                if sum(map(len, counts.values())) > held:
                    yield from out()
        yield from out()

    rows = texts.mapInArrow(run, "lang string, words int, phrase string, f long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def _often(texts: DataFrame, longest: int, block: int, least: int, hashes) -> DataFrame:
    """``hash`` (its upper 48 bits) of whatever ``hashes(stretch)`` yields ``least`` times or more over the table.

    Counted by hash alone: two phrases that share one may pass together, and a filter may err that way. A task sorts its hashes and sends
    them on in ranges, six bytes and a count (up to ``least``) each; a range is added up in one piece of limited size.
    """
    parts = 1 << max(8, (4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    most = min(least, (1 << 32) - 1)
    width = np.uint8 if most < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            found, count = np.unique(np.concatenate(held) >> np.uint64(16), return_counts=True)
            held.clear()
            count = np.minimum(count, most).astype(width)
            part = (found >> np.uint64(48 - parts.bit_length() + 1)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
            ends = np.append(first, len(part))
            six = np.ascontiguousarray(found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            cut = lambda data, size: pa.array([data[a * size : b * size] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(part[first].astype(np.int32)), cut(six.tobytes(), 6), cut(count.tobytes(), count.itemsize)], names=["part", "six", "n"])

        for batch in batches:
            for stretch in _stretches(batch, longest - 1, block):
                held.append(hashes(stretch))
                if sum(map(len, held)) > HASHES:
                    yield out()
        if sum(map(len, held)):
            yield out()

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        six = np.frombuffer(b"".join(rows["six"]), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(six), 8), np.uint8)
        wide[:, :6] = six
        found, number = np.unique(wide.view("<u8").ravel(), return_inverse=True)
        total = np.bincount(number, np.frombuffer(b"".join(rows["n"]), width))
        return pd.DataFrame({"hash": (found[total >= most] << np.uint64(16)).view(np.int64)})

    return texts.mapInArrow(run, "part int, six binary, n binary").groupBy("part").applyInPandas(add, "hash long")


def _part(phrase: str, words: int, last: bool) -> Column:
    """The first or the last so many words of a phrase."""
    return F.substring_index(F.col(phrase), " ", -words if last else words)


def grams(texts: DataFrame, longest: int = LONGEST, least: int = LEAST, block: int = BLOCK_BYTES, held: int = HELD) -> DataFrame:
    """The graph's edges and ends ``lang, words, phrase, f``.

    Rows of ``longest`` words are edges; shorter ones are the last words of stretches (as many as a node has, or the whole stretch), by which words
    that follow no more are made up for; a row of no words counts all words of its language.
    """
    sc = texts.sparkSession.sparkContext
    words = sc.broadcast(filter_of(staged(_often(texts, longest, block, least, lambda s: s.singles()[s.lead :]))).tobytes())

    def neighbours(s: _Stretch) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of neighbouring words, and whether both stand in one piece and are frequent."""
        often = passes(np.frombuffer(words.value, np.uint8), s.singles())
        hashes, together = s.pairs()
        return hashes, together & often[:-1] & often[1:]

    def frequent_pairs(s: _Stretch) -> np.ndarray:
        hashes, both = neighbours(s)
        both[: max(0, s.lead - 1)] = False
        return hashes[both]

    pairs = sc.broadcast(filter_of(staged(_often(texts, longest, block, least, frequent_pairs))).tobytes())

    def edges_and_ends(s: _Stretch):
        if not s.n:
            return
        yield 0, {b"": s.n - s.lead}
        often = passes(np.frombuffer(words.value, np.uint8), s.singles())
        linked = np.zeros(s.n, bool)  # to the next word
        hashes, both = neighbours(s)
        linked[:-1] = both & passes(np.frombuffer(pairs.value, np.uint8), hashes)
        at = np.arange(s.n)
        begins = np.concatenate([[True], ~linked[:-1]])
        length = at - np.maximum.accumulate(np.where(begins, at, 0)) + 1  # words of the stretch up to here
        slice_ = s.words.slice
        yield longest, [slice_(i - longest + 1, i) for i in np.flatnonzero(length >= longest).tolist()]
        ends = ~linked & often
        ends[: max(0, s.lead - 1)] = False
        if s.more:
            ends[-1] = False
        shown = np.minimum(length, longest - 1)
        for k in range(1, longest):
            yield k, [slice_(i - k + 1, i) for i in np.flatnonzero(ends & (shown == k)).tolist()]

    return staged(_counted(texts, longest, block, held, edges_and_ends))


def flow(graph: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``lang, words, phrase, f, into, out`` of every phrase with ``f >= least``: its occurrences and its heaviest edges on both sides.

    Level by level from the longest: what leaves a node and what ends there make its occurrences.
    """
    nothing = F.lit(0).cast("long")

    def rows(of: DataFrame, phrase, f, into, out, ended) -> DataFrame:
        return of.select("lang", phrase.alias("phrase"), f.alias("f"), into.alias("into"), out.alias("out"), ended.alias("ended"))

    f, whole = F.col("f"), F.col("phrase")
    level = rows(graph.where(F.col("words") == longest), whole, f, nothing, nothing, nothing)
    found = level.where(f >= least).drop("ended").withColumn("words", F.lit(longest))
    for k in range(longest - 1, 0, -1):
        first, last = _part("phrase", k, False), _part("phrase", k, True)
        # An edge leaves its first node and arrives at its last; a stretch that ended further up ends here as well.
        parts = [rows(level, first, f, nothing, f, nothing), rows(level.where(f >= least), last, nothing, f, nothing, nothing),
                 rows(graph.where(F.col("words") == k), whole, f, nothing, nothing, f)]
        if k < longest - 1:
            parts.append(rows(level.where("ended > 0"), last, F.col("ended"), nothing, nothing, F.col("ended")))
        level = reduce(DataFrame.unionAll, parts).groupBy("lang", "phrase").agg(
            F.sum("f").alias("f"), F.max("into").alias("into"), F.max("out").alias("out"), F.sum("ended").alias("ended"))
        if k > 1:
            level = staged(level)
        found = found.unionByName(level.where(f >= least).drop("ended").withColumn("words", F.lit(k)))
    return found


def compact(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``lang, path, f``: the frequent edges, those along unary nodes joined into one path (an array of words).

    A node is unary if one edge brings all its occurrences and one takes all on. Edges find the head of their path by
    pointer doubling, in as many rounds as the longest path has binary digits. There are no rings: a text ends.
    """
    node = counts.where((F.col("words") == longest - 1) & (F.col("into") == F.col("f")) & (F.col("out") == F.col("f")))
    node = node.select(F.col("lang").alias("l"), F.col("phrase").alias("node"), F.col("f").alias("flow"))
    edges = counts.where(F.col("words") == longest).select("lang", "phrase", "f")
    before = F.substring_index("phrase", " ", longest - 1)
    tail = _part("phrase", longest - 1, True)
    # The edge that brings the flow into an edge's first node, where that node is unary.
    brings = edges.join(node, (F.col("lang") == F.col("l")) & (tail == F.col("node")) & (F.col("f") == F.col("flow"))).select(
        F.col("l"), "node", F.col("phrase").alias("prior"))
    state = staged(edges.join(brings, (F.col("lang") == F.col("l")) & (before == F.col("node")), "left").select(
        "lang", "phrase", "f", F.coalesce("prior", "phrase").alias("jump"), F.col("prior").isNotNull().cast("long").alias("steps"),
        F.col("prior").isNull().alias("done")))
    while state.where("not done").limit(1).count():
        there = state.select(F.col("lang").alias("l"), F.col("phrase").alias("at"), F.col("jump").alias("on"), F.col("steps").alias("more"),
                             F.col("done").alias("over"))
        moved = state.where("not done").join(there, (F.col("lang") == F.col("l")) & (F.col("jump") == F.col("at"))).select(
            "lang", "phrase", "f", F.col("on").alias("jump"), (F.col("steps") + F.col("more")).alias("steps"), F.col("over").alias("done"))
        state = staged(state.where("done").unionByName(moved))
    paths = state.groupBy("lang", F.col("jump").alias("head")).agg(
        F.max("f").alias("f"), F.array_sort(F.collect_list(F.struct("steps", _part("phrase", 1, True).alias("word")))).alias("tail"))
    first = F.split(F.substring_index("head", " ", longest - 1), " ")
    return paths.select("lang", F.concat(first, F.col("tail.word")).alias("path"), "f")


def _scored(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` by the lowest-scoring cut, the first of equal ones."""
    cut = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    # A single word may be part of a large share of all phrases: its count stands in several places.
    salts = F.when(F.col("words") == 1, F.lit(SALTS)).otherwise(F.lit(1))
    parts = counts.select("lang", "phrase", "f", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))

    def with_count(rows: DataFrame, part: str, words: Column, name: str) -> DataFrame:
        salt = F.when(words == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
        side = parts.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("salt").alias("_salt"), F.col("f").alias(name))
        return rows.withColumn("_s", salt).join(
            side, (F.col("lang") == F.col("_l")) & (F.col(part) == F.col("_p")) & (F.col("_s") == F.col("_salt"))).drop("_l", "_p", "_salt", "_s")

    cut = with_count(with_count(cut, "left", F.col("k"), "l"), "right", F.col("words") - F.col("k"), "r").join(totals, "lang")
    wide = "cast({} as decimal(16, 0))".format
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    best = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("x"))
    return best.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST,
         block: int = BLOCK_BYTES, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """Phrases ``lang, phrase, a, l, r, n, score`` and paths ``lang, path, f``.

    Phrases have 2 to ``longest`` words and ``least`` occurrences or more; those that only occur within an equally frequent longer
    one are left out. The paths are the frequent longest grams, joined where nothing branches off, so they show whole repeated
    passages. Null texts are empty, a null language is ``und``; repeated rows count as often as they stand there;
    texts are read whole; empty tables give no rows; other columns play no part. Counts up to 10^16 are exact.
    """
    if longest < 2:
        raise ValueError("phrases have two words or more")
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    graph = grams(texts, longest, least, block, held)
    totals = graph.where("words = 0").select("lang", F.col("f").alias("n"))
    counts = staged(flow(graph, longest, least))
    paths = staged(compact(counts, longest))
    window = F.expr(f"transform(sequence(0, size(path) - {longest}), i -> array_join(slice(path, i + 1, {longest}), ' '))")
    long = paths.select("lang", F.explode(window).alias("phrase"), "f", F.lit(longest).alias("words"))
    short = counts.where((F.col("words") > 1) & (F.col("words") < longest) & (F.greatest("into", "out") < F.col("f")))
    candidates = long.unionByName(short.select("lang", "phrase", "f", "words"))
    return _scored(candidates, counts.where(F.col("words") < longest), totals), paths


def ranked(phrases: DataFrame, k: int = 2000, groups: int = SALTS) -> DataFrame:
    """The first ``k`` of each language with their ``rank``: by score, occurrences, then phrase; in two steps, so that no task sorts all."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(groups))
    some = phrases.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    some = some.where(F.col("rank") <= k).drop("_part", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= k)
