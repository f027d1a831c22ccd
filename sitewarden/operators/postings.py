"""A stored word index: blocks of postings per term, and ranked searches that read few of them.

Row ids are cut into windows of ``span`` consecutive ids. A block holds the rows of one window that have one term: their places in the
window, how often and where the term stands there, and the largest such number. Windows are the same for all terms, so
the blocks' maxima of a query's terms add up to a bound on the score of every row of a window. A search scores the
most promising windows of a query in full, takes the ``k``-th best score as a threshold, and reads no window whose bound lies below.

The texts of a window meet once and leave as blocks, so that no single occurrence of a word is shuffled; a search brings the blocks of
a window together once for all its queries (of a block of queries), which leave their best rows there.

Only the blocks of the asked terms are read: the index lies in folders by a hash of the term, sorted by term within.
Words are stemmed when the index is built, once per distinct word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewarden.functions.frames import computed_once
from sitewarden.functions.stemming import SIMPLE, search_term
from sitewarden.functions.text import words
from sitewarden.operators.retrieval import KEYWORD_K, POSITION_WEIGHT, and_terms, or_terms, top_per_query, whitelist
from sitewarden.session import staged

#: Consecutive row ids of a window, folders of an index, and windows of a query that are read before the threshold is known.
SPAN, BUCKETS, FIRST_WINDOWS = 1024, 64, 2
#: Windows whose blocks of a folder share a file, and queries that meet the blocks of a window at once.
WINDOWS_PER_FILE, QUERIES_PER_MEETING = 64, 4096
#: Words that are held before a part of a window's blocks is given off, and occurrences of blocks in one batch.
_MOST_WORDS, _MOST_MERGED = 1 << 22, 1 << 21


@dataclass(frozen=True)
class WordIndex:
    folder: str
    span: int
    config: str
    stop: tuple[str, ...] | None

    def blocks(self, spark: SparkSession) -> DataFrame:
        shape = "term string, window long, most int, at array<int>, tf array<int>, positions array<int>, bucket int"
        return spark.read.schema(shape).parquet(f"{self.folder}/blocks")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/rows")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


_PACKED = "at array<int>, tf array<int>, positions array<int>"


def _packed(block: np.ndarray, at: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array], np.ndarray]:
    """The blocks of some occurrences, in order: their numbers, their columns and their largest ``tf``.

    ``at`` and ``tf`` have an entry per row, ``positions`` holds those of all rows one after the other.
    """
    order = np.lexsort((position, block.astype(np.int64) * (int(at.max(initial=0)) + 1) + at))
    block, at, position = block[order], at[order], position[order]
    entry = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (at[1:] != at[:-1])][: len(block)])
    tf = np.diff(np.append(entry, len(block)))
    held = block[entry]
    first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]][: len(held)])
    listed = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))
    ends = np.append(first, len(entry))
    columns = {"at": listed(ends, at[entry]), "tf": listed(ends, tf), "positions": listed(np.append(entry[first], len(block)), position)}
    return held[first], columns, np.maximum.reduceat(tf, first) if len(first) else tf


def _word_blocks(rows: DataFrame) -> DataFrame:
    """``word, window`` and the columns of a block, of ``window, at, tokens`` in order of ``window``; a large window may give a word in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, n, held = None, 0, []

        def given() -> Iterator[pa.RecordBatch]:
            if n:
                coded = pa.concat_arrays([t for t, _, _ in held]).dictionary_encode()
                word, columns, _ = _packed(
                    coded.indices.to_numpy(zero_copy_only=False), np.concatenate([a for _, a, _ in held]), np.concatenate([p for _, _, p in held]))
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.take(pa.array(word)), pa.array(np.full(len(word), window, np.int64)), *columns.values()],
                    names=["word", "window", *columns])

        for batch in batches:
            windows, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("window", "at"))
            tokens = batch.column("tokens")
            sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            a = 0
            while a < len(sizes):
                same = int(np.searchsorted(windows, windows[a], "right"))
                full = int(np.searchsorted(ends, ends[a] - sizes[a] + _MOST_WORDS, "right"))
                b = max(a + 1, min(same, full))
                if windows[a] != window or n > _MOST_WORDS:
                    yield from given()
                    window, n, held = int(windows[a]), 0, []
                size = sizes[a:b]
                count = int(size.sum())
                position = np.arange(count) - np.repeat(np.cumsum(size) - size, size)
                held.append((tokens.slice(a, b - a).flatten(), np.repeat(at[a:b], size), position))
                n, a = n + count, b
        yield from given()

    return rows.mapInArrow(run, f"word string, window long, {_PACKED}")


def _merged(blocks: DataFrame) -> DataFrame:
    """One block per ``term`` and ``window`` of ``bucket, term, window`` in that order; parts of a block and the words of a stem become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def given(table: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Of some whole runs of equal keys, of which ``first`` are the beginnings."""
            if not len(first):
                return
            run_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(table))))
            at, tf, positions = (table.column(c) for c in ("at", "tf", "positions"))
            of_entry = np.repeat(run_of, at.value_lengths().to_numpy(zero_copy_only=False))
            times = tf.flatten().to_numpy(zero_copy_only=False)
            _, columns, most = _packed(
                np.repeat(of_entry, times), np.repeat(at.flatten().to_numpy(zero_copy_only=False), times), positions.flatten().to_numpy(zero_copy_only=False))
            keys = {c: table.column(c).take(pa.array(first)) for c in ("term", "window", "bucket")}
            out = {**keys, **columns, "most": pa.array(most.astype(np.int32))}
            yield pa.RecordBatch.from_arrays([out[c] for c in order], names=order)

        order = ["term", "window", "most", "at", "tf", "positions", "bucket"]
        for whole in batches:
            sizes = np.cumsum(whole.column("positions").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < len(whole):
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + _MOST_MERGED, "right")))
                batch = whole.slice(a, b - a)
                a = b
                if rest is not None:
                    batch = pa.RecordBatch.from_arrays(
                        [pa.concat_arrays([rest.column(c), batch.column(c)]) for c in batch.schema.names], names=batch.schema.names)
                code = batch.column("term").dictionary_encode().indices.to_numpy(zero_copy_only=False)
                window = batch.column("window").to_numpy(zero_copy_only=False)
                first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (window[1:] != window[:-1])])
                yield from given(batch.slice(0, int(first[-1])), first[:-1])
                rest = batch.slice(int(first[-1]))
        if rest is not None:
            yield from given(rest, np.zeros(1, np.int64))

    return blocks.mapInArrow(run, f"term string, window long, most int, {_PACKED}, bucket int")


def _terms_of(found: DataFrame, config: str, stop: Sequence[str] | None) -> DataFrame:
    """``word, term`` of the distinct words that are searched; a plain filter would take the stemming below the distinct, to every row."""
    return computed_once(found.distinct(), {"term": search_term(F.col("word"), config, stop)}).where("term is not null")


def build_index(chunks: DataFrame, folder: str, config: str = SIMPLE, stop: Sequence[str] | None = None, span: int = SPAN) -> WordIndex:
    """Write the index of ``row_id`` (whole numbers, one row each), ``doc_id`` and ``chunk`` below ``folder``.

    ``config`` is ``simple`` or ``russian`` (stems and stop words, see ``functions.stemming``); ``stop`` replaces the stop words. Rows without text
    are kept in the table of rows and have no postings.
    """
    kept = chunks.where(F.col("row_id").isNotNull()).select(F.col("row_id").cast("long").alias("row_id"), "doc_id", "chunk")
    window = F.floor(F.col("row_id") / span).cast("long")
    texts = kept.where("chunk <> ''").select(window.alias("window"), (F.col("row_id") - window * span).cast("int").alias("at"), "chunk")
    placed = texts.repartition("window").sortWithinPartitions("window", "at")
    found = _word_blocks(placed.select("window", "at", words(F.col("chunk")).alias("tokens")))
    if config == SIMPLE:
        named = found.withColumn("term", search_term(F.col("word"), config, stop)).where("term is not null").drop("word")
    else:
        found = staged(found)
        terms = staged(_terms_of(found.select("word"), config, stop))
        named = found.join(terms, "word").drop("word")
    # A term's blocks of some windows make a file of its folder, so no task writes all of a frequent term.
    filed = named.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.floor(F.col("window") / WINDOWS_PER_FILE))
    blocks = _merged(filed.sortWithinPartitions("bucket", "term", "window"))
    blocks.sortWithinPartitions("bucket", "term", "window").write.partitionBy("bucket").parquet(f"{folder}/blocks")
    kept.select("row_id", "doc_id").write.parquet(f"{folder}/rows")
    return WordIndex(folder, span, config, None if stop is None else tuple(stop))


def _asked(index: WordIndex, queries: DataFrame, terms: Column) -> DataFrame:
    """``query_id, term, bucket``: the terms a query is searched by."""
    asked = queries.select("query_id", F.explode(terms).alias("word")).select(
        "query_id", search_term(F.col("word"), index.config, index.stop).alias("term"))
    return staged(asked.where("term is not null").distinct().withColumn("bucket", _bucket(F.col("term"))))


def _needed(index: WordIndex, asked: DataFrame) -> DataFrame:
    """The blocks of the folders the asked terms may lie in: the filter prunes folders."""
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    return index.blocks(asked.sparkSession).where(F.col("bucket").isin(buckets or [-1]))


def _local_best(score: np.ndarray, at: np.ndarray, k: int | None, margin: float) -> np.ndarray:
    """Those of some rows of a window that may be among its ``k`` best: scores within ``margin`` of the last of them stay, equal ones too."""
    if k is None or len(at) <= k:
        return np.arange(len(at))
    return np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - margin)


def _any_term(found: list[tuple], span: int, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of occurrences of the rows with any of some terms: blocks of ``at, tf, positions``."""
    total = np.bincount(np.concatenate([at for at, _, _ in found]), np.concatenate([tf for _, tf, _ in found]), span)
    at = np.flatnonzero(total)
    at = at[_local_best(total[at], at, k, 0)]
    if k is not None:  # whole numbers: ties may be cut by the row
        at = at[np.lexsort((at, -total[at]))[:k]]
    return at, total[at]


def _density(position: np.ndarray, term: np.ndarray, n_terms: int) -> float:
    """As ``retrieval.cover_density``, of the places of ``n_terms`` terms in order."""
    place = np.arange(len(position))
    begin = np.full(len(position), len(position))
    for t in range(n_terms):
        begin = np.minimum(begin, np.maximum.accumulate(np.where(term == t, place, -1)))
    # A window is minimal when its first word is new: an earlier end had no window starting here.
    end = np.flatnonzero((begin >= 0) & (begin > np.r_[-1, begin[:-1]]))
    noise = (position[end] - position[begin[end]]) - (end - begin[end])
    return float(np.add.accumulate(POSITION_WEIGHT / (1 + noise))[-1])


def _all_terms(found: list[tuple], span: int, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and cover densities of the rows with all of some terms; a row is left out if its bound is below the ``k`` best found."""
    rows = np.flatnonzero(np.bincount(np.concatenate([at for at, _, _ in found]), minlength=span) == len(found))
    if not len(rows):
        return rows, np.zeros(0)
    parts, least = [], None
    for at, tf, positions in found:
        entry = np.searchsorted(at, rows)
        ends = np.cumsum(tf)
        parts.append((ends[entry] - tf[entry], ends[entry], positions))
        least = tf[entry] if least is None else np.minimum(least, tf[entry])
    # The rarest term's occurrences bound the number of minimal windows, so rows that may score most come first.
    order = np.argsort(-least, kind="stable")
    score, needed = np.full(len(rows), -1.0), []
    for i in order.tolist():
        if k is not None and len(needed) >= k and least[i] * POSITION_WEIGHT < needed[-1] - 1e-6:
            break
        position = np.concatenate([p[b[i] : e[i]] for b, e, p in parts])
        term = np.repeat(np.arange(len(parts)), [int(e[i] - b[i]) for b, e, _ in parts])
        sort = np.lexsort((term, position))
        score[i] = _density(position[sort], term[sort], len(parts))
        if k is not None:
            needed = sorted([*needed, score[i]], reverse=True)[:k]
    seen = np.flatnonzero(score >= 0)
    seen = seen[_local_best(score[seen], seen, k, 1e-6)]
    return rows[seen], score[seen]


def _scored(index: WordIndex, asked: DataFrame, blocks: DataFrame, windows: DataFrame, few: bool, k: int | None, rank: Callable) -> DataFrame:
    """``query_id, row_id, found`` of the rows of ``query_id, window``, the ``k`` best of a window at least; ``rank`` scores them.

    The blocks of a window meet its queries once per ``QUERIES_PER_MEETING`` of those. If the windows are ``few``, only asked blocks travel.
    """
    groups = asked.agg(F.greatest(F.lit(1), F.ceil(F.approx_count_distinct("query_id") / QUERIES_PER_MEETING)).cast("long").alias("n")).scalar()
    listed = asked.groupBy("query_id").agg(F.collect_list("term").alias("terms"))
    wanted = windows.join(listed, "query_id").withColumn("part", F.pmod(F.xxhash64("query_id"), groups))
    held = blocks.join(asked.select("term").distinct(), "term", "left_semi").select("term", "window", "at", "tf", "positions")
    meeting = F.col("part").alias("meeting")
    met = wanted.select("window", meeting, F.explode("terms").alias("term")) if few else wanted.select("window", meeting)
    held = held.join(met.distinct(), ["window", "term"] if few else ["window"])
    span, query_type = index.span, asked.schema["query_id"].dataType.simpleString()

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, at_of, score_of = [], [], []
        if len(rows) and len(queries):
            place = {t: i for i, t in enumerate(rows.column("term").to_pylist())}
            columns = [rows.column(c).combine_chunks() for c in ("at", "tf", "positions")]
            flat = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in columns]
            for i, terms in enumerate(queries.column("terms").to_pylist()):
                here = [place[t] for t in terms if t in place]
                if not here:
                    continue
                at, score = rank([tuple(v[o[j] : o[j + 1]] for o, v in flat) for j in here], span, k)
                ids.append(np.full(len(at), i))
                at_of.append(at)
                score_of.append(score)
        none = [np.zeros(0, np.int64)]
        window = queries.column("window")[0].as_py() if len(queries) else 0
        return pa.table({
            "query_id": queries.column("query_id").combine_chunks().take(pa.array(np.concatenate(ids or none))),
            "row_id": pa.array(np.concatenate(at_of or none).astype(np.int64) + window * span),
            "found": pa.array(np.concatenate(score_of or none).astype(np.float64))})

    return held.groupBy("window", "meeting").cogroup(wanted.groupBy("window", "part")).applyInArrow(search, f"query_id {query_type}, row_id long, found double")


def _pruned(index: WordIndex, bounds: DataFrame, scored, k: int, allow: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Hits, and ``bounds`` with ``read``: which windows of a query were read.

    ``bounds`` has ``query_id, window, bound``; ``scored`` gives ``query_id, row_id, score`` of the best rows of some of them (of all
    rows, if only allowed ones count).
    """
    spark = bounds.sparkSession
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "window")
    ranked = staged(bounds.withColumn("place", F.row_number().over(order)))

    def hits(some: DataFrame, few: bool) -> DataFrame:
        rows = scored(some.select("query_id", "window"), few, k if allow is None else None)
        if allow is None:
            return rows
        open_rows = index.rows(spark).join(whitelist(allow), "doc_id", "left_semi").select("row_id")
        return rows.join(open_rows, "row_id", "left_semi")

    first = staged(top_per_query(hits(ranked.where(F.col("place") <= FIRST_WINDOWS), True), k))
    reached = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("needed"))
    later = ranked.where(F.col("place") > FIRST_WINDOWS).join(reached, "query_id", "left")
    # Scores are rounded to six places, so a bound may lie that much below the score it bounds.
    later = later.withColumn("read", F.col("needed").isNull() | (F.col("bound") >= F.col("needed") - 1e-6))
    later = staged(later.select("query_id", "window", "bound", "read"))
    more = hits(later.where("read"), False)
    both = first.select("query_id", "row_id", "score").unionByName(more.select("query_id", "row_id", "score"))
    seen = ranked.where(F.col("place") <= FIRST_WINDOWS).select("query_id", "window", "bound", F.lit(True).alias("read")).unionByName(later)
    return top_per_query(both, k), seen


def search_any(index: WordIndex, queries: DataFrame, k: int = KEYWORD_K, allow: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with any term of a query, as ``retrieval.keyword_or`` ranks them: ``query_id, row_id, score, rank``; and the windows that were read."""
    asked = _asked(index, queries, or_terms(F.col("query")))
    blocks = _needed(index, asked)
    of_query = blocks.select("bucket", "term", "window", "most").join(asked, ["bucket", "term"])
    bounds = of_query.groupBy("query_id", "window").agg((F.sum("most") * F.lit(POSITION_WEIGHT)).alias("bound"))

    def scored(windows: DataFrame, few: bool, best: int | None) -> DataFrame:
        rows = _scored(index, asked, blocks, windows, few, best, _any_term)
        return rows.select("query_id", "row_id", F.round(F.col("found").cast("long") * F.lit(POSITION_WEIGHT), 6).alias("score"))

    return _pruned(index, bounds, scored, k, allow)


def search_all(index: WordIndex, queries: DataFrame, k: int = KEYWORD_K, allow: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with all terms of a query, ranked by cover density; else as ``search_any``."""
    asked = _asked(index, queries, and_terms(F.col("query")))
    counted = staged(asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms")))
    blocks = _needed(index, asked)
    of_query = blocks.select("bucket", "term", "window", "most").join(asked, ["bucket", "term"])
    # Every minimal window holds each term, so there are at most as many as the rarest term has places.
    met = of_query.groupBy("query_id", "window").agg(F.count(F.lit(1)).alias("met"), (F.min("most") * F.lit(POSITION_WEIGHT)).alias("bound"))
    bounds = met.join(counted, "query_id").where("met = n_terms").select("query_id", "window", "bound")

    def scored(windows: DataFrame, few: bool, best: int | None) -> DataFrame:
        rows = _scored(index, asked, blocks, windows, few, best, _all_terms)
        return rows.select("query_id", "row_id", F.round("found", 6).alias("score"))

    return _pruned(index, bounds, scored, k, allow)
