"""Vector search, keyword search with cover-density ranking, and the two ways of merging ranked lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewarden.functions.running import RunningBest
from sitewarden.functions.text import WHITESPACE, present, round_half_even, strip, words
from sitewarden.functions.vector import stacked, top_k

# Fixed values of the search.
VECTOR_K, VECTOR_THRESHOLD = 5, 0.4
KEYWORD_K = 3
REPORT_HITS = 20
RRF_K = 60
UNTITLED = "Без названия"
POSITION_WEIGHT = 0.1  # weight of an unlabelled word position in cover-density ranking

_CHUNKS_PER_BLOCK, _QUERIES_PER_BLOCK = 20_000, 512
#: Blocks of queries, scored one after the other, that meet a block of chunks at once: a chunk is shuffled once for all of them.
_QUERY_BLOCKS_PER_MEETING = 16
#: What travels to every task at most: numbers of query vectors (32 MB), and words of queries. Beyond it rows are shuffled.
MOST_QUERY_NUMBERS, MOST_QUERY_TERMS = 4_000_000, 200_000


# --- whitelist and routing ---------------------------------------------------------------------------------------


def whitelist(documents: DataFrame) -> DataFrame:
    return documents.where(present(F.col("doc_id"))).select("doc_id").distinct()


def restrict(chunks: DataFrame, allow: DataFrame | None) -> DataFrame:
    return chunks if allow is None else chunks.join(whitelist(allow), "doc_id", "left_semi")


# --- vectors -------------------------------------------------------------------------------------------------------


def top_per_query(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits per query with their rank from 1; the limit is applied before and after the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("row_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _hit_schema(chunks: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("row_id", chunks.schema["row_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def wire_kind(df: DataFrame, column: str) -> tuple[str, pa.DataType]:
    """How an id leaves a task: whole numbers as long, others as text."""
    whole = isinstance(df.schema[column].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    return ("long", pa.int64()) if whole else ("string", pa.string())


def typed_ids(found: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids in their own types again."""
    return found.withColumns({
        "query_id": F.col("query_id").cast(queries.schema["query_id"].dataType), "row_id": F.col("row_id").cast(chunks.schema["row_id"].dataType)})


def _best_in_tasks(base: DataFrame, queries: DataFrame, asked: list, k: int, threshold: float | None) -> DataFrame:
    """The k best rows of each task for each query; the chunks stay where they are, the queries travel."""
    ids = [r.query_id for r in asked]
    (query_kind, query_type), (row_kind, row_type) = wire_kind(queries, "query_id"), wire_kind(base, "row_id")
    shared = base.sparkSession.sparkContext.broadcast(stacked([r.embedding for r in asked]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, vectors = RunningBest(k), shared.value
        for batch in batches:
            rows = batch.column("row_id").to_numpy(zero_copy_only=False)
            lengths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            if len(lengths) and (lengths != vectors.shape[1]).any():
                raise ValueError("vectors differ in length")
            offered = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
            for a in range(0, len(ids), _QUERIES_PER_BLOCK):
                found = top_k(np.arange(a, min(len(ids), a + _QUERIES_PER_BLOCK)), vectors[a : a + _QUERIES_PER_BLOCK], rows, offered, k, threshold)
                best.take(found[0], found[2], found[1])
        if len(best.query):
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[q] for q in best.query.tolist()], query_type), pa.array(best.id, row_type), pa.array(best.score)],
                names=["query_id", "row_id", "score"])

    return typed_ids(base.mapInArrow(run, f"query_id {query_kind}, row_id {row_kind}, score double"), queries, base)


def _blocks(base: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and queries once per block of the other side, with their blocks ``cb`` and ``qb``."""

    def number(df: DataFrame, size: int) -> Column:
        return df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias("n")).scalar()

    chunk_blocks, query_blocks = number(base, _CHUNKS_PER_BLOCK), number(asked, _QUERIES_PER_BLOCK * _QUERY_BLOCKS_PER_MEETING)

    def block(df: DataFrame, id_column: str, own: str, n_own: Column, other: str, n_other: Column) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(id_column), n_own).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), n_other - 1)))

    return block(base, "row_id", "cb", chunk_blocks, "qb", query_blocks), block(asked, "query_id", "qb", query_blocks, "cb", chunk_blocks)


def _best_of_blocks(base: DataFrame, asked: DataFrame, k: int, threshold: float | None, schema: T.StructType) -> DataFrame:
    """The same for any number of queries: blocks of chunks meet blocks of queries, each of limited size."""
    left, right = _blocks(base, asked)

    def search(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or wanted.empty:
            return pd.DataFrame({"query_id": [], "row_id": [], "score": []})
        ids, vectors = wanted["query_id"].to_numpy(), stacked(wanted["embedding"])
        row_ids, offered = rows["row_id"].to_numpy(), stacked(rows["embedding"])
        found = [
            pd.DataFrame(dict(zip(("query_id", "row_id", "score"), top_k(ids[a : a + _QUERIES_PER_BLOCK], vectors[a : a + _QUERIES_PER_BLOCK], row_ids, offered, k, threshold))))
            for a in range(0, len(ids), _QUERIES_PER_BLOCK)
        ]
        return pd.concat(found, ignore_index=True)

    return left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(search, schema)


def vector_search(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = VECTOR_K,
    threshold: float | None = VECTOR_THRESHOLD,
    allow: DataFrame | None = None,
    most_numbers: int = MOST_QUERY_NUMBERS,
) -> DataFrame:
    """Exact cosine search of many queries at once: ``query_id, row_id, score, rank``.

    ``chunks`` has ``row_id, embedding`` (and ``doc_id`` with a whitelist), ``queries`` has ``query_id, embedding``.
    Null and zero vectors never match. Query vectors of at most ``most_numbers`` numbers in all (counted first) travel to the
    tasks, each of which leaves its k best per query; more of them meet the chunks in blocks.
    """
    base = restrict(chunks, allow).where(F.col("embedding").isNotNull() & F.col("row_id").isNotNull()).select("row_id", "embedding")
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    schema = _hit_schema(chunks, queries)
    size = asked.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0]
    if size <= most_numbers:
        held = asked.collect()
        met = _best_in_tasks(base, queries, held, k, threshold) if held else chunks.sparkSession.createDataFrame([], schema)
    else:
        met = _best_of_blocks(base, asked, k, threshold, schema)
    return top_per_query(met, k)


def vector_search_section(chunks: DataFrame, queries: DataFrame, section: str | None = None, k: int = 10) -> DataFrame:
    """Act-chunk search, optionally within one section; no threshold."""
    if section:
        chunks = chunks.where(F.col("section_type") == section)
    return vector_search(chunks, queries, k=k, threshold=None)


# --- keywords ------------------------------------------------------------------------------------------------------


def _stopped(terms: Column, stop_words: Sequence[str]) -> Column:
    return F.array_except(terms, F.array(*[F.lit(w) for w in stop_words])) if stop_words else F.array_distinct(terms)


def or_terms(query: Column, stop_words: Sequence[str] = (), short_words: int | None = None) -> Column:
    """Words of the raw query longer than two characters, as distinct terms.

    A query of shorter words only keeps all of them, or the first ``short_words``.
    """
    raw = F.filter(F.split(query, WHITESPACE), lambda w: w != "")
    long = F.filter(raw, lambda w: F.length(w) > 2)
    chosen = F.when(F.size(long) > 0, long).otherwise(raw if short_words is None else F.slice(raw, 1, short_words))
    return _stopped(words(F.array_join(chosen, " ")), stop_words)


def and_terms(query: Column, stop_words: Sequence[str] = ()) -> Column:
    return _stopped(words(query), stop_words)


class _AskedTerms:
    """The terms of a set of queries, and which queries hold each."""

    def __init__(self, pairs: list):
        self.queries = list(dict.fromkeys(p.query_id for p in pairs))
        number = {q: i for i, q in enumerate(self.queries)}
        self.terms = sorted({p.term for p in pairs})
        place = {t: i for i, t in enumerate(self.terms)}
        term, query = np.array([place[p.term] for p in pairs], np.int64), np.array([number[p.query_id] for p in pairs], np.int64)
        self.holders = query[np.argsort(term, kind="stable")]
        self.degree = np.bincount(term, minlength=len(self.terms))
        self.begin = np.cumsum(self.degree) - self.degree
        self.needed = np.bincount(query, minlength=len(self.queries))

    def places(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, position and term of every asked word in a list column."""
        sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        term = pc.index_in(tokens.flatten(), pa.array(self.terms, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        position = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        asked = term >= 0
        return row[asked], position[asked], term[asked].astype(np.int64)

    def by_query(self, row: np.ndarray, term: np.ndarray, of_row: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Row, query, words and distinct words of every row that holds a word of a query; a limited number of rows at once."""
        pair, tf = np.unique(row * len(self.terms) + term, return_counts=True)
        row, term = pair // len(self.terms), pair % len(self.terms)
        load = np.cumsum(self.degree[term])
        while len(row):
            end = max(1, int(np.searchsorted(load, load[0] - self.degree[term[0]] + of_row, "right")))
            end = int(np.searchsorted(row, row[end - 1], "right"))  # whole rows
            r, t, n = row[:end], term[:end], tf[:end]
            times = self.degree[t]
            query = self.holders[np.repeat(self.begin[t] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
            cell, back = np.unique(np.repeat(r, times) * len(self.queries) + query, return_inverse=True)
            yield cell // len(self.queries), cell % len(self.queries), np.bincount(back, np.repeat(n, times)).astype(np.int64), np.bincount(back)
            row, term, tf, load = row[end:], term[end:], tf[end:], load[end:]


def _few(asked: DataFrame, most: int) -> list | None:
    """The rows of a small table (more than ``most`` are not fetched), else null."""
    rows = asked.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def keyword_or(
    chunks: DataFrame, queries: DataFrame, k: int = KEYWORD_K, allow: DataFrame | None = None, stop_words: Sequence[str] = (),
    most_terms: int = MOST_QUERY_TERMS,
) -> DataFrame:
    """Chunks with any term of a query, best first: ``query_id, row_id, score, rank``.

    With alternatives every occurrence is its own minimal cover, so the cover density is the weight of a position
    times the number of occurrences. Up to ``most_terms`` terms travel to the tasks, which count them in the rows and leave k rows per
    query, so no word is shuffled. With more, words that no query asks for go first and the rest is counted per chunk
    and term before it meets the queries. ``operators.postings`` has the search in a stored index.
    """
    terms = queries.select("query_id", F.explode(or_terms(F.col("query"), stop_words)).alias("term"))
    texts = restrict(chunks, allow).where(F.col("row_id").isNotNull())
    held = _few(terms, most_terms)
    if held is None:
        counts = (
            texts.select("row_id", F.explode(words(F.col("chunk"))).alias("term"))
            .join(terms.select("term").distinct(), "term", "left_semi")
            .groupBy("row_id", "term")
            .agg(F.count(F.lit(1)).alias("tf"))
        )
        found = counts.join(terms, "term").groupBy("query_id", "row_id").agg(F.sum("tf").alias("n"))
    else:
        shared = _AskedTerms(held)
        (query_kind, query_type), (row_kind, row_type) = wire_kind(queries, "query_id"), wire_kind(chunks, "row_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = RunningBest(k)
            for batch in batches:
                ids = batch.column("row_id").to_numpy(zero_copy_only=False)
                row, _, term = shared.places(batch.column("tokens"))
                for r, q, n, _ in shared.by_query(row, term):
                    best.take(q, n, ids[r])
            if len(best.query):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shared.queries[q] for q in best.query.tolist()], query_type), pa.array(best.id, row_type),
                     pa.array(best.score.astype(np.int64))], names=["query_id", "row_id", "n"])

        found = texts.select("row_id", words(F.col("chunk")).alias("tokens"))
        found = typed_ids(found.mapInArrow(run, f"query_id {query_kind}, row_id {row_kind}, n long"), queries, chunks)
    hits = found.select("query_id", "row_id", F.round(F.col("n") * F.lit(POSITION_WEIGHT), 6).alias("score"))
    return top_per_query(hits, k)


def cover_density(matched: Column, terms: Column) -> Column:
    """Sum over minimal windows holding all ``terms`` of ``weight / (1 + words inside that are no terms)``.

    ``matched`` are the places of terms, in order: structs of ``pos`` and ``term`` (its place in ``terms``, from 1).
    """
    entries = F.transform(matched, lambda m, i: F.struct(i.alias("at"), m["pos"].alias("pos"), m["term"].alias("term")))
    unseen = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("pos"))
    start = F.struct(
        F.transform(terms, lambda _: unseen).alias("last"), F.lit(-1).alias("begin"), F.lit(0.0).alias("density")
    )

    def step(state: Column, entry: Column) -> Column:
        here = F.struct(entry["at"].alias("at"), entry["pos"].alias("pos"))
        last = F.transform(state["last"], lambda old, i: F.when(i + 1 == entry["term"], here).otherwise(old))
        first = F.array_min(last)
        # A window is minimal when its first word is new: an earlier end had no window starting here.
        opens = (first["at"] >= 0) & (first["at"] > state["begin"])
        noise = (entry["pos"] - first["pos"]) - (entry["at"] - first["at"])
        gain = F.when(opens, F.lit(POSITION_WEIGHT) / (F.lit(1) + noise)).otherwise(F.lit(0.0))
        return F.struct(
            last.alias("last"),
            F.when(opens, first["at"]).otherwise(state["begin"]).alias("begin"),
            (state["density"] + gain).alias("density"),
        )

    return F.aggregate(entries, start, step, lambda s: s["density"])


def _cover_density(tokens: Column, terms: Column) -> Column:
    indexed = F.transform(tokens, lambda t, i: F.struct(i.alias("pos"), F.array_position(terms, t).cast("int").alias("term")))
    return cover_density(F.filter(indexed, lambda m: m["term"] > 0), terms)


def keyword_and(
    chunks: DataFrame, queries: DataFrame, k: int = KEYWORD_K, allow: DataFrame | None = None, stop_words: Sequence[str] = (),
    most_terms: int = MOST_QUERY_TERMS,
) -> DataFrame:
    """Chunks with all terms of a query, ranked by cover density: ``query_id, row_id, score, rank``.

    Up to ``most_terms`` terms travel to the tasks; a row that holds all of a query leaves with the places of its terms. With more, a chunk
    meets the queries whose longest term it holds, which replaces the chunk-by-query product.
    """
    terms = and_terms(F.col("query"), stop_words)
    texts = restrict(chunks, allow).where(F.col("row_id").isNotNull()).select("row_id", "chunk")
    held = _few(queries.select("query_id", F.explode(terms).alias("term")), most_terms)
    if held is None:
        return top_per_query(_by_anchor(texts, queries, terms), k)
    shared = _AskedTerms(held)
    (query_kind, query_type), (row_kind, row_type) = wire_kind(queries, "query_id"), wire_kind(chunks, "row_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("pos", pa.int32()), ("term", pa.int32())])
        for batch in batches:
            row, position, term = shared.places(batch.column("tokens"))
            for r, q, _, distinct in shared.by_query(row, term):
                full = np.flatnonzero(distinct == shared.needed[q])
                out = []
                for i in full.tolist():
                    a, b = np.searchsorted(row, [r[i], r[i] + 1])
                    of_query = np.array([t for t in np.unique(term[a:b]) if q[i] in shared.holders[shared.begin[t] : shared.begin[t] + shared.degree[t]]])
                    number = np.searchsorted(of_query, term[a:b])
                    mine = of_query[np.minimum(number, len(of_query) - 1)] == term[a:b]
                    out.append([{"pos": p, "term": n + 1} for p, n in zip(position[a:b][mine].tolist(), number[mine].tolist())])
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shared.queries[x] for x in q[full].tolist()], query_type), batch.column("row_id").take(pa.array(r[full])).cast(row_type),
                         pa.array(out, pa.list_(place)), pa.array(shared.needed[q[full]].astype(np.int32))], names=["query_id", "row_id", "places", "n"])

    shape = f"query_id {query_kind}, row_id {row_kind}, places array<struct<pos: int, term: int>>, n int"
    found = typed_ids(texts.select("row_id", words(F.col("chunk")).alias("tokens")).mapInArrow(run, shape), queries, chunks)
    score = F.round(cover_density(F.col("places"), F.sequence(F.lit(1), F.col("n"))), 6)
    return top_per_query(found.select("query_id", "row_id", score.alias("score")), k)


def _by_anchor(texts: DataFrame, queries: DataFrame, terms: Column) -> DataFrame:
    """Rows that hold all terms of a query, found by the query's longest term; the others are tested against the whole text."""
    by_length = F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    asked = queries.select("query_id", terms.alias("terms"), by_length[0]["t"].alias("anchor")).where(
        F.size("terms") > 0
    )
    # First only ids meet the anchors; the text is tokenised again for the few chunks that hold one.
    pairs = (
        texts.select("row_id", F.explode(F.array_distinct(words(F.col("chunk")))).alias("anchor"))
        .join(asked.select("query_id", "anchor"), "anchor")
        .drop("anchor")
    )
    anchored = (
        texts.join(pairs, "row_id")
        .join(asked.drop("anchor"), "query_id")
        .withColumn("tokens", words(F.col("chunk")))
        .where(F.size(F.array_except("terms", "tokens")) == 0)
    )
    return anchored.select(
        "query_id", "row_id", F.round(_cover_density(F.col("tokens"), F.col("terms")), 6).alias("score")
    )


# --- merging -------------------------------------------------------------------------------------------------------


def with_metadata(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds title, link and act types by document id; documents without metadata stay with nulls."""
    meta = metadata.select(F.col("id").alias("doc_id"), "title", "link", "act_types")
    return hits.join(meta, "doc_id", "left")


def search_tags(tags: DataFrame) -> DataFrame:
    """Distinct trimmed tags in first-seen order; ``tags`` has ``pos`` (violations before causes) and ``tag``."""
    cleaned = tags.select("pos", strip(F.col("tag")).alias("tag")).where(present(F.col("tag")))
    return cleaned.groupBy("tag").agg(F.min("pos").alias("pos"))


def merge_hits(keyword: DataFrame, vector: DataFrame, n: int = REPORT_HITS) -> DataFrame:
    """Keyword hits before vector hits, each by query then rank; the first occurrence of a row stays, at most ``n``.

    Inputs have ``query_no, rank, row_id, score``; the result has ``place`` from 1.
    """
    both = keyword.select(F.lit(0).alias("source"), "query_no", "rank", "row_id", "score").unionByName(
        vector.select(F.lit(1).alias("source"), "query_no", "rank", "row_id", "score")
    )
    first = both.groupBy("row_id").agg(F.min(F.struct("source", "query_no", "rank", "score")).alias("f"))
    top = first.orderBy("f.source", "f.query_no", "f.rank", "row_id").limit(n)
    # At most n rows reach this window.
    place = F.row_number().over(Window.orderBy("f.source", "f.query_no", "f.rank", "row_id"))
    return top.select(place.alias("place"), "row_id", F.col("f.source").alias("source"), F.col("f.score").alias("score"))


def format_hits(hits: DataFrame) -> DataFrame:
    """Default title, score as a similarity of three places."""
    title = F.when(present(F.col("title")), F.col("title")).otherwise(F.lit(UNTITLED))
    return hits.withColumns({"document": title, "similarity": round_half_even(F.col("score"), 3)}).drop("title", "score")


def rrf(lists: DataFrame, k: int = RRF_K, n: int = 10) -> DataFrame:
    """Reciprocal rank fusion: ``lists`` has ``list_no, rank`` (from 0), ``key`` and ``payload``.

    The score is the sum of ``1 / (k + rank + 1)``; the payload comes from the first list that has the key, equal
    scores keep first-seen order. Terms are summed as decimals, so the order of arrival does not matter.
    """
    term = (F.lit(1.0) / (F.lit(k) + F.col("rank") + F.lit(1))).cast("decimal(28,18)")
    return (
        lists.groupBy("key")
        .agg(
            F.sum(term).cast("double").alias("score"),
            F.min(F.struct("list_no", "rank")).alias("seen"),
            F.min_by("payload", F.struct("list_no", "rank")).alias("payload"),
        )
        .orderBy(F.col("score").desc(), F.col("seen"))
        .limit(n)
        .select("key", "payload", "score")
    )
