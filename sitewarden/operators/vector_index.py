"""An inverted-file index of vectors: rows filed under the nearest of some centroids, searched exactly or with a number of probes.

Centroids come from Lloyd rounds over a bounded sample (``SAMPLE_NUMBERS`` numbers on the driver); every row is filed. A list keeps the widest
angle between its centroid and a row. The angle between a query and a row is at least the query's angle to the centroid
less that width, so after the nearest lists of a query are scored, lists whose bound lies below its k-th best score are left out and
the result is still exact. With ``probes`` only that many lists are read, and recall depends on the data.

A search reads the folders of the lists it needs; queries travel to the rows, and a task leaves k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewarden.functions.running import RunningBest
from sitewarden.functions.vector import stacked, unit_rows
from sitewarden.operators.retrieval import MOST_QUERY_NUMBERS, top_per_query, typed_ids, wire_kind

#: Most lists, Lloyd rounds, numbers of the sample, and lists (times k rows) that a query reads before its threshold is known.
MOST_LISTS, ROUNDS, SAMPLE_NUMBERS = 4096, 8, 8_000_000
_BLOCK = 4096


@dataclass(frozen=True)
class VectorIndex:
    folder: str
    centroids: np.ndarray
    sizes: np.ndarray
    widths: np.ndarray  # of angles

    @staticmethod
    def load(spark: SparkSession, folder: str) -> VectorIndex:
        rows = sorted(spark.read.parquet(f"{folder}/lists").collect(), key=lambda r: r.list)
        return VectorIndex(folder, np.array([r.centroid for r in rows]), np.array([r.size for r in rows]), np.array([r.width for r in rows]))


def _nearest(units: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each unit row and the cosine to it, block by block."""
    best, cosine = np.empty(len(units), np.int64), np.empty(len(units))
    for a in range(0, len(units), _BLOCK):
        scores = units[a : a + _BLOCK] @ centroids.T
        best[a : a + _BLOCK] = scores.argmax(axis=1)
        cosine[a : a + _BLOCK] = scores.max(axis=1)
    return best, cosine


def lloyd(units: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit rows: a spread start, then rounds of assignment and averaging; a list that empties keeps its place."""
    rng = np.random.default_rng(seed)
    centroids = units[rng.choice(len(units), min(lists, len(units)), replace=False)]
    for _ in range(rounds):
        best, _ = _nearest(units, centroids)
        total = np.zeros_like(centroids)
        np.add.at(total, best, units)
        moved, solid = unit_rows(total)
        centroids = np.where(solid[:, None], moved, centroids)
    return centroids


def build_index(chunks: DataFrame, folder: str, lists: int | None = None, rounds: int = ROUNDS, sample_numbers: int = SAMPLE_NUMBERS) -> VectorIndex:
    """File ``row_id, embedding`` (and any other column) of ``chunks`` below ``folder``; null and zero vectors are in no list.

    ``lists`` is the square root of the number of rows unless given, 4 096 at most.
    """
    spark = chunks.sparkSession
    rows = chunks.where(F.col("embedding").isNotNull() & F.col("row_id").isNotNull() & F.exists("embedding", lambda x: x != 0))
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    lists = max(1, min(MOST_LISTS, n, lists or round(n**0.5)))
    sample = rows.select("embedding").orderBy(F.xxhash64("row_id")).limit(max(1, sample_numbers // max(1, width or 1))).collect()
    units = unit_rows(stacked([r.embedding for r in sample]))[0] if sample else np.zeros((0, 1))
    centroids = lloyd(units, lists, rounds) if len(units) else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            if set(vectors.value_lengths().to_pylist()) - {shared.value.shape[1]}:
                raise ValueError("vectors differ in length")
            units = unit_rows(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1))[0]
            best, cosine = _nearest(units, shared.value)
            yield batch.append_column("angle", pa.array(np.arccos(np.clip(cosine, -1, 1)))).append_column("list", pa.array(best))

    shape = T.StructType(rows.schema.fields + [T.StructField("angle", T.DoubleType()), T.StructField("list", T.LongType())])
    filed = rows.mapInArrow(run, shape)
    filed.repartitionByRange("list", "row_id").write.partitionBy("list").parquet(f"{folder}/rows")
    sizes, widths = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in spark.read.schema(shape).parquet(f"{folder}/rows").groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("w")).collect():
        sizes[r["list"]], widths[r["list"]] = r["n"], r["w"]  # a row per list
    kept = [(i, c.tolist(), int(s), float(w)) for i, (c, s, w) in enumerate(zip(centroids, sizes, widths))]
    spark.createDataFrame(kept, "list long, centroid array<double>, size long, width double").write.parquet(f"{folder}/lists")
    spark.createDataFrame([], shape).write.parquet(f"{folder}/shape")
    return VectorIndex(folder, centroids, sizes, widths)


def _scan(index: VectorIndex, rows: DataFrame, queries: DataFrame, ids: list, units: np.ndarray, probed: np.ndarray, k: int) -> DataFrame:
    """The k best rows of each task and query among the lists that ``probed`` (query x list) marks."""
    needed = np.flatnonzero(probed.any(axis=0)).tolist()
    shared = rows.sparkSession.sparkContext.broadcast((units, {i: np.flatnonzero(probed[:, i]) for i in needed}))
    (query_kind, query_type), (row_kind, row_type) = wire_kind(queries, "query_id"), wire_kind(rows, "row_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, asking = shared.value
        best = RunningBest(k)
        for batch in batches:
            row_ids, of = batch.column("row_id").to_numpy(zero_copy_only=False), batch.column("list").to_numpy(zero_copy_only=False)
            offered = unit_rows(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(of), -1))[0]
            for i in np.unique(of).tolist():
                here, who = np.flatnonzero(of == i), asking[i]
                for a in range(0, len(who), 512):
                    some = who[a : a + 512]
                    scores = np.round(vectors[some] @ offered[here].T, 12)
                    if scores.shape[1] > k:
                        place = scores.shape[1] - k
                        least = np.partition(scores, place, axis=1)[:, place : place + 1]
                    else:
                        least = np.full((len(some), 1), -2.0)
                    q, r = np.nonzero(scores >= least)
                    best.take(some[q], scores[q, r], row_ids[here[r]])
        if len(best.query):
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[q] for q in best.query.tolist()], query_type), pa.array(best.id, row_type), pa.array(best.score)],
                names=["query_id", "row_id", "score"])

    wanted = rows.where(F.col("list").isin(needed or [-1])).select("row_id", "embedding", "list")
    return typed_ids(wanted.mapInArrow(run, f"query_id {query_kind}, row_id {row_kind}, score double"), queries, rows)


def search_index(index: VectorIndex, queries: DataFrame, k: int = 10, section: str | None = None, probes: int | None = None,
                 most_numbers: int = MOST_QUERY_NUMBERS) -> tuple[DataFrame, float]:
    """``query_id, row_id, score, rank`` by cosine, and the share of (query, row) pairs that were scored.

    Exact unless ``probes`` limits the lists of a query. ``section`` keeps rows of one ``section_type``. Queries go in blocks of
    ``most_numbers`` numbers.
    """
    spark = queries.sparkSession
    shape = spark.read.parquet(f"{index.folder}/shape").schema
    rows = spark.read.schema(shape).parquet(f"{index.folder}/rows")
    if section:
        rows = rows.where(F.col("section_type") == section)
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    total = asked.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // most_numbers))
    out, scored, n_queries = None, 0, 0
    for number in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).collect()
        if not held or not len(index.centroids):
            continue
        units, solid = unit_rows(stacked([r.embedding for r in held]))
        ids, units = [r.query_id for r, ok in zip(held, solid) if ok], units[solid]
        if not ids:
            continue
        angles = np.arccos(np.clip(units @ index.centroids.T, -1, 1))
        reach = np.cos(np.maximum(0.0, angles - index.widths))  # no row of the list is nearer
        order = np.argsort(angles, axis=1, kind="stable")
        ahead = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]  # rows of nearer lists
        early = np.arange(order.shape[1])[None, :] < probes if probes else ahead < k
        first = np.zeros(order.shape, bool)
        np.put_along_axis(first, order, np.broadcast_to(early, order.shape), axis=1)
        first &= index.sizes > 0
        hits = _scan(index, rows, queries, ids, units, first, k)
        scored, n_queries = scored + int((first * index.sizes).sum()), n_queries + len(ids)
        if not probes:
            found = top_per_query(hits, k)
            path = f"{index.folder}/first-{number}-{spark.sparkContext.applicationId}"
            found.write.mode("overwrite").parquet(path)
            hits = spark.read.schema(found.schema).parquet(path)
            place, needed = {q: i for i, q in enumerate(ids)}, np.full(len(ids), -2.0)
            for r in hits.where(F.col("rank") == k).select("query_id", "score").collect():  # one row per query of the block
                needed[place[r.query_id]] = r.score
            later = (reach >= needed[:, None] - 1e-9) & ~first & (index.sizes > 0)
            scored += int((later * index.sizes).sum())
            hits = hits.drop("rank")
            if later.any():
                hits = hits.unionByName(_scan(index, rows, queries, ids, units, later, k))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        types = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("row_id", shape["row_id"].dataType), T.StructField("score", T.DoubleType())]
        out = spark.createDataFrame([], T.StructType(types))
    return top_per_query(out, k), scored / max(1, n_queries * int(index.sizes.sum()))
