"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors pseudo-randomly (three rounds of random signs and a fast Hadamard transform) and files each
under the nearest signed axis. A query looks into the buckets of its nearest axes in every table; what it meets there
is scored exactly, and the best of all tables are ranked. Rows are filed once per table, so the index holds every row.

Scale: buckets are dealt to tasks by a hash, and a bucket with many rows is split (its queries go to every part). A task
returns the k best of each query it saw, never pairs. Queries that met fewer than k rows then visit all buckets of the first
table, which holds every row once, so they are exact.

Rows are filed by direction, within ranges of their norm (powers of two), and every query looks into every range. In the ranges
above the fullest one a row needs a smaller angle less, so there a query also visits each axis whose coordinate times the
range's factor reaches the last axis it probes in the fullest range.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewarden.llm.common import staged

TABLES, PROBES, SEED = 8, 16, 7
#: Rows of a bucket that one task holds, and numbers of a score matrix.
BUCKET_ROWS, CELLS = 20_000, 2_000_000
#: Ranges of norms that are told apart, half of them below 1.
BANDS = 4096
#: Filed rows of one task, and the least number of tasks; a task returns k rows per query, so more tasks mean more rows to merge.
SHARD_ROWS, LEAST_SHARDS = 200_000, 12


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row (a power of two wide)."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def axis_scores(x: np.ndarray, tables: int, seed: int = SEED) -> list[np.ndarray]:
    """Per table: the rotated coordinates of each row and their negatives, one column per signed axis."""
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    rng, out = np.random.default_rng(seed), []
    for _ in range(tables):
        r = padded
        for _ in range(3):
            r = hadamard(r * rng.choice([-1.0, 1.0], width))
        out.append(np.concatenate([r, -r], axis=1))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; divided by their largest component first, whose square may be beyond double precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def products(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed left to right: equal vectors get equal scores."""
    total = np.zeros(len(q))
    for k in range(q.shape[1]):
        total += q[:, k] * b[:, k]
    return total


def best_pairs(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best distinct rows of each query: by score, then smaller id."""
    order = np.lexsort((row, -score, query))
    q, r = query[order], row[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (r[1:] != r[:-1])][: len(q)]
    order, q = order[new], q[new]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[place < k]


def _usable(vector: str) -> Column:
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(vector).isNotNull() & sound & F.exists(vector, lambda v: v != 0)


def usable(vectors: DataFrame, id_col: str, vector_col: str, dimension: int) -> DataFrame:
    """``id, vector`` of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    return rows.where(F.col("id").isNotNull() & (F.size("vector") == dimension)).where(_usable("vector"))


def _band(vector: str) -> Column:
    """The power of two nearest to the norm."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    most = BANDS // 2 - 1  # the log of an underflown norm is null
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce(F.round(F.log2(norm)), F.lit(-most)))).cast("int")


def _filed(rows: DataFrame, tables: int) -> DataFrame:
    """``id, vector, band, cell`` for the nearest axis of every table."""

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        scores = axis_scores(unit(np.stack(vectors.to_list()).astype(np.float64)), tables)
        return pd.Series(list(np.stack([s.argmax(axis=1) + t * s.shape[1] for t, s in enumerate(scores)], axis=1).astype(np.int32)))

    return rows.select("id", "vector", _band("vector").alias("band"), F.explode(cells("vector")).alias("cell"))


def _probed(rows: DataFrame, count: int, tables: int, above: int) -> DataFrame:
    """``id, vector, cell, least``: the axes of every table that a query visits, each in the ranges from ``least`` on, counted from
    the fullest range: the ``count`` nearest in all, others from where the factor makes up for their distance, ``above`` at most.
    """

    @F.pandas_udf("array<long>")
    def cells(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        found: list[list[np.ndarray]] = [[] for _ in range(len(vectors))]
        for t, scores in enumerate(axis_scores(unit(np.stack(vectors.to_list()).astype(np.float64)), tables)):
            order = np.argsort(-scores, axis=1, kind="stable")
            near = np.take_along_axis(scores, order, axis=1)
            last = near[:, min(count, near.shape[1]) - 1]
            for i in range(len(vectors)):
                n = max(count, int((near[i] * 2.0 ** min(above, 1000) >= last[i]).sum())) if last[i] > 0 else count
                least = np.full(len(order[i][:n]), -BANDS)
                least[count:] = np.ceil(np.log2(last[i] / near[i][count:n]))
                found[i].append((order[i][:n] + t * scores.shape[1]) * (4 * BANDS) + least + 2 * BANDS)
        return pd.Series([np.concatenate(x).astype(np.int64) for x in found])

    each = rows.select("id", "vector", F.explode(cells("vector")).alias("c"))
    return each.select("id", "vector", F.floor(F.col("c") / (4 * BANDS)).cast("int").alias("cell"),
                       (F.pmod("c", F.lit(4 * BANDS)) - 2 * BANDS).cast("int").alias("least"))


def search(queries: DataFrame, vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           tables: int = TABLES, probes: int = PROBES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` best rows found for each query, by inner product, ties to the smaller id.

    Each query gets ``k`` rows, or all there are if they are fewer.

    Vectors that are null, zero or hold a null or non-finite component take no part, on either side, nor do rows without
    id or with another length than most usable vectors have. A row with the query's id is its own and never its
    neighbour; rows that repeat an id count once, with their best score. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, id long, score double"
    lengths = vectors.where(_usable(vector_col)).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    base = usable(vectors, id_col, vector_col, lengths["d"])
    asked = usable(queries, id_col, vector_col, lengths["d"])
    bands = {r.band: r["count"] for r in base.groupBy(_band("vector").alias("band")).count().collect()}
    if not bands:
        return spark.createDataFrame([], schema)
    fullest = max(bands, key=lambda b: (bands[b], b))
    shards = max(LEAST_SHARDS, -(-sum(bands.values()) * tables // SHARD_ROWS))

    shard = F.pmod(F.xxhash64("cell", "band", "part"), F.lit(shards)).cast("int").alias("shard")

    def rank(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(found) or not len(wanted):
            return out
        here = {key: g.index.to_numpy() for key, g in found.groupby(["cell", "band", "part"])}
        ids, mat = found["id"].to_numpy(), np.stack(found["vector"].to_list()).astype(np.float64)
        q_ids, q_mat = wanted["id"].to_numpy(), np.stack(wanted["vector"].to_list()).astype(np.float64)
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for key, g in wanted.groupby(["cell", "band", "part"]):
            at = here.get(key)
            if at is None:
                continue
            members, own = mat[at], ids[at]
            step = max(1, CELLS // len(at))
            for lo in range(0, len(g), step):
                part = g.index.to_numpy()[lo : lo + step]
                scores = q_mat[part] @ members.T
                scores[q_ids[part][:, None] == own[None, :]] = -np.inf
                if len(at) > k:  # all that reach the k-th best, with room for rounding, are scored again below
                    least = np.partition(scores, len(at) - k, axis=1)[:, len(at) - k]
                    room = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
                    near = (scores >= (least - room)[:, None]) & np.isfinite(scores)
                else:
                    near = np.isfinite(scores)
                a, b = np.nonzero(near)
                exact = products(q_mat[part][a], members[b])
                keep = best_pairs(q_ids[part][a], own[b], exact, k)
                best.append((q_ids[part][a][keep], own[b][keep], exact[keep]))
        if not best:
            return out
        query, row, score = (np.concatenate(x) for x in zip(*best))
        keep = best_pairs(query, row, score, k)
        return pd.DataFrame({"query_id": query[keep], "id": row[keep], "score": score[keep]})

    def ranked(filed: DataFrame, visits: Callable[[DataFrame], DataFrame]) -> DataFrame:
        # At most tables x 2 x padded dimension rows for each range of norms, whatever the number of vectors: safe to broadcast.
        parts = filed.groupBy("cell", "band").agg(F.ceil(F.count(F.lit(1)) / bucket_rows).cast("int").alias("parts"))
        parts = parts.toDF("p_cell", "p_band", "parts")
        here = (F.col("cell") == F.col("p_cell")) & (F.col("band") == F.col("p_band"))
        rows = filed.join(F.broadcast(parts), here).select(
            "id", "vector", "cell", "band", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")).select("*", shard)
        probed = visits(F.broadcast(parts)).select(
            "id", "vector", F.col("p_cell").alias("cell"), F.col("p_band").alias("band"),
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("*", shard)
        met = rows.groupBy("shard").cogroup(probed.groupBy("shard")).applyInPandas(rank, "query_id long, id long, score double")
        once = met.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    meets = (F.col("cell") == F.col("p_cell")) & (F.col("p_band") - fullest >= F.col("least"))
    top = staged(ranked(_filed(base, tables), lambda parts: _probed(asked, probes, tables, max(bands) - fullest).join(parts, meets)))
    full = top.where(F.col("rank") == k).select("query_id")
    short = staged(asked.join(full, F.col("id") == F.col("query_id"), "left_anti"))
    if short.isEmpty():
        return top
    rest = ranked(_filed(base, 1), lambda parts: short.crossJoin(parts))
    return top.join(full, "query_id", "left_semi").select(top.columns).unionByName(rest)
