"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("_m", "u").alias("_m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("_m"))
    joined = down.join(least, "u")
    return joined.select("u", F.col("_m").alias("v")).unionByName(
        joined.where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u``, ``v``: longs); the root is the least node of the component.

    Each round is written to the shared folder, so a lost executor never repeats earlier rounds. Minima are aggregated
    before the shuffle, and a node with very many neighbours is only ever the repeated side of a join.
    """
    edges = staged(edges.where("u <> v").select("u", "v").distinct())
    before = None
    while True:
        edges = staged(_small_star(_large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.expr("cast(xxhash64(u, v) as decimal(20, 0))"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
