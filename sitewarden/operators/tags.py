"""Tag frequency over the array columns of the acts table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewarden.schemas import TAG_FIELDS


def _restrict(acts: DataFrame, incidents: DataFrame | Sequence | None) -> DataFrame:
    """Acts of the given incidents: a table with ``id`` is a semi-join, an id list is a literal test.

    An empty list means "no restriction", as does None.
    """
    if isinstance(incidents, DataFrame):
        return acts.join(incidents.select(F.col("id").alias("incident_id")), "incident_id", "left_semi")
    if incidents:
        return acts.where(F.col("incident_id").isin(list(incidents)))
    return acts


def tag_patterns(
    acts: DataFrame, field: str, n: int = 10, incidents: DataFrame | Sequence | None = None
) -> DataFrame:
    """The ``n`` most frequent tags of one column, counting every occurrence; ties by tag."""
    if field not in TAG_FIELDS:
        raise ValueError(f"unknown tag column {field!r}")
    return (
        _restrict(acts, incidents)
        .select(F.explode(field).alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("tag"))
        .limit(n)
    )


def tag_panel(acts: DataFrame, n: int = 10, incidents: DataFrame | Sequence | None = None) -> DataFrame:
    """``tag_patterns`` of all three columns from a single scan: ``field, tag, n, rank``."""
    tagged = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("tags")) for f in TAG_FIELDS])
    counts = (
        _restrict(acts, incidents)
        .select(F.explode(tagged).alias("t"))
        .select("t.field", F.explode("t.tags").alias("tag"))
        .groupBy("field", "tag")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("field").orderBy(F.col("n").desc(), F.col("tag"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
