"""Point-in-time and hierarchical queries over versioned norms; validity is ``[effective_from, effective_to)``."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewarden.functions.text import round_half_even
from sitewarden.operators.retrieval import vector_search
from sitewarden.session import staged

ACTIVE = "active"
ARTICLE, PARAGRAPHS = "article", ("paragraph", "subparagraph")
#: Versions or points of one norm in one range of days, as far as days divide them.
_PER_RANGE = 512


def _holds(day: Column) -> Column:
    end = F.col("effective_to")
    return (F.col("effective_from") <= day) & (end.isNull() | (end > day)) & (F.col("status") == ACTIVE)


def effective_at(df: DataFrame, day: datetime.date) -> DataFrame:
    return df.where(_holds(F.lit(day)))


def effective_on_days(df: DataFrame, days: list[datetime.date]) -> DataFrame:
    """One row per record and listed date it is in force on; the date list is part of the plan, not a join."""
    listed = F.array(*[F.lit(d) for d in sorted(set(days))])
    return df.withColumn("day", F.explode(F.filter(listed, lambda d: _holds(d))))


def current_version(versions: DataFrame) -> DataFrame:
    return versions.where(F.col("effective_to").isNull() & (F.col("status") == ACTIVE))


def version_at(versions: DataFrame, points: DataFrame, per_range: int = _PER_RANGE) -> DataFrame:
    """The versions in force per point; ``points`` has ``norm_id, language, day``.

    The days of a norm's points are cut into ranges, as many as its versions or points need at ``per_range`` each. A point lies in one range, a version in
    those it holds in, so a norm with very many of both is spread, and its versions meet only the points near them.
    """
    keys = ["norm_id", "language"]
    asked = points.where(F.col("day").isNotNull()).groupBy(*keys).agg(
        F.min("day").alias("_first"), F.max("day").alias("_last"), F.count(F.lit(1)).alias("_points"))
    held = versions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_versions"))
    ranges = F.ceil(F.greatest("_points", "_versions") / per_range)
    span = asked.join(held, keys).select(*keys, "_first", "_last", F.ceil((F.datediff("_last", "_first") + 1) / ranges).alias("_days"))
    number = lambda day: F.expr(f"datediff({day}, _first) div _days")
    last = F.least(F.coalesce(F.date_sub("effective_to", 1), "_last"), "_last")
    kept = versions.where(F.col("status") == ACTIVE).join(span, keys).withColumns(
        {"_from": F.greatest("effective_from", "_first"), "_to": last}).where("_from <= _to and effective_from is not null")
    kept = kept.withColumn("_range", F.explode(F.sequence(number("_from"), number("_to")))).drop("_first", "_last", "_days", "_from", "_to")
    placed = points.join(span, keys).withColumn("_range", number("day")).drop("_first", "_last", "_days")
    return kept.join(placed, [*keys, "_range"]).where(_holds(F.col("day"))).drop("_range")


def version_history(versions: DataFrame) -> DataFrame:
    """Versions numbered per norm, newest first."""
    order = Window.partitionBy("norm_id").orderBy(F.col("effective_from").desc(), F.col("version_id"))
    return versions.withColumn("place", F.row_number().over(order))


def norms_of_act(norms: DataFrame, acts: DataFrame) -> DataFrame:
    """Norms of the given acts by path."""
    return norms.join(acts.select(F.col("id").alias("npa_id")), "npa_id", "left_semi").orderBy("npa_id", "path")


def children(norms: DataFrame, parents: DataFrame) -> DataFrame:
    """Direct children of the given norms in their order."""
    keys = parents.select(F.col("id").alias("parent_id"))
    return norms.join(keys, "parent_id", "left_semi").orderBy("parent_id", "order_index", "id")


def by_level(types: DataFrame) -> DataFrame:
    return types.orderBy("hierarchy_level", "id")


def type_by_code(types: DataFrame, code: str) -> DataFrame:
    return types.where(F.col("code") == code)


def acts_of_type(acts: DataFrame, act_type: str) -> DataFrame:
    """Acts of one type in the order of their ids."""
    return acts.where(F.col("act_type") == act_type).orderBy("id")


def version_chunks(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks of the given versions in chunk order."""
    return chunks.join(versions.select("version_id"), "version_id", "left_semi").orderBy("version_id", "chunk_index")


def close_version(versions: DataFrame, closures: DataFrame) -> DataFrame:
    """Sets the end date of the versions named in ``closures`` (``version_id, effective_to``)."""
    ends = closures.select("version_id", F.col("effective_to").alias("new_end"), F.lit(True).alias("hit"))
    joined = versions.join(ends, "version_id", "left")
    end = F.when(F.col("hit"), F.col("new_end")).otherwise(F.col("effective_to"))
    return joined.withColumn("effective_to", end).drop("new_end", "hit")


def ancestors(norms: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Ancestors from the dotted path: ``id, ancestor_id, ancestor_depth``, root first by depth."""
    asked = norms if of is None else norms.join(of.select("id"), "id", "left_semi")
    parts = F.split(F.col("path"), r"\.")
    steps = asked.where(F.col("path").isNotNull()).select(
        "id", F.explode(F.slice(parts, 1, F.size(parts) - 1)).alias("ancestor_id")
    )
    known = norms.select(F.col("id").alias("ancestor_id"), F.col("depth").alias("ancestor_depth"))
    return steps.join(known, "ancestor_id").select("id", "ancestor_id", "ancestor_depth")


def _parents(norms: DataFrame) -> DataFrame:
    """``id, parent_id`` of norms whose parent exists; an orphan is a root."""
    links = norms.where(F.col("parent_id").isNotNull()).select("id", "parent_id").distinct()
    return staged(links.join(norms.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi").select("id", "parent_id"))


def rings(norms: DataFrame) -> DataFrame:
    """``id`` of the norms that are their own ancestors.

    Every link is doubled until it has more steps than there are norms: what still leads somewhere then leads into a ring, and the norms it
    leads to are the rings. Without a ring the links run out after as many rounds as the depth has binary digits.
    """
    pointers = _parents(norms)
    steps, most = 1, pointers.count()
    while steps <= most and pointers.limit(1).count():
        onward = pointers.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("_next"))
        pointers = staged(pointers.join(onward, "parent_id").select("id", F.col("_next").alias("parent_id")))
        steps *= 2
    return pointers.select(F.col("parent_id").alias("id")).distinct()


def ancestors_by_parent(norms: DataFrame) -> DataFrame:
    """Ancestors from ``parent_id`` alone: ``id, ancestor_id, distance``, for norms without a stored path.

    Links within a ring (see ``rings``) count as absent, as do parents that do not exist. Pairs of up to ``n`` steps are joined with those
    of exactly ``n`` to reach ``2 n``, so the rounds grow with the logarithm of the depth.
    """
    ring = staged(rings(norms))
    links = staged(_parents(norms).join(ring, "id", "left_anti"))
    reached = staged(links.select("id", F.col("parent_id").alias("ancestor_id"), F.lit(1).cast("long").alias("distance")))
    steps = 1
    while True:
        far = reached.where(F.col("distance") == steps).select("id", F.col("ancestor_id").alias("_via"))
        onward = reached.select(F.col("id").alias("_via"), "ancestor_id", "distance")
        more = staged(far.join(onward, "_via").select("id", "ancestor_id", (F.col("distance") + steps).alias("distance")))
        if not more.limit(1).count():
            return reached
        reached = staged(reached.unionByName(more))
        steps *= 2


def retrievable(types: DataFrame) -> DataFrame:
    return types.where("is_retrievable")


def norm_search(
    chunks: DataFrame,
    versions: DataFrame,
    norms: DataFrame,
    types: DataFrame,
    queries: DataFrame,
    language: str,
    k: int = 10,
    day: datetime.date | None = None,
) -> DataFrame:
    """Vector search over the chunks of retrievable norms in one language, in force at ``day`` or open-ended."""
    valid = effective_at(versions, day) if day else current_version(versions)
    valid = valid.where(F.col("language") == language)
    kinds = retrievable(types).select(F.col("type_id"))
    owners = valid.join(norms.select(F.col("id").alias("norm_id"), "type_id").join(kinds, "type_id"), "norm_id")
    kept = chunks.join(owners.select("version_id"), "version_id", "left_semi")
    return vector_search(kept, queries, k=k, threshold=None)


def shape_norm_hits(
    hits: DataFrame, chunks: DataFrame, versions: DataFrame, norms: DataFrame, types: DataFrame, acts: DataFrame
) -> DataFrame:
    """Hits with act title, article or paragraph number by norm type, and four-place similarity.

    Inner joins drop hits whose version, norm or act is gone.
    """
    code = F.col("code")
    return (
        hits.join(chunks.select("row_id", "version_id", "chunk_index", "chunk_text"), "row_id")
        .join(versions.select("version_id", "norm_id", "content_plain", "effective_from", "effective_to", "language"), "version_id")
        .join(norms.select(F.col("id").alias("norm_id"), "type_id", "npa_id", "number"), "norm_id")
        .join(types.select("type_id", "code"), "type_id")
        .join(acts.select(F.col("id").alias("npa_id"), F.col("title_ru").alias("document_title")), "npa_id")
        .select(
            "query_id",
            "rank",
            "row_id",
            "document_title",
            F.when(code == ARTICLE, F.col("number")).alias("article"),
            F.when(code.isin(*PARAGRAPHS), F.col("number")).alias("paragraph"),
            F.col("content_plain").alias("text"),
            F.col("effective_from").cast("string").alias("effective_from"),
            F.col("effective_to").cast("string").alias("effective_to"),
            "language",
            "chunk_index",
            "chunk_text",
            round_half_even(F.col("score"), 4).alias("similarity"),
        )
    )


def edges(links: DataFrame, ids: DataFrame, side: str) -> DataFrame:
    """Amendments or references whose ``side`` column is among the ids: incoming or outgoing by the column named."""
    return links.join(ids.select(F.col("id").alias(side)), side, "left_semi")


def drop_children(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose parent is not among the deleted keys."""
    return df.join(keys.select(column), column, "left_anti")
