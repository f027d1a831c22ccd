"""Dedup keys, create/update classification, keyed updates and the import report.

Incoming rows carry ``file_seq`` (order of the file in its batch) and ``row_no`` (order inside the file) plus
the id they get if they turn out to be new.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions.text import norm_key
from sitewarden.session import staged

KEY = ("incident_date", "company", "classification", "region", "victim_key", "location_key")
STORED_KEY_COLUMNS = (
    "id",
    "created_at",
    "incident_date",
    "company",
    "classification",
    "region",
    "victim_name",
    "location",
)
CREATE, UPDATE = "create", "update"


def with_dedup_key(df: DataFrame) -> DataFrame:
    """Adds the normalised parts of the key (date, company, classification, region, victim, location)."""
    return df.withColumns(
        {"victim_key": norm_key(F.col("victim_name")), "location_key": norm_key(F.col("location"))}
    )


def _same_key(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in KEY])


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped id derived from its parts, so that a recomputed task assigns the same ids."""
    text = F.md5(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.regexp_replace(text, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def prune_existing(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Key columns of the stored rows in the years that occur among the incoming rows.

    The years (a handful, fetched first) reach the scan as spans of dates, which prune row groups, and as values of a ``year`` partition
    column, which prune folders: two far years read two folders, not all between them.
    """
    years = sorted(r.y for r in incoming.where(F.col("incident_date").isNotNull()).select(F.year("incident_date").alias("y")).distinct().collect())
    spans = []
    for y in years:  # neighbouring years make one span
        if spans and spans[-1][1] == y - 1:
            spans[-1][1] = y
        else:
            spans.append([y, y])
    dated = F.col("incident_date")
    inside = [(dated >= F.lit(datetime.date(a, 1, 1))) & (dated <= F.lit(datetime.date(b, 12, 31))) for a, b in spans]
    kept = existing.where(reduce(lambda x, y: x | y, inside, F.lit(False)))
    if "year" in existing.columns:
        kept = kept.where(F.col("year").isin(years or [-1]))
    return kept.select(*STORED_KEY_COLUMNS)


def classify_upsert(incoming: DataFrame, existing: DataFrame, within_file: str = "keep") -> DataFrame:
    """Adds ``action``, the final ``id`` and ``created_at`` (of the stored row; null for a new one).

    A stored key gives an update of its newest stored row. A key unknown to the store is created by every row
    of the first file that has it, and rows of later files update the greatest of those ids: files are
    imported one after another, duplicates inside one file are not compared with each other.
    ``within_file="last"`` keeps only the last row per key and file instead.
    """
    rows = with_dedup_key(incoming)
    if within_file == "last":
        last = rows.groupBy(*KEY, "file_seq").agg(F.max("row_no").alias("last_row"))
        rows = (
            rows.alias("r")
            .join(
                last.alias("l"),
                _same_key("r", "l") & (F.col("r.file_seq") == F.col("l.file_seq")) & (F.col("row_no") == F.col("last_row")),
                "left_semi",
            )
        )
    elif within_file != "keep":
        raise ValueError("within_file is 'keep' or 'last'")

    # One row per key on both sides before any join: copies collapse in the map-side aggregate.
    stored = (
        with_dedup_key(prune_existing(existing, incoming))
        .groupBy(*KEY)
        .agg(F.max(F.struct("created_at", "id")).alias("stored"))
    )
    first = rows.groupBy(*KEY).agg(F.max(F.struct((-F.col("file_seq")).alias("rank"), "id")).alias("first"))
    keys = (
        first.alias("f")
        .join(stored.alias("s"), _same_key("f", "s"), "left")
        .select(*[F.col(f"f.{c}").alias(c) for c in KEY], "first", "stored")
    )
    joined = rows.alias("r").join(keys.alias("k"), _same_key("r", "k"), "inner")
    known = F.col("stored").isNotNull()
    opens = F.col("r.file_seq") == -F.col("first.rank")
    plain = [F.col(f"r.{c}") for c in incoming.columns if c not in ("id", "created_at")]
    classified = joined.select(
        *plain,
        F.when(known | ~opens, F.lit(UPDATE)).otherwise(F.lit(CREATE)).alias("action"),
        F.when(known, F.col("stored.id")).when(opens, F.col("r.id")).otherwise(F.col("first.id")).alias("id"),
        F.col("stored.created_at").alias("created_at"),
    )
    # The report, the merge and the adoption of acts all read the outcome.
    return staged(classified)


def upsert(
    existing: DataFrame, classified: DataFrame, now: Column, preserve_missing: bool = False, missing: Sequence[str] = ()
) -> DataFrame:
    """The incident table after an import.

    Of several updates of one id the last (file, row) wins. An update replaces every column but ``id`` and
    ``created_at``; with ``preserve_missing`` the columns named in ``missing`` (absent from the journal) keep
    their stored value.
    """
    columns = existing.columns
    payload = [c for c in columns if c not in ("id", "created_at", "updated_at")]
    updates = classified.where(F.col("action") == UPDATE)
    winners = (
        updates.groupBy("id")
        .agg(F.max_by(F.struct(*payload), F.struct("file_seq", "row_no")).alias("new"))
        .withColumn("hit", F.lit(True))
    )
    created = classified.where(F.col("action") == CREATE).select(
        *[(now if c in ("created_at", "updated_at") else F.col(c)).cast(existing.schema[c].dataType).alias(c) for c in columns]
    )
    base = existing.unionByName(created).alias("b").join(winners.alias("w"), "id", "left")
    kept = set(missing) if preserve_missing else set()

    def merged(c: str) -> Column:
        if c in ("id", "created_at") or c in kept:
            return F.col(f"b.{c}").alias(c) if c != "id" else F.col("id")
        new = now if c == "updated_at" else F.col(f"w.new.{c}")
        return F.when(F.col("w.hit"), new).otherwise(F.col(f"b.{c}")).cast(existing.schema[c].dataType).alias(c)

    return base.select(*[merged(c) for c in columns])


def update_by_id(base: DataFrame, changes: DataFrame, key: str = "id", keep: Sequence[str] = ("created_at",)) -> DataFrame:
    """Rows of ``base`` with every column of a matching change replaced; unknown ids are skipped."""
    replaced = [c for c in changes.columns if c in base.columns and c != key and c not in keep]
    new = changes.select(key, F.struct(*replaced).alias("new"), F.lit(True).alias("hit"))
    joined = base.join(new, key, "left")
    return joined.select(
        *[
            (F.when(F.col("hit"), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c))
            for c in base.columns
        ]
    )


def unknown_ids(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Change rows whose id the table does not have (an error for a single-row update)."""
    return changes.join(base.select(key), key, "left_anti")


def apply_links(acts: DataFrame, links: DataFrame) -> DataFrame:
    """Sets ``incident_id`` and ``link_status`` from a table of ``act_id, incident_id, link_status``."""
    changes = links.select(F.col("act_id").alias("id"), "incident_id", "link_status")
    return update_by_id(acts, changes)


def count_applied(acts: DataFrame, links: DataFrame) -> DataFrame:
    """How many links name an existing act."""
    known = links.join(acts.select(F.col("id").alias("act_id")), "act_id", "left_semi")
    return known.agg(F.count(F.lit(1)).alias("n"))


def import_report(
    classified: DataFrame, errors: DataFrame, adoptions: DataFrame | None = None, rejected: DataFrame | None = None
) -> DataFrame:
    """One row per file plus a total row (``file`` null).

    ``classified`` has ``file, action``; ``errors`` has ``file, row_no, message``; ``adoptions`` has ``file``;
    ``rejected`` has ``file, reason`` for files that could not be read. Errors are counted; their messages are the
    rows of ``errors``.
    """
    counts = classified.groupBy("file").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("action") == CREATE).alias("created"),
        F.count_if(F.col("action") == UPDATE).alias("updated"),
    )
    error_counts = errors.groupBy("file").agg(F.count(F.lit(1)).alias("n_errors"))
    report = counts.join(error_counts, "file", "full")
    if adoptions is not None:
        report = report.join(adoptions.groupBy("file").agg(F.count(F.lit(1)).alias("adopted_acts")), "file", "left")
    else:
        report = report.withColumn("adopted_acts", F.lit(0).cast("long"))
    if rejected is not None:
        report = report.join(rejected.select("file", F.col("reason").alias("error")), "file", "full")
    else:
        report = report.withColumn("error", F.lit(None).cast("string"))
    numbers = ("processed", "created", "updated", "adopted_acts", "n_errors")
    per_file = report.select(
        "file", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers], "error"
    )
    total = per_file.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.count(F.lit(1)).alias("files"),
        F.count("error").alias("failed_files"),
    ).select(F.lit(None).cast("string").alias("file"), *numbers, F.lit(None).cast("string").alias("error"), "files", "failed_files")
    return per_file.select(
        "*", F.lit(1).cast("long").alias("files"), F.col("error").isNotNull().cast("long").alias("failed_files")
    ).unionByName(total)
