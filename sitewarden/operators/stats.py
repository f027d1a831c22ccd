"""Report statistics over incidents and acts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.functions.text import present, round_half_even, strip
from sitewarden.schemas import PERSON

POSITION_UNKNOWN = "не указано"

# The columns of the digest, in their order.
DIGEST_COLUMNS = (
    "ai_summary",
    "root_causes",
    "immediate_causes",
    "employer_fault_pct",
    "corrective_measures",
    "cause_categories",
    "violation_types",
    "conclusions",
    "legal_violations",
    "responsible_persons",
    "circumstances",
    "workplace_description",
)
_DIGEST_LISTS = {
    "cause_categories": "array<string>",
    "violation_types": "array<string>",
    "legal_violations": "array<string>",
    "responsible_persons": f"array<{PERSON.simpleString()}>",
}


def recurrence(incidents: DataFrame) -> DataFrame:
    """Recurrent incidents per company."""
    return incidents.where("is_recurrent").groupBy("company").agg(F.count(F.lit(1)).alias("n"))


def training_stats(incidents: DataFrame) -> DataFrame:
    """Row count and percentage known to lack training; nulls stay in the denominator, an empty table gives 0."""
    counted = incidents.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("safety_training_completed") == F.lit(False)).alias("without"),
    )
    share = F.try_divide(F.col("without").cast("double"), F.col("total").cast("double")) * F.lit(100.0)
    return counted.select(
        "total", F.coalesce(round_half_even(share, 1), F.lit(0.0)).alias("without_training_pct")
    )


def top_equipment(incidents: DataFrame, n: int = 5) -> DataFrame:
    return (
        incidents.where(present(F.col("equipment")))
        .groupBy("equipment")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("equipment"))
        .limit(n)
    )


def _persons(acts: DataFrame) -> DataFrame:
    position = F.when(present(F.col("p.position")), F.col("p.position")).otherwise(F.lit(POSITION_UNKNOWN))
    return acts.select(F.explode("responsible_persons").alias("p")).select(
        position.alias("position"), F.col("p.violation").alias("violation")
    )


def position_violations(acts: DataFrame) -> DataFrame:
    """One row per position and violation text; the table-scale form of the violation lists."""
    return _persons(acts).groupBy("position", "violation").agg(F.count(F.lit(1)).alias("n"))


def by_position(acts: DataFrame) -> DataFrame:
    """Responsible persons per position with the number of distinct violations, most frequent first.

    Counting per (position, violation) first keeps every step a partial aggregate, also for one dominant position.
    """
    return (
        position_violations(acts)
        .groupBy("position")
        .agg(F.sum("n").alias("n"), F.count_if(present(F.col("violation"))).alias("n_violations"))
        .orderBy(F.col("n").desc(), F.col("position"))
    )


def by_position_lists(digest: DataFrame) -> DataFrame:
    """As ``by_position`` with the sorted violation texts; meant for an act digest, whose row count is limited."""
    return (
        position_violations(digest)
        .groupBy("position")
        .agg(
            F.sum("n").alias("n"),
            F.array_sort(F.collect_set(F.when(present(F.col("violation")), F.col("violation")))).alias("violations"),
        )
        .orderBy(F.col("n").desc(), F.col("position"))
    )


def legal_violations(acts: DataFrame) -> DataFrame:
    """Distinct trimmed violation references; empty entries are skipped."""
    return (
        acts.select(F.explode("legal_violations").alias("v"))
        .where(present(F.col("v")))
        .select(strip(F.col("v")).alias("violation"))
        .distinct()
    )


def act_digest(acts: DataFrame, incidents: DataFrame, n: int = 30) -> DataFrame:
    """At most ``n`` acts of the given incidents that carry a summary; null lists read as empty, ties by act id."""
    linked = acts.where(present(F.col("ai_summary"))).join(
        incidents.select(F.col("id").alias("incident_id")), "incident_id", "left_semi"
    )

    def shown(name: str):
        kind = _DIGEST_LISTS.get(name)
        return F.coalesce(F.col(name), F.array().cast(kind)).alias(name) if kind else F.col(name)

    return linked.select("id", *[shown(c) for c in DIGEST_COLUMNS]).orderBy("id").limit(n)


