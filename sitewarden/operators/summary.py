"""Dashboard aggregates in long form: ``dimension, key, n``."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarden.functions.text import any_of, present
from sitewarden.schemas import INJURY_FATAL
from sitewarden.session import staged

SUMMARY_DIMENSIONS = ("classification", "injury_type", "region", "company", "month")


def month_of(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def totals(incidents: DataFrame, approximate: bool = False) -> DataFrame:
    """Incident count, distinct victim names (nulls not counted) and rows of the fatal injury type."""
    victims = F.approx_count_distinct("victim_name") if approximate else F.count_distinct("victim_name")
    return incidents.agg(
        F.count(F.lit(1)).alias("total_incidents"),
        victims.alias("total_victims"),
        F.count_if(F.col("injury_type") == INJURY_FATAL).alias("total_fatalities"),
    )


def count_by(incidents: DataFrame, dimension: str) -> DataFrame:
    """Rows per value of one column; null and empty values are dropped."""
    return (
        incidents.where(present(F.col(dimension)))
        .groupBy(F.col(dimension).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def by_month(incidents: DataFrame) -> DataFrame:
    return (
        incidents.where(F.col("incident_date").isNotNull())
        .groupBy(month_of(F.col("incident_date")).alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("month")
    )


def _cells(incidents: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Counts per victim and combination of the dimensions, the one aggregate that every figure comes from.

    Partial aggregation collapses a dominant or null name; the result is written once and read by both branches.
    """
    with_month = incidents.withColumn("month", month_of(F.col("incident_date")))
    return staged(
        with_month.groupBy(*dimensions, "victim_name").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("injury_type") == INJURY_FATAL).alias("fatal")
        )
    )


def _breakdowns(cells: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Every dimension on its own, by one grouping-sets pass over the counts per combination of dimensions."""
    top = len(dimensions) - 1
    every = (1 << len(dimensions)) - 1
    small = cells.groupBy(*dimensions).agg(F.sum("n").alias("n"))
    grouped = small.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions]).agg(
        F.sum("n").cast("long").alias("n"), F.grouping_id().cast("int").alias("level")
    )
    # In grouping_id a column's bit is 0 when it is grouped by; the first column has the highest bit.
    name = key = F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        here = F.col("level") == (every & ~(1 << (top - i)))
        name = F.when(here, F.lit(d)).otherwise(name)
        key = F.when(here, F.col(d)).otherwise(key)
    return grouped.select(name.alias("dimension"), key.alias("key"), "n")


def _head_counts(cells: DataFrame) -> DataFrame:
    """Rows, distinct victims and fatal rows, also for an empty table."""
    by_victim = cells.groupBy("victim_name").agg(F.sum("n").alias("n"), F.sum("fatal").alias("fatal"))
    zero = F.lit(0)
    one = by_victim.agg(
        F.coalesce(F.sum("n"), zero).alias("total_incidents"),
        F.count("victim_name").alias("total_victims"),
        F.coalesce(F.sum("fatal"), zero).alias("total_fatalities"),
    )
    lines = [
        F.struct(F.lit(c).alias("dimension"), F.lit("").alias("key"), F.col(c).cast("long").alias("n"))
        for c in one.columns
    ]
    return one.select(F.explode(F.array(*lines)).alias("line")).select("line.*")


def summary(incidents: DataFrame) -> DataFrame:
    """Totals and five breakdowns; null and empty keys are dropped from the breakdowns."""
    cells = _cells(incidents, SUMMARY_DIMENSIONS)
    return _breakdowns(cells, SUMMARY_DIMENSIONS).where(present(F.col("key"))).unionByName(_head_counts(cells))


def refresh_states(incidents: DataFrame, path: str, years: list[int] | None = None) -> None:
    """Store the counts per year, victim and cell below ``path``; with ``years`` only those are counted and replaced.

    A row without a date belongs to year 0. The counts of different years add up, so a summary never needs the incidents again.
    """
    year = F.coalesce(F.year("incident_date"), F.lit(0))
    rows = incidents.withColumns({"_year": year, "month": month_of(F.col("incident_date"))})
    if years is not None:
        dated = F.col("incident_date")
        spans = [(dated >= F.make_date(F.lit(y), F.lit(1), F.lit(1))) & (dated <= F.make_date(F.lit(y), F.lit(12), F.lit(31))) for y in years if y]
        spans += [dated.isNull()] if 0 in years else []
        rows = rows.where(any_of(spans) if spans else F.lit(False))
    cells = rows.groupBy("_year", *SUMMARY_DIMENSIONS, "victim_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("injury_type") == INJURY_FATAL).alias("fatal"))
    writer = cells.write.mode("overwrite").partitionBy("_year")
    (writer.option("partitionOverwriteMode", "dynamic") if years is not None else writer).parquet(path)


def summary_of_states(spark: SparkSession, path: str) -> DataFrame:
    """``summary`` from stored counts."""
    shape = ", ".join(f"{d} string" for d in SUMMARY_DIMENSIONS) + ", victim_name string, n long, fatal long"
    cells = spark.read.schema(shape).parquet(path)
    return _breakdowns(cells, SUMMARY_DIMENSIONS).where(present(F.col("key"))).unionByName(_head_counts(cells))


def statistics(
    incidents: DataFrame,
    company: str | None = None,
    date_from: datetime.date | None = None,
    date_to: datetime.date | None = None,
) -> DataFrame:
    """Totals with two breakdowns; a null classification stays as ``"None"``, a null injury type is dropped."""
    if company:
        incidents = incidents.where(F.col("company") == company)
    if date_from:
        incidents = incidents.where(F.col("incident_date") >= F.lit(date_from))
    if date_to:
        incidents = incidents.where(F.col("incident_date") <= F.lit(date_to))
    dimensions = ("classification", "injury_type")
    cells = _cells(incidents, dimensions)
    rows = _breakdowns(cells, dimensions)
    key = F.when(F.col("dimension") == "classification", F.coalesce("key", F.lit("None"))).otherwise(F.col("key"))
    rows = rows.withColumn("key", key).where((F.col("dimension") != "injury_type") | present(F.col("key")))
    return rows.unionByName(_head_counts(cells))


def heatmap(incidents: DataFrame) -> DataFrame:
    """Incidents per region; a null region stays as ``"None"``."""
    return incidents.groupBy(F.coalesce("region", F.lit("None")).alias("region")).agg(F.count(F.lit(1)).alias("n"))
