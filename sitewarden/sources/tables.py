"""Stored tables: appends, year partitions swapped after an import, legal tables by language."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewarden import schemas as S
from sitewarden.operators.upsert import upsert
from sitewarden.session import staged

KAZAKH = "kaz"


def append(df: DataFrame, path: str, schema: T.StructType, now: Column, defaults: dict | None = None) -> None:
    """Append rows with defaults filled and both timestamps set; incidents are laid out by year."""
    stamped = df.withColumns({"created_at": now, "updated_at": now})
    rows = S.conform(stamped, schema, defaults)
    if "incident_date" in rows.columns:
        rows.withColumn("year", F.year("incident_date")).write.mode("append").partitionBy("year").parquet(path)
    else:
        rows.write.mode("append").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The incident table at ``path`` with its ``year`` partition column; empty where nothing was written yet."""
    schema = T.StructType([*S.INCIDENT.fields, T.StructField("year", T.IntegerType())])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def merge_import(spark: SparkSession, path: str, classified: DataFrame, now: Column, preserve_missing: bool = False,
                 missing: tuple[str, ...] = ()) -> None:
    """Apply classified journal rows to the incident store at ``path``.

    Only the years the import touches are rewritten (the key holds the date, so an update stays in its year). The new
    partitions are written to a staging table in the shared folder first: the store is never overwritten while it is
    read, and a lost executor reads the staged rows again instead of repeating the import.
    """
    filled = filled_incidents(classified)
    years = filled.select(F.year("incident_date").alias("year")).distinct()
    touched = read_store(spark, path).join(years, "year", "left_semi").select(*S.INCIDENT.fieldNames())
    result = staged(upsert(touched, filled, now, preserve_missing, missing))
    (
        result.withColumn("year", F.year("incident_date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )


def filled_incidents(classified: DataFrame) -> DataFrame:
    """Classified rows with all stored columns in their types, defaults filled."""
    return classified.select(
        *[_filled(classified, f) for f in S.INCIDENT.fields if f.name != "updated_at"], "action", "file_seq", "row_no"
    )


def _filled(df: DataFrame, field: T.StructField) -> Column:
    value = F.col(field.name) if field.name in df.columns else F.lit(None)
    if field.name in S.INCIDENT_DEFAULTS:
        value = F.coalesce(value, F.lit(S.INCIDENT_DEFAULTS[field.name]))
    return value.cast(field.dataType).alias(field.name)


def laws(chunks: DataFrame, language: str) -> DataFrame:
    """Legal chunks or metadata of one language from a table partitioned by ``lang``: Kazakh, else Russian."""
    return chunks.where(F.col("lang") == ("kz" if language == KAZAKH else "ru"))
