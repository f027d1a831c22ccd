"""Journals imported as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitewarden.operators.matching import adopt
from sitewarden.operators.upsert import CREATE, classify_upsert, import_report
from sitewarden.session import staged
from sitewarden.sources.journal import NOT_IN_JOURNAL, RAW, parse_journal, with_file_order
from sitewarden.sources.tables import merge_import, read_store


def import_batch(rows: DataFrame, store: str, reports: str, batch: int = 0, preserve_missing: bool = False, acts: DataFrame | None = None) -> None:
    """One batch of untyped rows into the incident store; files count in the order of their names.

    ``reports`` gets, per batch, ``errors`` (wrong rows), ``rejected`` (files without a header or a required column), ``links``
    (unlinked ``acts`` that match a new incident) and ``report`` (counts per file and in all).
    Ids come from file and row, and a repeated batch finds its own keys in the store and overwrites its own reports, so that
    a replay after a failure updates rows instead of adding them.
    """
    spark = rows.sparkSession
    good, errors, rejected = parse_journal(staged(rows))
    good, errors, rejected = staged(good), staged(errors), staged(rejected)
    # One name per file of the batch goes through the ranking window; the rows themselves do not.
    order = good.select("file").distinct().withColumn("file_seq", F.row_number().over(Window.orderBy("file")))
    incoming = staged(with_file_order(good, order))
    classified = classify_upsert(incoming, read_store(spark, store))
    created = classified.where(F.col("action") == CREATE)
    links = adopted = None
    if acts is not None:
        links = staged(adopt(acts, created)[1])
        adopted = links.join(created.select(F.col("id").alias("incident_id"), "file"), "incident_id")
    merge_import(spark, store, classified, F.localtimestamp(), preserve_missing, NOT_IN_JOURNAL)
    written = {"errors": errors, "rejected": rejected, "report": import_report(classified, errors, adopted, rejected)}
    for name, df in (written | ({"links": links} if links is not None else {})).items():
        df.write.mode("overwrite").parquet(f"{reports}/{name}/batch={batch}")


def stream_journals(
    spark: SparkSession, arrivals: str, store: str, checkpoint: str, reports: str, fmt: str = "parquet", preserve_missing: bool = False,
    acts: DataFrame | None = None,
) -> StreamingQuery:
    """Watch ``arrivals`` for files of ``row_no, cells`` and import each micro-batch; processes what is there, then stops."""
    rows = (
        spark.readStream.schema(RAW)
        .format(fmt)
        .load(arrivals)
        .select(F.col("_metadata.file_path").alias("file"), "row_no", "cells")
    )
    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: import_batch(batch, store, reports, number, preserve_missing, acts))
        .start()
    )
