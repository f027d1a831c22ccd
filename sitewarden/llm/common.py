"""What several operators of this subpackage share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarden.session import scratch_folder, ship_package, staged

__all__ = ["ascii_lower", "row_key", "ship_package", "staged", "staged_folder", "table", "whole_text"]


#: Rows that a Python worker gets at once, where the session does not say: texts may be very long.
BATCH_ROWS = "2000"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    if spark.conf.get(_ROWS) == "10000":  # Spark's own default
        spark.conf.set(_ROWS, BATCH_ROWS)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, every other character as it is (``lower`` would change É too)."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def row_key(id_col: str, text: Column) -> Column:
    """128 bits that stand for a row's id and whole text."""
    name = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(name, F.lit("\0"), text)))


def staged_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in this application's part of the shared folder, which ``clean_staged`` removes."""
    return scratch_folder(spark, name)
