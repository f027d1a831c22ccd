"""File manifest: safe names, storage keys and acceptance of uploaded files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarden.operators.upsert import stable_id

# Fixed values of the upload rules.
ALLOWED_EXTENSIONS = (".pdf", ".docx", ".xls", ".xlsx")
ALLOWED_CONTENT_TYPES = (
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/octet-stream",
)
MAX_BYTES = 50 * 1024 * 1024
MAX_NAME = 255


def safe_name(path: Column) -> Column:
    """Last path component without unprintable characters, at most 255 characters, ``unknown`` if nothing is left."""
    last = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"[^/]*$", 0)
    printable = F.regexp_replace(F.when(last == ".", F.lit("")).otherwise(last), r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", "")
    return F.when(printable != "", F.substring(printable, 1, MAX_NAME)).otherwise(F.lit("unknown"))


def suffix(name: Column) -> Column:
    """Extension with its dot; a name that starts or ends with its only dot has none."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def classify_manifest(files: DataFrame) -> DataFrame:
    """``path, content_type, size_bytes, uploaded_at`` -> safe name, storage key, verdict.

    Checks run in order: content type, extension, size.
    """
    name = safe_name(F.col("path"))
    extension = F.lower(suffix(F.regexp_extract(F.col("path"), r"[^/]*$", 0)))
    kind = F.coalesce(F.nullif(F.col("content_type"), F.lit("")), F.lit("application/octet-stream"))
    reason = (
        F.when(~kind.isin(*ALLOWED_CONTENT_TYPES), F.lit("content_type"))
        .when(~extension.isin(*ALLOWED_EXTENSIONS), F.lit("extension"))
        .when(F.col("size_bytes") > MAX_BYTES, F.lit("size"))
    )
    file_id = stable_id(F.col("path"), F.col("uploaded_at"))
    key = F.concat(
        F.lit("uploads/"), F.date_format("uploaded_at", "yyyy/MM/dd"), F.lit("/"), file_id, suffix(name)
    )
    return files.select(
        "*",
        file_id.alias("file_id"),
        name.alias("original_filename"),
        key.alias("storage_key"),
        reason.isNull().alias("accepted"),
        reason.alias("reason"),
    )


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of the files under ``path``; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return classify_manifest(
        files.select(
            "path",
            F.lit("application/octet-stream").alias("content_type"),
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("uploaded_at"),
        )
    )
