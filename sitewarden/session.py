"""Session settings every entry point shares."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution on; cluster settings are left as they are."""
    builder = (
        SparkSession.builder.appName("sitewarden")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a session that was not started with it."""
    if spark.sparkContext.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="sitewarden-"), "sitewarden"), "zip", os.path.dirname(here), os.path.basename(here)
    )
    spark.sparkContext.addPyFile(archive)
    _shipped.add(spark.sparkContext.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only for a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="sitewarden-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{ensure_checkpoint_dir(spark)}/sitewarden-{spark.sparkContext.applicationId}"


def clean_staged(spark: SparkSession) -> None:
    """Remove what this application has staged; call it when no result that reads it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in this application's part of the shared folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


_staged: list[str] = []


def staged_so_far() -> int:
    return len(_staged)


def release_staged(spark: SparkSession, since: int) -> None:
    """Remove what was staged from the ``since``-th table on, but for the newest: for a chain whose results are each written before the next."""
    for path in _staged[since:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _staged[since:-1] = []


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    For results several branches of a plan need: the work is done once, later joins are planned from true sizes, and
    a lost executor costs a read, not a recomputation. ``clean_staged`` removes the copies.
    """
    path = scratch_folder(df.sparkSession, "staged")
    df.write.parquet(path)
    _staged.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
