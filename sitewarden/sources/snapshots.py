"""A stored table whose state is a list of folders: appends and merges that may be repeated, and readers that never see half of one.

Data goes to new folders only, laid out by year. A numbered manifest then names, per year, the folders that make up the table, and the batches
that went in; a writer creates the next number (which fails if another was faster) and readers follow the newest. A job that
ends before its manifest leaves folders nobody reads, and a batch that is already listed changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewarden import schemas as S
from sitewarden.operators.upsert import upsert
from sitewarden.sources.tables import filled_incidents

NO_YEAR = "none"


@dataclass(frozen=True)
class Manifest:
    number: int = -1
    batches: tuple[str, ...] = ()
    folders: dict[str, list[str]] = field(default_factory=dict)  # by year, as text


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, day: str = "incident_date"):
        self.spark, self.path, self.schema, self.day = spark, path, schema, day
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> Manifest:
        """The newest state; an empty one where nothing was committed."""
        folder = self._fs_path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        numbers = [int(n[:-5]) for n in names if n.endswith(".json")]
        if not numbers:
            return Manifest()
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{max(numbers):09d}.json").first()[0]
        held = json.loads(text)
        return Manifest(max(numbers), tuple(held["batches"]), held["folders"])

    def _commit(self, before: Manifest, batch: str, folders: dict[str, list[str]]) -> None:
        text = json.dumps({"batches": [*before.batches, batch], "folders": folders})
        # Written whole under another name, then renamed: the rename fails if the number is taken.
        hidden, final = (self._fs_path(f"{self.path}/manifests/{n}") for n in (f"_{uuid.uuid4().hex}", f"{before.number + 1:09d}.json"))
        out = self._fs.create(hidden, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(hidden, final):
            raise RuntimeError(f"{final.getName()} was written by another batch; read the table again")

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """Rows in a new folder; the folder of each year."""
        name = uuid.uuid4().hex
        year = F.coalesce(F.year(self.day).cast("string"), F.lit(NO_YEAR)) if self.day in rows.columns else F.lit(NO_YEAR)
        rows.withColumn("_year", year).write.partitionBy("_year").parquet(f"{self.path}/files/{name}")
        made = [s.getPath().getName() for s in self._fs.listStatus(self._fs_path(f"{self.path}/files/{name}"))]
        return {n.removeprefix("_year="): [f"{name}/{n}"] for n in made if n.startswith("_year=")}

    def read(self, years: list | None = None) -> DataFrame:
        """The table, or the given years of it; folders of other years are not even listed."""
        wanted = None if years is None else {NO_YEAR if y is None else str(y) for y in years}
        folders = [f for y, fs in sorted(self.manifest().folders.items()) if wanted is None or y in wanted for f in fs]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/files/{f}" for f in folders])

    def append(self, df: DataFrame, batch: str, now: Column, defaults: dict | None = None) -> bool:
        """Add rows with defaults and timestamps; false, and nothing is done, if the batch went in before."""
        before = self.manifest()
        if batch in before.batches:
            return False
        made = self._write(S.conform(df.withColumns({"created_at": now, "updated_at": now}), self.schema, defaults))
        self._commit(before, batch, {y: before.folders.get(y, []) + made.get(y, []) for y in sorted({*before.folders, *made})})
        return True

    def merge(self, classified: DataFrame, batch: str, now: Column, preserve_missing: bool = False, missing: tuple[str, ...] = ()) -> bool:
        """Apply classified journal rows: the years they touch are written anew and replace the old ones at once."""
        before = self.manifest()
        if batch in before.batches:
            return False
        filled = filled_incidents(classified)
        years = [r.y for r in filled.select(F.year("incident_date").alias("y")).distinct().collect()]  # one per calendar year
        made = self._write(upsert(self.read(years), filled, now, preserve_missing, missing))
        self._commit(before, batch, {y: made[y] if y in made else before.folders[y] for y in sorted({*before.folders, *made})})
        return True
