"""Incremental discovery of files from listings that are added to a folder.

A stream never sees a file of its folder twice, so what has changed is not told by the source: each listing's rows are compared with the table of files
(`Snapshot`). Files whose last change is too recent wait in a table of their own, with the version that was seen last, and are taken in by a later run, also
by one that finds no new listing. A stream can't see what is gone; that is left to sweeps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyquarry.operators.archive import new_file_id
from skyquarry.streaming.snapshot import Snapshot, follow, rewrite, stored

LISTING = "root_id int, rel_path string, size_bytes long, mtime_utc timestamp_ntz, content_key string"
FILES = "file_id long, rel_path string, size_bytes long, mtime_utc timestamp_ntz, content_key string, root_id int"


@dataclass(frozen=True)
class Discovery:
    """The tables below a folder: files, the log of changes, and those that still settle."""

    folder: str

    @property
    def files(self) -> Snapshot:
        return Snapshot(f"{self.folder}/files", f"{self.folder}/changes", StructType.fromDDL(FILES), "file_id", "root_id", ("mtime_utc", "size_bytes"))

    def settling(self, spark: SparkSession) -> DataFrame:
        return stored(spark, f"{self.folder}/settling", StructType.fromDDL(FILES)).where("file_id is not null")

    def take(self, rows: DataFrame, label: int | str, now: Column, settle_seconds: int) -> dict[str, int]:
        """Takes in what has settled of rows and of those that waited; the rest waits. Of several versions of a file the latest counts. Repeating a
        label gives the same files; what then still differs from them goes on waiting."""
        spark, names = rows.sparkSession, StructType.fromDDL(FILES).names
        every = rows.select(names).unionByName(self.settling(spark).select(names)).where("file_id is not null")
        latest = every.groupBy("file_id").agg(F.max_by(F.struct(*names), F.struct("mtime_utc", "size_bytes", "content_key")).alias("_row")).select("_row.*")
        settled = F.col("mtime_utc").isNull() | (F.timestamp_diff("SECOND", "mtime_utc", now) >= settle_seconds)
        _, actions = self.files.apply(latest.where(settled), label)
        seen = self.files.read(spark).select("file_id", F.struct("mtime_utc", "size_bytes").alias("_seen"))
        waiting = latest.where(~settled).join(seen, "file_id", "left").where(F.col("_seen").isNull() | (F.struct("mtime_utc", "size_bytes") > F.col("_seen")))
        marks = latest.select("root_id").distinct()  # roots of which none waits any more are written too, without rows
        rewrite(waiting.select(names).unionByName(marks, allowMissingColumns=True), f"{self.folder}/settling", "root_id")
        return actions | {"batch": label}


def discover(spark: SparkSession, listings: str, folder: str, now: Column, settle_seconds: int = 30, max_files: int | None = None, tell: Callable[[dict], None] | None = None) -> list[dict]:
    """One run over the Parquet listings that are new since the last one, and over the files that have settled meanwhile; the counts of each step.

    Rows without a root or path are left out. now: a constant, the time that ages are told by. tell: is given each step's counts."""
    tables, done = Discovery(folder), []

    def note(counts: dict) -> None:
        done.append(counts)
        if tell:
            tell(counts)

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.where("root_id is not null and rel_path is not null").withColumn("file_id", new_file_id(F.col("root_id"), F.col("rel_path")))
        note(tables.take(rows, number, now, settle_seconds))

    follow(spark, listings, StructType.fromDDL(LISTING), f"{folder}/checkpoint", handle, max_files)
    waiting = tables.settling(spark).where(F.timestamp_diff("SECOND", "mtime_utc", now) >= settle_seconds)
    if not waiting.isEmpty():
        at = spark.range(1).select(F.date_format(now, "yyyyMMddHHmmss")).first()[0]
        note(tables.take(waiting.limit(0), f"settled-{at}", now, settle_seconds))
    return done
