"""Sweeps of the roots that are due, written back to a table of files partitioned by root.

The table is its own record of when a root was last swept (`scanned_utc`): a root's files and its mark are one partition, replaced by Spark's dynamic
overwrite when all tasks have ended. A sweep that fails leaves every root as it was; one that is repeated at the same time finds nothing due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyquarry.operators import archive
from skyquarry.streaming.snapshot import observed, rewrite, stored

OUTCOMES = ("add", "update", "skip", "error", "moved", "missing", "kept", "settling")


def files_schema(root_type: str = "int") -> StructType:
    return StructType.fromDDL(f"file_id long, root_id {root_type}, rel_path string, size_bytes long, mtime_utc timestamp_ntz, file_status string, last_seen_utc timestamp_ntz, content_key string, outcome string, scanned_utc timestamp_ntz")


def last_scans(roots: DataFrame, files: DataFrame) -> DataFrame:
    """roots with last_scan_utc, the time of the sweep that wrote their files; null without one."""
    return roots.join(files.groupBy("root_id").agg(F.max("scanned_utc").alias("last_scan_utc")), "root_id", "left")


def sweep_due(spark: SparkSession, path: str, roots: DataFrame, listing: DataFrame, read: DataFrame, now: Column, settle_seconds: int = 30) -> dict[str, int]:
    """Sweeps the due roots (root_id, enabled, interval_minutes) against the files at path and writes them back; the number of files by outcome.

    listing and read are those of `archive.sweep`; rows of other roots are left alone. The counters are observed as the files are written, so that
    no second pass is made. Roots that are not known to `roots` are never swept."""
    schema = files_schema(dict(roots.dtypes)["root_id"])
    known = stored(spark, path, schema)
    due = archive.due_roots(last_scans(roots, known), now).select("root_id")
    within = lambda df: df.join(due, "root_id", "left_semi")
    swept = archive.sweep(within(listing), within(known), within(read), now, settle_seconds).withColumn("scanned_utc", now).select(schema.names)
    counted = Observation()
    rewrite(swept.observe(counted, F.count(F.lit(1)).alias("files"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES)), path, "root_id")
    return {k: v for k, v in observed(counted).items() if v}


def copies(files: DataFrame) -> DataFrame:
    """files that are not missing, with the number of files that have their content (`copies`), the first of them by root and path (`keep_root`,
    `keep_path`) and whether the file is that one (`keeper`). Files without a content key are their own only copy. A key that many files share is one
    row of the grouped side; its files are divided by adaptive execution."""
    here = files.where("file_status <> 'missing'")
    groups = here.where("content_key <> ''").groupBy(F.col("content_key").alias("_key")).agg(F.count("*").alias("copies"), F.min(F.struct("root_id", "rel_path")).alias("_first")).where("copies > 1")
    out = here.join(groups, F.col("content_key") == F.col("_key"), "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    first = lambda c: F.coalesce(F.col(f"_first.{c}"), F.col(c))
    out = out.withColumns({"keep_root": first("root_id"), "keep_path": first("rel_path")}).drop("_key", "_first")
    return out.withColumn("keeper", (F.col("keep_root") == F.col("root_id")) & (F.col("keep_path") == F.col("rel_path")))
