"""Sweeps the text files beside the images (logs, notes) by root folder, and tells which are copies of which.

    python -m jobs.sidecar_audit DOCUMENTS OUT [--config jobs/sidecar_audit.json]

DOCUMENTS: a Parquet table of texts (doc_id, text, lang, source). Each source is a root folder, named with a leading slash, each text a file below it. OUT gets `files`, the table of files
after the last sweep of each root (partitioned by root), and `copies`, every file that is there with the number of files of the same bytes, which of them
is to be kept, and its size in bytes, lines and words (partitioned by root).

A run sweeps the roots that are due by their interval: files that are new, changed, gone or moved to another path are told by their size, time and
content. Both tables are written by partition; a run that is repeated at the same time changes nothing in `files` and gives the same `copies`."""

from __future__ import annotations

import logging
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, settings
from skyquarry.operators import archive, rescan
from skyquarry.streaming.snapshot import observed, stored

LOG = logging.getLogger("skyquarry.jobs.sidecar_audit")
#: now: the time of the sweep in UTC, the clock's where it is empty.
DEFAULTS = {"interval_minutes": 60, "settle_seconds": 30, "now": ""}


def listing_of(documents: DataFrame) -> DataFrame:
    """root_id, rel_path, size_bytes, content_key, mtime_utc, n_lines, n_words: one row for each place; of several texts there the largest counts.
    A null source, language or text is the empty one; a text without an id has no place and is left out."""
    text, blank = F.coalesce("text", F.lit("")), lambda c: F.coalesce(F.col(c), F.lit(""))
    path = F.concat(blank("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    time = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=F.pmod("doc_id", F.lit(1_000_000)))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    rows = documents.where("doc_id is not null").select(
        F.concat(F.lit("/"), blank("source")).alias("root_id"), path.alias("rel_path"), F.octet_length(text).cast("long").alias("size_bytes"), time.alias("mtime_utc"), F.md5(text).alias("content_key"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), words.alias("n_words"),
    )
    measures = ["size_bytes", "content_key", "mtime_utc", "n_lines", "n_words"]
    return rows.groupBy("root_id", "rel_path").agg(F.max(F.struct(*measures)).alias("_m")).select("root_id", "rel_path", "_m.*")


def run(spark: SparkSession, documents: str, out: str, config: dict | None = None) -> dict[str, int]:
    """One run; the number of swept files by outcome."""
    config = DEFAULTS | (config or {})
    now = F.lit(config["now"] or datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    texts = spark.read.parquet(documents)
    listing = listing_of(texts)
    roots = listing.select("root_id").distinct().withColumns({"enabled": F.lit(True), "interval_minutes": F.lit(config["interval_minutes"]).cast("int")})
    read = listing.select("root_id", "rel_path", "content_key", F.lit(None).cast("string").alias("error"))
    swept = rescan.sweep_due(spark, f"{out}/files", roots, listing.select("root_id", "rel_path", "size_bytes", "mtime_utc", F.col("content_key").alias("etag")), read, now, config["settle_seconds"])
    LOG.info("read %s; wrote %d files of due roots to %s/files: %s", documents, swept.get("files", 0), out, ", ".join(f"{k} {v}" for k, v in swept.items() if k != "files") or "nothing was due")
    found = rescan.copies(stored(spark, f"{out}/files", rescan.files_schema("string")))
    measured = found.join(listing.select("root_id", "rel_path", "n_lines", "n_words"), ["root_id", "rel_path"], "left")
    counted = Observation()
    report = measured.drop("scanned_utc", "last_seen_utc").observe(counted, F.count(F.lit(1)).alias("files"), F.count_if(~F.col("keeper")).alias("copies"), F.sum(F.when(~F.col("keeper"), F.col("size_bytes"))).alias("bytes"))
    report.hint("rebalance", "root_id").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("root_id").parquet(f"{out}/copies")
    LOG.info(f"wrote %d files to {out}/copies, of which %d could go, %d bytes", *(observed(counted).get(k, 0) for k in ("files", "copies", "bytes")))
    return swept


def copies(spark: SparkSession, out: str) -> DataFrame:
    """The report as it stands."""
    schema = "file_id long, rel_path string, size_bytes long, mtime_utc timestamp_ntz, file_status string, content_key string, outcome string, copies long, keep_root string, keep_path string, keeper boolean, n_lines long, n_words long, root_id string"
    return spark.read.schema(schema).parquet(f"{out}/copies")


def main(argv: list[str] | None = None) -> None:
    arguments = [("documents", "Parquet table of texts"), ("out", "folder of the output")]
    command_line(__doc__, arguments, lambda spark, given: run(spark, given.documents, given.out, settings(spark, given.config, DEFAULTS)), argv)


if __name__ == "__main__":
    main()
