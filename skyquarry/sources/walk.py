"""Listing of folders level by level: the folders of a level are a table, listed by tasks; ignored ones are dropped before they are ever opened.

Paths are URIs of a file system that Arrow knows (file, hdfs, s3, ...) or absolute local paths; they must be reachable from the executors. Nothing is
listed on the driver, which only asks whether a level has folders. The result of each level is written to the shared folder, so a lost executor costs
one level at most."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquarry.session import new_folder

_ENTRIES = "root_id int, base string, ignore array<string>, rel_path string, is_folder boolean, size_bytes long, mtime_utc timestamp_ntz, error string"
#: Names that a root without a list of its own ignores.
IGNORED = (".*", "*.tmp", "@eaDir", "#recycle")


def patterns(text: Column, default: tuple[str, ...] = IGNORED) -> Column:
    """An ignore list (names divided by commas or line ends; * and ? as in globs) as regular expressions for lower-case names; a null list is the default one."""
    names = F.filter(F.transform(F.split(F.lower(text), "[,\n]"), lambda x: F.trim(x)), lambda x: x != "")
    names = F.coalesce(names, F.array(*(F.lit(n.lower()) for n in default)) if default else F.array().cast("array<string>"))
    quoted = lambda n: F.regexp_replace(n, r"([\\.^$|()\[\]{}+])", r"\\$1")
    return F.transform(names, lambda n: F.concat(F.lit("^"), F.replace(F.replace(quoted(n), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$")))


def entries(base: str, rel_path: str) -> list[dict]:
    """What one folder holds; one row with an error and no folder mark where it can't be listed."""
    try:
        system, path = fs.FileSystem.from_uri(base) if re.match(r"\w+:/", base) else (fs.LocalFileSystem(), base)
        path = path.rstrip("/")
        found = system.get_file_info(fs.FileSelector(f"{path}/{rel_path}" if rel_path else path, recursive=False))
    except OSError as e:
        return [{"rel_path": rel_path, "is_folder": False, "size_bytes": None, "mtime_utc": None, "error": str(e)[:500]}]
    kinds = {fs.FileType.File: False, fs.FileType.Directory: True}
    return [
        {"rel_path": i.path[len(path) + 1 :], "is_folder": kinds[i.type], "size_bytes": i.size, "mtime_utc": i.mtime and i.mtime.astimezone(UTC).replace(tzinfo=None), "error": None}
        for i in found if i.type in kinds
    ]


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"root_id": pa.int32(), "base": pa.string(), "ignore": pa.list_(pa.string()), "rel_path": pa.string(), "is_folder": pa.bool_(), "size_bytes": pa.int64(), "mtime_utc": pa.timestamp("us"), "error": pa.string()}
    for batch in batches:
        for folder in batch.to_pylist():
            own = {k: folder[k] for k in ("root_id", "base", "ignore")}
            rows = entries(folder["base"], folder["rel_path"])
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist([own | r for r in rows[i : i + 10_000]], pa.schema(list(kinds.items())))


def walk(spark: SparkSession, roots: DataFrame, default: tuple[str, ...] = IGNORED, partitions: int | None = None) -> DataFrame:
    """root_id, rel_path, size_bytes, mtime_utc, error of all files below the roots (root_id, path, ignore_names).

    Files and folders whose name a root's list ignores are left out, folders with all that is in them; a root whose list is null has the default
    one. Folders that can't be listed give one row with an error, and no files. A folder is listed by one task, whatever it holds; the folders of
    a level are dealt out to `partitions` tasks (Spark's default parallelism where not given). Depth, not size, sets the number of jobs."""
    out, level = new_folder(spark, "walk"), 0
    partitions = partitions or spark.sparkContext.defaultParallelism
    name = F.lower(F.element_at(F.split("rel_path", "/"), -1))
    # an ignored name is one that any of its root's patterns matches
    shown = F.col("error").isNotNull() | ~F.exists("ignore", lambda p: F.regexp(name, p))
    folders = roots.select(F.col("root_id").cast("int").alias("root_id"), F.col("path").alias("base"), patterns(F.col("ignore_names"), default).alias("ignore"), F.lit("").alias("rel_path"))
    while True:
        found = folders.repartition(partitions, F.xxhash64("root_id", "rel_path")).mapInArrow(_list, _ENTRIES).where(shown)
        found.write.parquet(f"{out}/level={level}")
        found = spark.read.schema(_ENTRIES).parquet(f"{out}/level={level}")
        folders = found.where("is_folder").select("root_id", "base", "ignore", "rel_path")
        if folders.isEmpty():
            return spark.read.schema(_ENTRIES).parquet(out).where("not is_folder").select("root_id", "rel_path", "size_bytes", "mtime_utc", "error")
        level += 1
