"""Actions over a result set, as plans: what would be staged, moved or exported. Nothing here touches the files themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquarry.functions.headers import csv_cell, safe_leaf
from skyquarry.plans.filter_ast import Context, compile_filter

LIMIT = 100_000


def by_ids(frames: DataFrame, ids: DataFrame) -> DataFrame:
    return frames.join(ids.select("frame_id").distinct(), "frame_id", "left_semi")


def by_filter(frames: DataFrame, node: dict, ctx: Context | None = None, limit: int = LIMIT) -> DataFrame:
    """The newest matching frames, at most `limit`."""
    return frames.where(compile_filter(node, ctx)).orderBy(F.col("date_obs_utc").desc_nulls_last(), "frame_id").limit(limit)


def stage_plan(frames: DataFrame, target: str, how: str = "symlink") -> DataFrame:
    """frame_id, src, dst, action: a folder for each type; equal names get _1, _2, ... in the order of frame_id."""
    leaf = safe_leaf(F.col("filename"))
    nth = F.row_number().over(Window.partitionBy("image_type", "_leaf").orderBy("frame_id")) - 1
    numbered = frames.withColumn("_leaf", leaf).withColumn("_n", nth)
    stem, end = F.regexp_replace("_leaf", r"(\.[^.]*)$", ""), F.regexp_extract("_leaf", r"(\.[^.]*)$", 1)
    name = F.when(F.col("_n") == 0, F.col("_leaf")).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), end))
    return numbered.select("frame_id", F.col("abs_path").alias("src"), F.concat_ws("/", F.lit(target.rstrip("/")), F.col("image_type"), name).alias("dst"), F.lit(how).alias("action"))


def move_plan(frames: DataFrame, root_path: str, folder: str, action: str = "move") -> DataFrame:
    """frame_id, src, dst, rel_path (the new place in the index) of a move, copy or trash; `archive.write_back` takes those that went well in."""
    rel = F.concat_ws("/", F.lit(folder.strip("/")), safe_leaf(F.col("filename")))
    return frames.select("frame_id", F.col("abs_path").alias("src"), F.concat_ws("/", F.lit(root_path.rstrip("/")), rel).alias("dst"), rel.alias("rel_path"), F.lit(action).alias("action"))


def export_lines(frames: DataFrame, kind: str = "paths", columns: tuple[str, ...] = ("frame_id", "image_type", "abs_path")) -> DataFrame:
    """frame_id, line: paths, json objects or csv rows; write with df.select("line").write.text(...)."""
    if kind == "paths":
        line = F.col("abs_path")
    elif kind == "json":
        line = F.to_json(F.struct(*columns))
    else:
        line = F.concat_ws(",", *(csv_cell(F.col(c)) for c in columns))
    return frames.select("frame_id", line.alias("line"))


def export(frames: DataFrame, folder: str, kind: str = "csv", order: tuple[Column | str, ...] = ("frame_id",)) -> None:
    """Writes frames (frame_id, image_type, filename, abs_path) to a new folder, in their order over its files by name: paths, json lines or csv.

    Spark's own writers do it: files appear together when all tasks have ended, and a failed export leaves none. A folder that is there is refused."""
    rows = frames.orderBy(*order).select("frame_id", "image_type", "filename", F.col("abs_path").alias("path"))
    if kind == "paths":
        rows.select("path").write.text(folder)
    elif kind == "json":
        rows.write.option("ignoreNullFields", False).json(folder)
    elif kind == "csv":
        rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)
    else:
        raise ValueError(f"unknown kind of export: {kind}")


def ledger(job: str, plan: DataFrame, state: str = "planned") -> DataFrame:
    """Rows for the job ledger."""
    return plan.select(F.lit(job).alias("job"), "frame_id", "src", "dst", "action", F.lit(state).alias("state"))


def saved_paths(v_frames: DataFrame, name: str, node: dict, context: Context | None = None) -> DataFrame:
    """name, abs_path: a saved query's frames as they are now."""
    return v_frames.where(compile_filter(node, context)).select(F.lit(name).alias("name"), "abs_path")


def saved_run(saved: DataFrame, name: str, paths: DataFrame, now: Column) -> DataFrame:
    """saved (name, last_run_at, last_count, ...) after a run of one query that found `paths`."""
    n = paths.agg(F.count("*").alias("_n"))
    mine = F.col("name") == name
    both = saved.join(F.broadcast(n))  # one row
    return both.withColumns({"last_run_at": F.when(mine, now).otherwise(F.col("last_run_at")), "last_count": F.when(mine, F.col("_n")).otherwise(F.col("last_count"))}).drop("_n")
