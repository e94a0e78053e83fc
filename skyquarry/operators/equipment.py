"""The equipment registry: cameras, filters, rigs and sites of frames in one plan, unseen devices included.

All look-ups are made for distinct names or distinct pairs of camera and focal length, not for frames. Names are equal without regard to case, accents
and blanks at the end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquarry.functions.headers import same_text


@dataclass(frozen=True)
class Registry:
    """cameras (camera_id, camera), camera_aliases (alias, camera, priority), filters (filter_id, name), filter_aliases (alias, filter_id), rigs
    (rig_id, camera_id, focal_min, focal_max, site_id, active)."""

    cameras: DataFrame
    camera_aliases: DataFrame
    filters: DataFrame
    filter_aliases: DataFrame
    rigs: DataFrame
    default_site: int | None = None


@dataclass(frozen=True)
class Resolved:
    """frames with camera_id, filter_id, rig_id, site_id; the cameras and filters with those that were new."""

    frames: DataFrame
    cameras: DataFrame
    filters: DataFrame


#: The number of characters by which aliases and names meet.
GRAM = 3


def _grams(text: Column) -> Column:
    """All runs of GRAM characters of a text; the text itself where it is shorter."""
    return F.when(F.char_length(text) <= GRAM, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(text) - GRAM + 1), lambda i: text.substr(i, F.lit(GRAM))))


def camera_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """instrument, camera: by the first alias (priority, then text) that the name contains, else its model number, else null.

    An alias is looked for where the name has the alias's first characters, so names and aliases are not all compared; aliases shorter than that are few
    and are compared with all names. names: distinct instruments."""
    a = aliases.where("alias <> ''").select(F.lower("alias").alias("_alias"), F.col("camera").alias("_camera"), "priority")
    low = names.withColumn("_low", F.lower("instrument"))
    long = low.withColumn("_gram", F.explode(F.array_distinct(_grams(F.col("_low"))))).join(a.where(F.char_length("_alias") >= GRAM).withColumn("_gram", F.substring("_alias", 1, GRAM)), "_gram").drop("_gram")
    short = low.join(a.where(F.char_length("_alias") < GRAM), F.col("_low").contains(F.col("_alias")))
    pairs = long.where(F.col("_low").contains(F.col("_alias"))).unionByName(short)
    hit = pairs.groupBy("instrument").agg(F.min_by("_camera", F.struct("priority", "_alias")).alias("_camera"))
    model = F.nullif(F.regexp_replace(F.upper(F.regexp_extract("instrument", r"(?i)ASI\s?\d{3,4}", 0)), r"\s", ""), F.lit(""))
    return names.join(hit, "instrument", "left").select("instrument", F.coalesce("_camera", model).alias("camera"))


def with_new(known: DataFrame, names: DataFrame, key: str, column: str) -> DataFrame:
    """known (key, column) with a row for each of names (column) that it lacks: new ids follow the largest, in the order of the names, so that the
    same names give the same ids. Of several spellings the smallest is kept."""
    lacking = names.where(F.col(column).isNotNull()).groupBy(same_text(F.col(column)).alias("_name")).agg(F.min(column).alias(column)).join(known.select(same_text(F.col(column)).alias("_name")), "_name", "left_anti")
    kind = dict(known.dtypes)[key]
    rows = known.select(F.col(key), column).unionByName(lacking.select(F.lit(None).cast(kind).alias(key), column))
    # one window over all devices, which are few: a new one's place after the largest id
    everything = Window.orderBy(F.col(key).isNotNull().desc(), F.lower(column), column)
    place, old, top = F.row_number().over(everything), F.count(key).over(Window.partitionBy()), F.coalesce(F.max(key).over(Window.partitionBy()), F.lit(0))
    return rows.select(F.coalesce(F.col(key), top + place - old).cast(kind).alias(key), column)


def _ids(names: DataFrame, table: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """names (name, column) with the smallest id of that text in the table, as `_id`."""
    t = table.groupBy(same_text(F.col(column)).alias("_name")).agg(F.min(key).alias("_id"))
    return names.withColumn("_name", same_text(F.col(column))).join(t, "_name", "left").select(name, "_id")


def rigs_of(pairs: DataFrame, rigs: DataFrame, step: int = 50) -> DataFrame:
    """camera_id, focal_len_mm, rig_id, _site: the first active rig (by id) of a camera whose focal range holds the focal length; ranges and lengths meet by
    steps of `step` millimetres."""
    r = rigs.where("active and focal_min <= focal_max").withColumn("_step", F.explode(F.sequence(F.floor(F.col("focal_min") / step), F.floor(F.col("focal_max") / step))))
    r = r.select("camera_id", "_step", "focal_min", "focal_max", F.struct("rig_id", "site_id").alias("_rig"))
    hit = pairs.withColumn("_step", F.floor(F.col("focal_len_mm") / step)).join(r, ["camera_id", "_step"]).where("focal_len_mm between focal_min and focal_max")
    return hit.groupBy("camera_id", "focal_len_mm").agg(F.min("_rig").alias("_rig")).select("camera_id", "focal_len_mm", F.col("_rig.rig_id").alias("rig_id"), F.col("_rig.site_id").alias("_site"))


def resolve(frames: DataFrame, registry: Registry) -> Resolved:
    """frames (instrument, filter_raw, focal_len_mm) with the ids of their devices.

    Camera: by alias or model, registered where it is new; null without either. Filter: by alias, else by name, else registered; null without a text.
    Rig: by camera and focal length. Site: the rig's, else the default one."""
    instruments = camera_names(frames.select("instrument").where("instrument is not null").distinct(), registry.camera_aliases)
    cameras = with_new(registry.cameras, instruments.select("camera"), "camera_id", "camera")
    camera_ids = _ids(instruments, cameras, "camera_id", "camera", "instrument").withColumnRenamed("_id", "camera_id")
    raw = frames.select("filter_raw").where("filter_raw is not null").distinct().withColumn("name", F.col("filter_raw"))
    by_alias = _ids(raw, registry.filter_aliases.withColumnRenamed("alias", "name"), "filter_id", "name", "filter_raw")
    unknown = by_alias.where("_id is null").select(F.col("filter_raw").alias("name"))
    filters = with_new(registry.filters, unknown, "filter_id", "name")
    by_name = _ids(raw, filters, "filter_id", "name", "filter_raw").withColumnRenamed("_id", "_named")
    filter_ids = by_alias.join(by_name, "filter_raw").select("filter_raw", F.coalesce("_id", "_named").alias("filter_id"))
    out = frames.join(camera_ids, "instrument", "left").join(filter_ids, "filter_raw", "left")
    found = rigs_of(out.select("camera_id", "focal_len_mm").where("camera_id is not null and focal_len_mm is not null").distinct(), registry.rigs)
    out = out.join(found, ["camera_id", "focal_len_mm"], "left").withColumn("site_id", F.coalesce("_site", F.lit(registry.default_site).cast("int")))
    return Resolved(out.select(*frames.columns, "camera_id", "filter_id", "rig_id", "site_id"), cameras, filters)
