"""The relations that queries run on, and summaries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquarry.functions.headers import same_text


def v_frames(a) -> DataFrame:
    """Frames with their files, roots and equipment. Equipment tables have a row for each device; Spark broadcasts them by their size."""
    rigs = a.rigs.select("rig_id", "rig", "site_id").join(a.sites.select("site_id", "site"), "site_id", "left").select("rig_id", "rig", "site")
    files = a.files.select("file_id", "rel_path", "filename", "size_bytes", "file_status", "bucket")
    out = a.frames.join(files, "file_id").join(a.roots, "root_id").withColumn("abs_path", F.concat_ws("/", "path", "rel_path")).drop("path")
    return out.join(rigs, "rig_id", "left").join(a.cameras, "camera_id", "left").join(a.filters.withColumnRenamed("name", "filter"), "filter_id", "left")


def named(a) -> DataFrame:
    """Frames with the names of their rig and filter, all that the summary needs."""
    return a.frames.join(a.rigs.select("rig_id", "rig"), "rig_id", "left").join(a.filters.withColumnRenamed("name", "filter"), "filter_id", "left")


def frame_summary(frames: DataFrame) -> DataFrame:
    """Counts, exposure and first and last moment by night, type, object, rig and filter."""
    return frames.groupBy("session_night", "image_type", "object_canonical", "rig", "filter").agg(F.count("*").alias("n"), F.sum("exposure_s").alias("exposure"), F.min("date_obs_utc").alias("first_utc"), F.max("date_obs_utc").alias("last_utc"))


def rig_resolve(rigs: DataFrame, cameras: DataFrame) -> DataFrame:
    """Active rigs with their camera's name and focal range."""
    return rigs.where("active").join(cameras, "camera_id").select("rig_id", "rig", "camera", "focal_min", "focal_max")


def summary(frames: DataFrame, by: str, limit: int = 500) -> DataFrame:
    """label, image_type, n, hours: the largest groups first. Objects without a name are left out; other missing labels are '(none)'."""
    column = {"object": "object_canonical", "night": "session_night", "filter": "filter"}[by]
    rows = frames.where(F.coalesce(F.col(column), F.lit("")) != "") if by == "object" else frames
    grouped = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(none)")).alias("label"), "image_type").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("exposure_s"), F.lit(0)) / 3600, 2).alias("hours"))
    return grouped.orderBy(F.desc("n"), "label", "image_type").limit(limit)


def targets(summary_rows: DataFrame) -> DataFrame:
    """The second roll-up by target: frames, hours, types."""
    return summary_rows.groupBy("label").agg(F.sum("n").alias("frames"), F.round(F.sum("hours"), 2).alias("hours"), F.array_join(F.array_sort(F.collect_set("image_type")), ",").alias("types"))


def facet(frames: DataFrame, field: str) -> DataFrame:
    """The distinct non-empty values of rig, camera, filter or object."""
    column = {"rig": "rig", "camera": "camera", "filter": "filter", "object": "object_canonical"}[field]
    return frames.where(F.coalesce(F.col(column), F.lit("")) != "").select(F.col(column).alias("value")).distinct().orderBy("value")


def status(frames: DataFrame) -> DataFrame:
    """The tiles of the status page, in one pass."""
    return frames.agg(
        F.count("*").alias("frames"), F.count_if(F.col("image_type") == "light").alias("lights"), F.count_if(F.col("file_status") == "missing").alias("missing"), F.count_if(F.col("file_status") == "error").alias("errors"),
        F.count_distinct(F.when(F.col("object_canonical") != "", F.col("object_canonical"))).alias("objects"), F.count_distinct("session_night").alias("nights"),
    )


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def counts_with_zero(parents: DataFrame, members: DataFrame, parent_key: str, member_key: str) -> DataFrame:
    """Members of every parent, those without any included."""
    n = members.groupBy(F.col(member_key).alias(parent_key)).agg(F.count("*").alias("_n"))
    return parents.join(n, parent_key, "left").withColumn("n", F.coalesce("_n", F.lit(0))).drop("_n")


def builder(frames: DataFrame, cameras: DataFrame, rigs: DataFrame, sites: DataFrame, flat_sets: DataFrame, filters: DataFrame) -> DataFrame:
    """The lists of the equipment page in one table: kind (camera, rig, site, flat set), id, name, n (its frames, 0 included), and what it refers to:
    camera, site, active_label, rig, filter, captured_night, active, fixed (null where a kind has none).

    All four counts come from one pass over the frames, by grouping sets; the equipment tables have a row for each device."""
    sets = [F.col(c) for c in ("camera_id", "rig_id", "site_id", "flat_set_id")]
    keys = [c for c in ("camera_id", "rig_id", "site_id", "flat_set_id")]
    grouped = frames.groupingSets([[c] for c in sets], *sets).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    # the bit of a key that is grouped by is 0; the others are 1
    one = lambda k: grouped.where(F.col("_g") == 15 - (8 >> k)).where(F.col(keys[k]).isNotNull()).select(F.col(keys[k]).alias("_id"), "n")
    counted = lambda df, k: df.join(one(k), F.col(keys[k]) == F.col("_id"), "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("id", F.col(keys[k]).cast("long"))
    labels = flat_sets.select(F.col("flat_set_id").alias("active_flat_set_id"), F.col("label").alias("active_label"))
    c = counted(cameras, 0).select(F.lit("camera").alias("kind"), "id", F.col("camera").alias("name"), "n")
    r = counted(rigs, 1).join(cameras, "camera_id").join(sites.select("site_id", "site"), "site_id", "left").join(labels, "active_flat_set_id", "left").select(F.lit("rig").alias("kind"), "id", F.col("rig").alias("name"), "n", "camera", "site", "active_label")
    s = counted(sites, 2).select(F.lit("site").alias("kind"), "id", F.col("site").alias("name"), "n")
    own = rigs.select("rig_id", "rig", F.col("active_flat_set_id").alias("_active"), F.col("site_id").isNotNull().alias("fixed"))
    named = filters.select("filter_id", F.col("name").alias("filter"))
    f = counted(flat_sets, 3).join(own, "rig_id").join(named, "filter_id", "left").select(F.lit("flat set").alias("kind"), "id", F.col("label").alias("name"), "n", "rig", "filter", "captured_night", (F.col("_active") == F.col("flat_set_id")).alias("active"), "fixed")
    out = c
    for part in (r, s, f):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def objects(frames: DataFrame) -> DataFrame:
    """object (the smallest of the texts that are the same name), its canonical name and number of frames."""
    rows = frames.where(F.col("object").isNotNull()).groupBy(same_text(F.col("object")).alias("_name"))
    return rows.agg(F.min("object").alias("object"), F.max("object_canonical").alias("canonical"), F.count("*").alias("n")).drop("_name")


def detail(frames: DataFrame, cards: DataFrame, frame_tags: DataFrame, tags: DataFrame, ids: DataFrame, collection_frames: DataFrame | None = None, collections: DataFrame | None = None, artifacts: DataFrame | None = None) -> DataFrame:
    """The asked frames with their header in order and their tags by name, nested; also the names of their collections, and the artifacts (frame_id,
    kind, filename, rel_path, size_bytes, mtime_utc) beside them by file name, where these tables are given.

    All tables meet in one stage that sorts each of them. The ids set its number of tasks, which adaptive execution doesn't make fewer; where they are
    so few that they are broadcast, the other tables aren't shuffled for them."""
    ids = ids.repartition(4 * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), "frame_id")
    rows = frames.join(ids, "frame_id", "left_semi")
    header = cards.join(ids, "frame_id", "left_semi").groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "keyword", "value"))), lambda c: F.struct(c["keyword"].alias("keyword"), c["value"].alias("value"))).alias("header"))
    named = frame_tags.join(ids, "frame_id", "left_semi").join(tags.withColumnRenamed("id", "tag_id"), "tag_id").groupBy("frame_id").agg(F.array_sort(F.collect_list("name")).alias("tags"))
    out = rows.join(header, "frame_id", "left").join(named, "frame_id", "left")
    if collection_frames is not None:
        held = collection_frames.join(ids, "frame_id", "left_semi").join(collections.withColumnRenamed("id", "collection_id"), "collection_id").groupBy("frame_id").agg(F.array_sort(F.collect_list("name")).alias("collections"))
        out = out.join(held, "frame_id", "left")
    if artifacts is not None:
        beside = artifacts.join(ids, "frame_id", "left_semi").groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("filename", "kind", "rel_path", "size_bytes", "mtime_utc"))).alias("artifacts"))
        out = out.join(beside, "frame_id", "left")
    return out


def first_card(cards: DataFrame, keywords: list[str], alias: str) -> DataFrame:
    """frame_id and the value of the first of the keywords that a frame has, by their order."""
    order: Column = F.array_position(F.array(*(F.lit(k) for k in keywords)), F.col("keyword"))
    return cards.where(F.col("keyword").isin(*keywords)).groupBy("frame_id").agg(F.min_by("value", F.struct(order, F.col("ord"))).alias(alias))
