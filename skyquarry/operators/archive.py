"""Equipment resolution, reconciliation of sweeps, and updates as rewritten snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquarry.functions.headers import same_text
from skyquarry.operators.equipment import with_new

FORMATS = {"fits": "fits", "fit": "fits", "fts": "fits", "fz": "fits", "xisf": "xisf"}
SIDECARS = {"txt": "sidecar", "json": "sidecar", "log": "log", "csv": "csv"}
BUCKETS = ("lights", "darks", "flats", "bias", "masters", "calibration")


# -- listings

def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def _choice(value: Column, pairs: dict[str, str]) -> Column:
    out = None
    for k, v in pairs.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out


def file_format(path: Column) -> Column:
    plain = F.regexp_replace(path, r"(?i)\.gz$", "")
    return F.coalesce(_choice(extension(plain), FORMATS), F.lit("other"))


def sidecar_kind(path: Column) -> Column:
    return _choice(extension(path), SIDECARS)


def bucket(rel_path: Column) -> Column:
    first = F.lower(F.split(rel_path, "/")[0])
    return F.when(F.instr(rel_path, "/") == 0, "other").when(first.startswith("calib"), "calibration").when(first.isin(*BUCKETS), first).otherwise("other")


def ignored(rel_path: Column, patterns: list[str]) -> Column:
    """Whether any component has an ignored name: exact, or with * and ? as a glob; case does not matter."""
    out = F.lit(False)
    for p in patterns:
        regex = "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\Q" + c + "\\E" for c in p.lower()) + "$"
        out = out | F.exists(F.split(F.lower(rel_path), "/"), _like(regex))
    return out


def _like(regex: str):
    return lambda x: x.rlike(regex)


def ignore_list(text: str | None) -> list[str]:
    """Names divided by commas or line ends."""
    return [p.strip() for p in (text or "").replace("\n", ",").split(",") if p.strip()]


def path_hash(rel_path: Column, case_sensitive: bool = True) -> Column:
    return F.md5(rel_path if case_sensitive else F.lower(rel_path))


def root_of(paths: DataFrame, roots: DataFrame, column: str = "abs_path") -> DataFrame:
    """Each path with the root whose folder is its longest prefix of whole components; roots are few."""
    r = roots.select(F.col("root_id").alias("_root"), F.rtrim("path", F.lit("/")).alias("_path"))
    parts = F.split(F.col(column), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    exploded = paths.select(column, F.explode(prefixes).alias("_path"))
    best = exploded.join(r, "_path").groupBy(column).agg(F.max_by("_root", F.char_length("_path")).alias("root_of_path"))
    return paths.join(best, column, "left")


# -- sweeps

def classify(listing: DataFrame, known: DataFrame, now: Column, settle_seconds: int = 30, carry: dict[str, str] | None = None) -> DataFrame:
    """The listing (root_id, rel_path, size_bytes, mtime_utc) with its action: settling, skip, update or add. A file is the same if its size and time
    are; where the listing tells a file's content too (etag), that must be the known content_key. carry: names under which columns of known are kept."""
    told = [F.col("content_key").alias("_etag")] if "etag" in listing.columns else []
    old = known.select("root_id", "rel_path", F.col("size_bytes").alias("_size"), F.date_trunc("second", "mtime_utc").alias("_mtime"), F.col("file_status").alias("_status"), *told, *(F.col(c).alias(name) for name, c in (carry or {}).items()))
    age = F.timestamp_diff("SECOND", "mtime_utc", now)
    same = (F.col("_status") == "ok") & (F.col("_size") == F.col("size_bytes")) & (F.col("_mtime") == F.date_trunc("second", "mtime_utc"))
    same = same & F.col("_etag").eqNullSafe(F.col("etag")) if told else same
    action = F.when(age < settle_seconds, "settling").when(F.col("_status").isNull(), "add").when(same, "skip").otherwise("update")
    return listing.join(old, ["root_id", "rel_path"], "left").withColumn("action", action).drop("_size", "_mtime", "_status", "_etag", "etag")


def scan_stats(classified: DataFrame) -> DataFrame:
    return classified.groupBy("action").agg(F.count("*").alias("n"))


def content_key(frames: DataFrame, block: int = 4096) -> DataFrame:
    """file_id and its fingerprints in the order of HDUs, as one key. Blocks of HDUs are joined first, so that no task gathers all rows of a file."""

    def joined(df: DataFrame, keys: list[str], order: str, text: str, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct(order, text)))
        return df.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p[text]), ";").alias(name), F.count(text).alias("_n"))

    parts = joined(frames.withColumn("_block", F.floor(F.col("hdu") / block)), ["file_id", "_block"], "hdu", "fingerprint", "_part")
    parts = parts.withColumn("_part", F.when(F.col("_n") > 0, F.col("_part")))  # a block of nulls alone adds no separator
    return joined(parts, ["file_id"], "_block", "_part", "content_key").drop("_n")


def content_digest(frames: DataFrame) -> DataFrame:
    """file_id and a key of fixed size that is the same for files with the same fingerprints in the same HDUs: their number and two sums of 60-bit parts of the
    MD5 of HDU and fingerprint. Sums are added up before anything is shuffled, so a file with very many HDUs is no heavier than others and no task gathers its
    rows; null fingerprints don't count, a file that has no others gets the empty key. For `moves` and sweeps it does what `content_key` does; only HDUs that are numbered
    otherwise make another key here."""
    half = lambda at: F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("hdu").cast("string"), F.lit("")), "fingerprint")), at, 15), 16, 10).cast("decimal(20,0)")
    known = F.col("fingerprint").isNotNull()
    sums = frames.groupBy("file_id").agg(F.count("fingerprint").alias("_n"), *(F.sum(F.when(known, half(at))).alias(name) for at, name in ((1, "_a"), (17, "_b"))))
    return sums.select("file_id", F.when(F.col("_n") == 0, "").otherwise(F.concat_ws("-", F.col("_n").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string"))).alias("content_key"))


def moves(vanished: DataFrame, appeared: DataFrame) -> DataFrame:
    """old_id, new_id of files (file_id, content_key) that moved: the key is not empty and occurs once on each side."""

    def once(df: DataFrame, name: str) -> DataFrame:
        return df.where("content_key <> ''").groupBy("content_key").agg(F.count("*").alias("_n"), F.min("file_id").alias(name)).where("_n = 1").drop("_n")

    return once(vanished, "old_id").join(once(appeared, "new_id"), "content_key").select("old_id", "new_id")


def mount_guard(listing: DataFrame, known: DataFrame) -> DataFrame:
    """root_id, seen, known_ok, safe: whether a sweep saw enough of a root to conclude that files are gone: something, and at least half of
    what was there. A root without known files is safe."""
    seen = listing.groupBy("root_id").agg(F.count("*").alias("seen"))
    ok = known.groupBy("root_id").agg(F.count(F.when(F.col("file_status") == "ok", 1)).alias("known_ok"))
    both = ok.join(seen, "root_id", "full").select("root_id", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("known_ok", F.lit(0)).alias("known_ok"))
    return both.withColumn("safe", (F.col("known_ok") == 0) | (F.col("seen") > 0) & (F.col("seen") >= F.floor(F.col("known_ok") / 2)))


def new_file_id(root_id: Column, rel_path: Column) -> Column:
    """An id for a new file from its place, 60 bits; no counter has to be shared."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", root_id.cast("string"), rel_path)), 1, 15), 16, 10).cast("long")


def sweep(listing: DataFrame, known: DataFrame, read: DataFrame, now: Column, settle_seconds: int = 30) -> DataFrame:
    """One sweep: the snapshot of files after it, with `outcome` (skip, add, update, error, settling, moved, missing, kept).

    listing: root_id, rel_path, size_bytes, mtime_utc. known: these, file_id, file_status, last_seen_utc and content_key. read: root_id, rel_path,
    content_key and error of the files that were read. Files that are no longer listed move to where their content key appeared, if it is
    unambiguous, and keep their id; else they are marked missing. Where the mount guard of their root isn't safe they are kept. Files that still settle
    keep their row, if they have one, and are not added."""
    place = ["root_id", "rel_path"]
    columns = ["file_id", "root_id", "rel_path", "size_bytes", "mtime_utc", "file_status", "last_seen_utc", "content_key", "outcome"]
    before = {"file_id": "file_id", "_key": "content_key", "_seen": "last_seen_utc", "_was": "file_status", "_size0": "size_bytes", "_mtime0": "mtime_utc"}
    listed = classify(listing, known, now, settle_seconds, before).join(read.select(*place, "content_key", "error"), place, "left")
    action, fresh = F.col("action"), F.col("action").isin("add", "update")
    still = F.col("action") == "settling"
    touched = listed.where(~still | F.col("file_id").isNotNull()).select(
        F.coalesce("file_id", new_file_id(F.col("root_id"), F.col("rel_path"))).alias("file_id"), *place,
        F.when(still, F.col("_size0")).otherwise(F.col("size_bytes")).alias("size_bytes"), F.when(still, F.col("_mtime0")).otherwise(F.col("mtime_utc")).alias("mtime_utc"),
        F.when(fresh & F.col("error").isNotNull(), "error").when(still, F.col("_was")).otherwise("ok").alias("file_status"), F.when(still, F.col("_seen")).otherwise(now).alias("last_seen_utc"),
        F.when(fresh, F.coalesce("content_key", F.lit(""))).otherwise(F.col("_key")).alias("content_key"), F.when(fresh & F.col("error").isNotNull(), "error").otherwise(action).alias("outcome"), (action == "add").alias("_new"),
    )
    absent = known.select(*columns[:-1]).join(listing.select(place), place, "left_anti")
    guarded = absent.join(mount_guard(listing, known).select("root_id", "safe"), "root_id")
    gone = guarded.where(F.col("safe") & (F.col("file_status") != "missing")).drop("safe")
    kept = guarded.where(~F.col("safe") | (F.col("file_status") == "missing")).drop("safe").withColumn("outcome", F.lit("kept"))
    by_root = lambda df: df.select("file_id", F.when(F.col("content_key") != "", F.concat_ws("|", F.col("root_id").cast("string"), "content_key")).otherwise(F.lit("")).alias("content_key"))
    moved = moves(by_root(gone), by_root(touched.where("_new")))
    files = touched.drop("_new").unionByName(gone.withColumn("outcome", F.lit("missing")).withColumn("file_status", F.lit("missing"))).unionByName(kept)
    anchored = re_anchor(files.select(columns), moved, outcome="moved")
    return anchored.select(columns)


def write_back(files: DataFrame, done: DataFrame, roots: DataFrame, now: Column) -> DataFrame:
    """files after operations on them (file_id, dst, action, state) without waiting for a sweep: of a move or trash that went well, a destination below a
    known root becomes the file's place (status ok, seen now); below none, the file has left the archive and is missing. Copies, links and failed
    operations change nothing; of several operations on a file the last destination by its text counts."""
    gone = done.where("action in ('move', 'trash') and state = 'ok'").groupBy("file_id").agg(F.max("dst").alias("_dst"))
    folder = roots.select(F.col("root_id").alias("root_of_path"), F.rtrim("path", F.lit("/")).alias("_base"))
    placed = root_of(gone, roots, "_dst").join(folder, "root_of_path", "left")
    placed = placed.select("file_id", F.col("root_of_path").alias("_root"), F.when(F.col("_base").isNotNull(), F.substring(F.col("_dst"), F.char_length("_base") + 2, F.char_length("_dst"))).alias("_rel"), F.lit(True).alias("_hit"))
    new = {"root_id": F.coalesce("_root", "root_id"), "rel_path": F.coalesce("_rel", "rel_path"), "file_status": F.when(F.col("_root").isNotNull(), "ok").otherwise("missing"), "last_seen_utc": F.when(F.col("_root").isNotNull(), now).otherwise(F.col("last_seen_utc"))}
    return files.join(placed, "file_id", "left").withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in new.items()}).select(*files.columns)


def missing(known: DataFrame, listing: DataFrame) -> DataFrame:
    """Known files with status ok that the listing no longer has."""
    return known.where("file_status = 'ok'").join(listing.select("root_id", "rel_path"), ["root_id", "rel_path"], "left_anti")


def prunable(files: DataFrame, now: Column, days: int = 0) -> DataFrame:
    """Missing files, not seen for `days` days."""
    gone = files.where("file_status = 'missing'")
    return gone.where(F.col("last_seen_utc") < now - F.make_interval(days=F.lit(days))) if days > 0 else gone


def epoch_text(seconds: Column) -> Column:
    """Seconds since 1970 as UTC text (2024-03-01 12:00:00); null for null."""
    return F.date_format(F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=seconds), "yyyy-MM-dd HH:mm:ss")


def due_roots(roots: DataFrame, now: Column) -> DataFrame:
    """Enabled roots with an interval that were never scanned or are overdue, the most overdue first."""
    late = F.col("last_scan_utc").isNull() | (F.col("last_scan_utc") + F.make_interval(mins=F.col("interval_minutes")) <= now)
    return roots.where(F.col("enabled") & (F.col("interval_minutes") > 0) & late).orderBy(F.col("last_scan_utc").asc_nulls_first(), "root_id")


def link_sidecars(sidecars: DataFrame, files: DataFrame, frames: DataFrame) -> DataFrame:
    """Each sidecar with the first frame of the image beside it: the image's name up to its last dot, then a dot, begins the sidecar's."""
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    stem = F.regexp_replace(F.col("rel_path"), r"\.[^./]+$", "")
    images = files.join(frames.groupBy("file_id").agg(F.min("frame_id").alias("frame_id")), "file_id").select("root_id", folder(F.col("rel_path")).alias("_dir"), stem.alias("_stem"), "frame_id")
    # every dot of the sidecar's name ends a possible stem, so the join is by equality
    leaf = F.regexp_extract("rel_path", r"([^/]*)$", 1)
    words = F.split(leaf, r"\.")
    stems = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, 1, i), "."))
    asked = sidecars.withColumn("_dir", folder(F.col("rel_path"))).withColumn("_s", F.explode(stems)).withColumn("_stem", F.concat("_dir", "_s"))
    found = asked.join(images, ["root_id", "_dir", "_stem"]).groupBy("root_id", "rel_path").agg(F.min("frame_id").alias("frame_id"))
    return sidecars.join(found, ["root_id", "rel_path"], "left")


# -- equipment

def resolve_camera(frames: DataFrame, aliases: DataFrame, column: str = "instrument") -> DataFrame:
    """camera by the first alias (by priority) that the instrument's name contains, else its model, else null. Aliases are few."""
    a = aliases.select(F.lower("alias").alias("_alias"), F.col("camera").alias("_camera"), "priority")
    names = frames.select(column).where(F.col(column).isNotNull()).distinct()  # names, not frames, meet the aliases
    hit = names.join(a, F.lower(column).contains(F.col("_alias"))).groupBy(column).agg(F.min_by("_camera", F.struct("priority", "_alias")).alias("_camera"))
    model = F.nullif(F.regexp_replace(F.upper(F.regexp_extract(column, r"(?i)ASI\s?\d{3,4}", 0)), r"\s", ""), F.lit(""))
    return frames.join(hit, column, "left").withColumn("camera", F.coalesce("_camera", model)).drop("_camera")


def resolve_filter(frames: DataFrame, aliases: DataFrame, filters: DataFrame, column: str = "filter_raw") -> DataFrame:
    """filter_id by alias, else by name; case does not matter."""
    low = F.lower(column)
    a = aliases.groupBy(F.lower("alias").alias("_low")).agg(F.min("filter_id").alias("_a"))
    n = filters.groupBy(F.lower("name").alias("_low")).agg(F.min("filter_id").alias("_n"))
    return frames.withColumn("_low", low).join(a, "_low", "left").join(n, "_low", "left").withColumn("filter_id", F.coalesce("_a", "_n")).drop("_low", "_a", "_n")


def resolve_rig(frames: DataFrame, rigs: DataFrame) -> DataFrame:
    """resolved_rig: the smallest active rig of the frame's camera whose focal range holds its focal length; joined for distinct pairs only."""
    pairs = frames.select("camera_id", "focal_len_mm").distinct()
    r = rigs.where("active").select("camera_id", "focal_min", "focal_max", "rig_id")
    hit = pairs.join(r, "camera_id").where("focal_len_mm between focal_min and focal_max").groupBy("camera_id", "focal_len_mm").agg(F.min("rig_id").alias("resolved_rig"))
    return frames.join(hit, ["camera_id", "focal_len_mm"], "left")


def _steps(low: Column, high: Column, step: int) -> Column:
    return F.explode(F.sequence(F.floor(low / step), F.floor(high / step)))


def rig_back_fill(frames: DataFrame, rigs: DataFrame, step: int = 50) -> DataFrame:
    """frames with rig_id, and site_id where the rig has one, of the last rig (by id) of the frame's camera whose focal range holds its focal length: what
    adding the rigs one after another leaves. Frames without such a rig keep theirs.

    Ranges and focal lengths meet by steps of `step` millimetres, so a camera with many narrow ranges is no join of all with all; only distinct focal
    lengths are joined."""
    asked = frames.where("camera_id is not null and focal_len_mm is not null").select("camera_id", "focal_len_mm").distinct().withColumn("_step", F.floor(F.col("focal_len_mm") / step))
    ranges = rigs.where("focal_min <= focal_max").select("camera_id", "focal_min", "focal_max", F.struct("rig_id", "site_id").alias("_rig"), _steps(F.col("focal_min"), F.col("focal_max"), step).alias("_step"))
    hit = asked.join(ranges, ["camera_id", "_step"]).where("focal_len_mm between focal_min and focal_max").groupBy("camera_id", "focal_len_mm").agg(
        F.max_by(F.col("_rig.rig_id"), F.col("_rig.rig_id")).alias("_new"), F.max_by(F.col("_rig.site_id"), F.when(F.col("_rig.site_id").isNotNull(), F.col("_rig.rig_id"))).alias("_site")
    )
    out = frames.join(hit, ["camera_id", "focal_len_mm"], "left")
    return out.withColumns({"rig_id": F.coalesce("_new", "rig_id"), "site_id": F.coalesce("_site", "site_id")}).select(frames.columns)


def assign_site(frames: DataFrame, places: DataFrame, sites: DataFrame, metres: float) -> DataFrame:
    """frames with site_id of the nearest of the sites within `metres` of the frame's place (frame_id, lat, lon); others keep theirs."""
    from skyquarry.operators.cluster import sites_within

    near = sites_within(places, sites, metres).where("site_id is not null").select("frame_id", F.col("site_id").alias("_site"))
    return frames.join(near, "frame_id", "left").withColumn("site_id", F.coalesce("_site", "site_id")).select(frames.columns)


def resolve_site(frames: DataFrame, rigs: DataFrame, default_site: int | None = None, column: str = "rig_id") -> DataFrame:
    """frames with resolved_site: the site of the rig, else the default one."""
    r = rigs.select(F.col("rig_id").alias("_rig"), F.col("site_id").alias("_site"))
    return frames.join(r, F.col(column) == F.col("_rig"), "left").withColumn("resolved_site", F.coalesce("_site", F.lit(default_site).cast("int"))).drop("_rig", "_site")


def night_offset(sites: DataFrame, default_site: int | None, other: float = 0.0) -> float:
    """The hours from UTC by which nights are told: `other` where it isn't 0, else those of the default site (utc_offset_hours), if there is one."""
    row = sites.where(F.col("site_id") == default_site).select("utc_offset_hours").first() if default_site is not None and other == 0 else None
    return float(row[0]) if row and row[0] is not None else other


def _renames(mapping: DataFrame) -> DataFrame:
    """_name (folded) and _canonical of a mapping of names; empty names change nothing, of names that are equal the largest result counts."""
    return mapping.where("canonical <> ''").groupBy(same_text(F.col("raw")).alias("_name")).agg(F.max("canonical").alias("_canonical"))


def apply_names(frames: DataFrame, mapping: DataFrame) -> DataFrame:
    """frames with object_canonical by mapping (raw, canonical), where the raw object is the same text (`same_text`)."""
    hit = frames.withColumn("_name", same_text(F.col("object"))).join(_renames(mapping), "_name", "left")
    return hit.withColumn("object_canonical", F.coalesce("_canonical", "object_canonical")).drop("_name", "_canonical")


def recorded_names(names: DataFrame, frames: DataFrame, mapping: DataFrame) -> DataFrame:
    """The table of known names (raw, canonical) after `apply_names`: every renamed object of the frames has its new name there, once for each text."""
    used = frames.where("object is not null").select(same_text(F.col("object")).alias("_name"), F.col("object").alias("raw")).groupBy("_name").agg(F.min("raw").alias("raw"))
    new = used.join(_renames(mapping), "_name").select("_name", "raw", F.col("_canonical").alias("canonical"))
    old = names.withColumn("_name", same_text(F.col("raw"))).join(new.select("_name"), "_name", "left_anti")
    return old.select("raw", "canonical").unionByName(new.select("raw", "canonical"))


def preview_names(frames: DataFrame, mapping: DataFrame) -> DataFrame:
    """raw (the mapping's), canonical, frames: how many frames `apply_names` would change, for names with some."""
    m = mapping.where("canonical <> ''").groupBy(same_text(F.col("raw")).alias("_name")).agg(F.max("canonical").alias("canonical"), F.min("raw").alias("raw"))
    counts = frames.where("object is not null").groupBy(same_text(F.col("object")).alias("_name"), "object_canonical").agg(F.count("*").alias("_n"))
    return counts.join(m, "_name").where(~F.col("object_canonical").eqNullSafe(F.col("canonical"))).groupBy("raw", "canonical").agg(F.sum("_n").alias("frames"))


def register(names: DataFrame, known: DataFrame, column: str, key: str) -> DataFrame:
    """known (key, column) and the names it lacks (as `same_text` tells), with new keys after the largest, in the order of the names."""
    return with_new(known, names, key, column)


# -- updates as snapshots

def _by_key(df: DataFrame, keys: list[str], folded: tuple[str, ...]) -> DataFrame:
    """df with _k0, _k1, ...: its keys, folded ones as `same_text`."""
    return df.withColumns({f"_k{i}": same_text(F.col(k)) if k in folded else F.col(k) for i, k in enumerate(keys)})


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), folded: tuple[str, ...] = ()) -> DataFrame:
    """new over old; columns in `keep` stay as they were where the row was there.

    folded: keys that are names, equal whatever their case, accents and blanks at the end; the row that was there keeps its spelling of them. New rows
    must be unique by their keys."""
    keep, on = (*keep, *(f for f in folded if f not in keep)), [f"_k{i}" for i in range(len(keys))]
    before, after = _by_key(old, keys, folded), _by_key(new, keys, folded)
    stay = before.join(after.select(on), on, "left_anti").select(old.columns)
    if not keep:
        return stay.unionByName(new)
    was = before.select(*on, *(F.col(c).alias(f"_{c}") for c in keep))
    merged = after.join(was, on, "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in keep}).select(*new.columns)
    return stay.unionByName(merged)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def cascade_delete(parents: DataFrame, gone: DataFrame, key: str, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the rows of `gone`: parents under '' and each child by name."""
    ids = gone.select(key).distinct()
    return {"": parents.join(ids, key, "left_anti")} | {n: c.join(ids, key, "left_anti") for n, c in children.items()}


def re_anchor(files: DataFrame, moved: DataFrame, outcome: str | None = None) -> DataFrame:
    """Moved files under their old ids: the new row's place, the old row's file_id; the old row goes. outcome: the new value of that column.

    Both sides of a move meet the files in one join, so neither files nor moves are worked out twice."""
    ends = F.array(F.struct(F.col("new_id").alias("_id"), F.col("old_id").alias("_to")), F.struct(F.col("old_id").alias("_id"), F.lit(None).cast(dict(moved.dtypes)["old_id"]).alias("_to")))
    known = moved.select(F.inline(ends)).groupBy("_id").agg(F.max("_to").alias("_to"), F.lit(True).alias("_hit"))
    rows = files.join(known, F.col("file_id") == F.col("_id"), "left").where(F.col("_hit").isNull() | F.col("_to").isNotNull())
    values = {"file_id": F.coalesce("_to", "file_id")} | ({"outcome": F.when(F.col("_to").isNotNull(), outcome).otherwise(F.col("outcome"))} if outcome else {})
    return rows.withColumns(values).select(*files.columns)


def set_where(df: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """column replaced by the value in `changes` where the keys are there."""
    c = changes.select(*keys, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    return df.join(c, keys, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).select(*df.columns)
