"""Queries of scans that keep state: walks, discovery, sweeps one after another, and what they write back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquarry.functions import headers
from skyquarry.operators import actions, archive, cluster, equipment, rescan, views
from skyquarry.operators.progress import Scans
from skyquarry.queries import ID, ORACLES, QUERIES, query
from skyquarry.queries import _cards as cards_of
from skyquarry.session import new_folder
from skyquarry.sources.walk import walk
from skyquarry.streaming.discovery import Discovery, discover

_PLACE = "CAST(CONCAT('0x', SUBSTR(md5(CONCAT(root_id, '|', rel_path)), 1, 15)) AS BIGINT)"
#: Three listings of the files, each with a content key and, for some files, an error: at first some are not there yet; then some have moved, changed or gone; then more have gone.
_LISTINGS = (
    "SELECT root_id, rel_path, size_bytes, mtime_utc, CONCAT('k', CAST(file_id AS STRING)) AS content_key, CAST(NULL AS STRING) AS error FROM files WHERE file_id % 10 <> 0",
    """SELECT root_id, CASE WHEN file_id % 20 = 3 THEN CONCAT('moved/', filename) ELSE rel_path END AS rel_path, CASE WHEN file_id % 20 = 5 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, mtime_utc,
    CONCAT('k', CAST(file_id AS STRING)) AS content_key, CASE WHEN file_id % 40 = 5 THEN 'no image' END AS error FROM files WHERE file_id % 20 <> 4""",
    """SELECT root_id, CASE WHEN file_id % 20 = 3 THEN CONCAT('moved/', filename) ELSE rel_path END AS rel_path, CASE WHEN file_id % 20 = 5 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, mtime_utc,
    CONCAT('k', CAST(file_id AS STRING)) AS content_key, CAST(NULL AS STRING) AS error FROM files WHERE file_id % 20 NOT IN (4, 7)""",
)
_TIMES = ("2024-03-01 12:00:00", "2024-03-01 13:00:00", "2024-03-01 14:00:00")
#: Minutes between the sweeps of a root; root 2 is never swept by itself.
_INTERVALS = ((0, 30), (1, 90), (2, 0))
_DUE = ((0, 1), (0,), (0, 1))


def _listing(a, k: int) -> DataFrame:
    sql = _LISTINGS[k].replace("FROM files", "FROM {files}")
    return a.spark.sql(sql, files=a.files)


def _sweep_sql(k: int) -> str:
    """The tables of sweep k over those of the sweep before, in SQL; roots that are not due are left as they were."""
    due, now = ", ".join(map(str, _DUE[k])), _TIMES[k]
    known = f"SELECT * FROM after{k - 1}" if k else "SELECT CAST(NULL AS BIGINT) AS file_id, CAST(NULL AS INT) AS root_id, CAST(NULL AS VARCHAR) AS rel_path, CAST(NULL AS BIGINT) AS size_bytes, CAST(NULL AS TIMESTAMP) AS mtime_utc, CAST(NULL AS VARCHAR) AS file_status, CAST(NULL AS VARCHAR) AS content_key, '' AS outcome, CAST(NULL AS TIMESTAMP) AS scanned_utc WHERE FALSE"
    return f"""k{k} AS ({known}), l{k} AS (SELECT * FROM ({_LISTINGS[k]}) WHERE root_id IN ({due})),
    t{k} AS (SELECT COALESCE(k.file_id, CAST(CONCAT('0x', SUBSTR(md5(CONCAT(l.root_id, '|', l.rel_path)), 1, 15)) AS BIGINT)) AS file_id, l.root_id, l.rel_path, l.size_bytes, l.mtime_utc, k.file_id IS NULL AS new,
        k.file_status = 'ok' AND k.size_bytes = l.size_bytes AND date_trunc('second', k.mtime_utc) = date_trunc('second', l.mtime_utc) AS same, l.error, l.content_key AS ck, k.content_key AS ok FROM l{k} l LEFT JOIN k{k} k ON k.root_id = l.root_id AND k.rel_path = l.rel_path),
    gone{k} AS (SELECT k.* FROM k{k} k WHERE root_id IN ({due}) AND NOT EXISTS (SELECT 1 FROM l{k} l WHERE l.root_id = k.root_id AND l.rel_path = k.rel_path)),
    m{k} AS (SELECT o.id AS old_id, n.id AS new_id FROM (SELECT root_id, content_key, MIN(file_id) AS id FROM gone{k} WHERE file_status <> 'missing' AND content_key <> '' GROUP BY 1, 2 HAVING COUNT(*) = 1) o JOIN (SELECT root_id, ck, MIN(file_id) AS id FROM t{k} WHERE new GROUP BY 1, 2 HAVING COUNT(*) = 1) n ON n.root_id = o.root_id AND n.ck = o.content_key),
    after{k} AS (SELECT COALESCE(m.old_id, file_id) AS file_id, root_id, rel_path, size_bytes, mtime_utc, CASE WHEN NOT COALESCE(same, FALSE) AND error IS NOT NULL THEN 'error' ELSE 'ok' END AS file_status, CASE WHEN same THEN ok ELSE ck END AS content_key,
            CASE WHEN m.old_id IS NOT NULL THEN 'moved' WHEN same THEN 'skip' WHEN error IS NOT NULL THEN 'error' WHEN new THEN 'add' ELSE 'update' END AS outcome, TIMESTAMP '{now}' AS scanned_utc FROM t{k} LEFT JOIN m{k} m ON m.new_id = file_id
        UNION ALL SELECT file_id, root_id, rel_path, size_bytes, mtime_utc, 'missing', content_key, CASE WHEN file_status = 'missing' THEN 'kept' ELSE 'missing' END, TIMESTAMP '{now}' FROM gone{k} WHERE file_id NOT IN (SELECT old_id FROM m{k})
        UNION ALL SELECT * FROM k{k} WHERE root_id NOT IN ({due}))"""


_SWEEPS = ",\n".join(_sweep_sql(k) for k in range(3))


def _sweeps(a, folder: str) -> list[dict]:
    """Three sweeps, an hour apart, each of the roots that are due and from what the one before has written; each under watch."""
    roots = a.spark.createDataFrame([(r, True, m) for r, m in _INTERVALS], "root_id int, enabled boolean, interval_minutes int")
    scans, done = Scans(a.spark), []
    for k, now in enumerate(_TIMES):
        found = _listing(a, k)
        with scans.scan(*(r for r, _ in _INTERVALS)):
            done.append(rescan.sweep_due(a.spark, folder, roots, found.drop("content_key", "error"), found.select("root_id", "rel_path", "content_key", "error"), F.lit(now).cast("timestamp_ntz")))
    return done


def scans(sql: str):
    """`query` with the tables of the three sweeps before its SQL."""
    return query(f",{_SWEEPS}\n{sql}")


@scans("SELECT file_id, root_id, rel_path, size_bytes, file_status, outcome, scanned_utc FROM after2")
def periodic_sweeps(a):
    folder = new_folder(a.spark, "sweeps")
    _sweeps(a, folder)
    return a.spark.read.schema(rescan.files_schema()).parquet(folder).select("file_id", "root_id", "rel_path", "size_bytes", "file_status", "outcome", "scanned_utc")


@scans(" UNION ALL ".join(f"SELECT CAST({k} AS INT) AS sweep, outcome, COUNT(*) AS n FROM after{k} WHERE scanned_utc = TIMESTAMP '{_TIMES[k]}' GROUP BY 2" for k in range(3)))
def sweep_progress(a):
    """The counters that were observed while each sweep was written."""
    rows = [(k, outcome, n) for k, counts in enumerate(_sweeps(a, new_folder(a.spark, "sweeps"))) for outcome, n in counts.items() if outcome != "files"]
    return a.spark.createDataFrame(rows, "sweep int, outcome string, n long")


_TWO = f"""SELECT {_PLACE} AS file_id, root_id, rel_path, size_bytes, content_key FROM (SELECT * FROM ({_LISTINGS[1]}) UNION ALL SELECT * FROM ({_LISTINGS[0]}) o WHERE NOT EXISTS (SELECT 1 FROM ({_LISTINGS[1]}) n WHERE n.root_id = o.root_id AND n.rel_path = o.rel_path))"""


@query(_TWO)
def incremental_discovery(a):
    """Two listings that arrive one after the other; a few files of the second settle only later, when no new listing has come."""
    folder = new_folder(a.spark, "discovery")
    late = F.lit("2024-03-01 12:59:50").cast("timestamp_ntz")
    for k in (0, 1):
        rows = _listing(a, k).drop("error")
        rows = rows.withColumn("mtime_utc", F.when(F.col("size_bytes") % 7 == 3, late).otherwise(F.col("mtime_utc") + F.make_dt_interval(secs=F.lit(k)))) if k else rows
        rows.write.mode("append").parquet(f"{folder}/listings")
        discover(a.spark, f"{folder}/listings", folder, F.lit(_TIMES[k]).cast("timestamp_ntz"))
    discover(a.spark, f"{folder}/listings", folder, F.lit(_TIMES[2]).cast("timestamp_ntz"))
    return Discovery(folder).files.read(a.spark).select("file_id", "root_id", "rel_path", "size_bytes", "content_key")


@query("SELECT DISTINCT root_id, CONCAT('image_type=', image_type) AS folder FROM frames WHERE image_type <> 'dark' UNION ALL SELECT DISTINCT root_id, 'image_type=dark' FROM frames WHERE root_id = 1")
def walk_folders(a):
    """Frames written in folders by root and type, and walked: dark frames are ignored but for root 1, which has a list of its own."""
    folder = new_folder(a.spark, "tree")
    a.frames.write.partitionBy("root_id", "image_type").parquet(folder)
    lists = {0: None, 1: "_*, .*", 2: "IMAGE_TYPE=D?rk\n*.crc"}
    roots = a.spark.createDataFrame([(r, f"{folder}/root_id={r}", text) for r, text in lists.items()], "root_id int, path string, ignore_names string")
    found = walk(a.spark, roots, default=("image_type=dark", ".*")).where("error is null and rel_path like '%.parquet'")
    return found.select("root_id", F.split("rel_path", "/")[0].alias("folder")).distinct()


_DONE = "SELECT file_id, CASE file_id % 4 WHEN 0 THEN 'move' WHEN 1 THEN 'trash' WHEN 2 THEN 'copy' ELSE 'move' END AS action, CASE file_id % 4 WHEN 0 THEN CONCAT('/data/south/old/sorted/', filename) WHEN 1 THEN CONCAT('/trash/job-1/', filename) ELSE CONCAT('/data/north/', filename) END AS dst, CASE WHEN file_id % 4 = 3 THEN 'failed' ELSE 'ok' END AS state FROM {files}"


@query("SELECT file_id, CASE WHEN file_id % 4 = 0 THEN CAST(2 AS INT) ELSE root_id END AS root_id, CASE WHEN file_id % 4 = 0 THEN CONCAT('sorted/', filename) ELSE rel_path END AS rel_path, CASE file_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing' ELSE file_status END AS file_status, CASE WHEN file_id % 4 = 0 THEN TIMESTAMP '2024-03-01 12:00:00' ELSE last_seen_utc END AS last_seen_utc FROM files")
def write_back(a):
    done = a.spark.sql(_DONE, files=a.files)
    return archive.write_back(a.files, done, a.roots, F.lit(_TIMES[0]).cast("timestamp_ntz")).select("file_id", "root_id", "rel_path", "file_status", "last_seen_utc")


@query("SELECT frame_id, image_type, filename, abs_path AS path FROM v_frames WHERE image_type = 'flat'")
def export_files(a):
    """An export to csv files, read back."""
    folder = new_folder(a.spark, "export")
    actions.export(a.v_frames.where("image_type = 'flat'"), folder, "csv", (F.col("date_obs_utc").desc_nulls_last(), "frame_id"))
    return a.spark.read.schema("frame_id long, image_type string, filename string, path string").option("header", True).option("escape", '"').csv(folder)


_COUNT = "(SELECT COUNT(*) FROM placed f WHERE f.{c} = {t}.{c})"


@query(f""", placed AS (SELECT f.*, r.site_id FROM frames f LEFT JOIN rigs r USING (rig_id))
    SELECT 'camera' AS kind, CAST(camera_id AS BIGINT) AS id, camera AS name, {_COUNT.format(c="camera_id", t="c")} AS n, NULL AS camera, NULL AS site, NULL AS active_label, NULL AS rig, NULL AS filter, CAST(NULL AS DATE) AS captured_night, CAST(NULL AS BOOLEAN) AS active, CAST(NULL AS BOOLEAN) AS fixed FROM cameras c
    UNION ALL SELECT 'rig', r.rig_id, r.rig, {_COUNT.format(c="rig_id", t="r")}, c.camera, s.site, x.label, NULL, NULL, NULL, NULL, NULL FROM rigs r JOIN cameras c USING (camera_id) LEFT JOIN sites s ON s.site_id = r.site_id LEFT JOIN flat_sets x ON x.flat_set_id = r.active_flat_set_id
    UNION ALL SELECT 'site', s.site_id, s.site, {_COUNT.format(c="site_id", t="s")}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM sites s
    UNION ALL SELECT 'flat set', x.flat_set_id, x.label, {_COUNT.format(c="flat_set_id", t="x")}, NULL, NULL, NULL, r.rig, l.name, x.captured_night, r.active_flat_set_id = x.flat_set_id, r.site_id IS NOT NULL FROM flat_sets x JOIN rigs r ON r.rig_id = x.rig_id LEFT JOIN filters l ON l.filter_id = x.filter_id""")
def builder_lists(a):
    placed = a.frames.join(a.rigs.select("rig_id", "site_id"), "rig_id", "left")
    return views.builder(placed, a.cameras, a.rigs, a.sites, a.flat_sets, a.filters)


_FILL = "(SELECT {f} FROM rigs r WHERE r.camera_id = f.camera_id AND f.focal_len_mm BETWEEN r.focal_min AND r.focal_max{w})"


@query(f"SELECT frame_id, COALESCE({_FILL.format(f='MAX(r.rig_id)', w='')}, rig_id) AS rig_id, COALESCE({_FILL.format(f='arg_max(r.site_id, r.rig_id)', w=' AND r.site_id IS NOT NULL')}, 3) AS site_id FROM frames f")
def rig_back_fill(a):
    return archive.rig_back_fill(a.frames.withColumn("site_id", F.lit(3)), a.rigs).select(ID, "rig_id", "site_id")


_NEAR = "2 * 6371000.0 * ASIN(SQRT(LEAST(1.0, POW(SIN(RADIANS(p.lat - s.lat) / 2), 2) + COS(RADIANS(p.lat)) * COS(RADIANS(s.lat)) * POW(SIN(RADIANS(p.lon - s.lon) / 2), 2))))"


@query(f"SELECT p.frame_id, COALESCE(s.site_id, CASE WHEN p.frame_id % 2 = 0 THEN CAST(9 AS INT) END) AS site_id FROM (SELECT frame_id, dec_deg AS lat, ra_deg / 2 - 90 AS lon FROM frames) p LEFT JOIN sites s ON {_NEAR} <= 800000")
def site_assignment(a):
    frames = a.frames.withColumn("site_id", F.when(F.col(ID) % 2 == 0, F.lit(9)))
    return archive.assign_site(frames, frames.selectExpr(ID, "dec_deg AS lat", "ra_deg / 2 - 90 AS lon"), a.sites, 800_000).select(ID, "site_id")


_SPELLED = "CASE frame_id % 3 WHEN 0 THEN UPPER(object) WHEN 1 THEN REPLACE(object, 'a', 'á') || '  ' ELSE object END"
_FOLDED = "strip_accents(LOWER(RTRIM(object)))"


def _spelled(a) -> DataFrame:
    return a.frames.withColumn("object", F.expr(_SPELLED))


@query(f"SELECT MIN(object) AS object, MAX(object_canonical) AS canonical, COUNT(*) AS n FROM (SELECT * REPLACE ({_SPELLED} AS object) FROM frames) WHERE object IS NOT NULL GROUP BY {_FOLDED}")
def objects_any_spelling(a):
    return views.objects(_spelled(a))


_MAP = "(VALUES ('m31', 'M 31'), ('TÁRGET', 'Unknown field'), ('NGC_7000 ', 'NGC 7000'), ('icarus', ''), ('no such', 'M 1'))"


@query(f"SELECT frame_id, COALESCE(NULLIF(t.b, ''), object_canonical) AS object_canonical FROM (SELECT * REPLACE ({_SPELLED} AS object) FROM frames) f LEFT JOIN {_MAP} AS t(a, b) ON strip_accents(LOWER(RTRIM(t.a))) = {_FOLDED}")
def names_any_spelling(a):
    mapping = a.spark.sql(f"SELECT a AS raw, b AS canonical FROM {_MAP} AS t(a, b)")
    return archive.apply_names(_spelled(a), mapping).select(ID, "object_canonical")


@query(f"SELECT COALESCE(x.a, s.raw) AS raw, COALESCE(x.b, s.canonical) AS canonical FROM (SELECT MIN(object) AS a, t.b, {_FOLDED} AS k FROM (SELECT {_SPELLED} AS object FROM frames) f JOIN {_MAP} AS t(a, b) ON t.b <> '' AND strip_accents(LOWER(RTRIM(t.a))) = {_FOLDED} GROUP BY 2, 3) x FULL JOIN (VALUES ('M31 ', 'old', 'm31'), ('Other', 'Kept', 'other')) AS s(raw, canonical, k) ON s.k = x.k")
def names_recorded(a):
    mapping = a.spark.sql(f"SELECT a AS raw, b AS canonical FROM {_MAP} AS t(a, b)")
    known = a.spark.sql("SELECT * FROM VALUES ('M31 ', 'old'), ('Other', 'Kept') AS t(raw, canonical)")
    return archive.recorded_names(known, _spelled(a), mapping)


@query("SELECT frame_id, dec_deg AS lat, ra_deg / 2 - 90 AS lon FROM frames WHERE frame_id % 4 <> 3")
def frame_places(a):
    """Places from cards: the first keyword that a frame has counts, and those outside the globe are left out."""
    f = a.frames.select(ID, "dec_deg", (F.col("ra_deg") / 2 - 90).alias("lon"))
    card = lambda word, value, where, k: f.where(where).select(ID, F.lit(k).alias("ord"), F.lit(word).alias("keyword"), value.cast("string").alias("value"))
    cards = card("SITELAT", F.col("dec_deg"), "frame_id % 4 <> 3", 5).unionByName(card("LAT-OBS", F.lit(12.5), "frame_id % 2 = 0", 1)).unionByName(card("SITELONG", F.col("lon"), "true", 6)).unionByName(card("SITELAT", F.lit(95), "frame_id % 4 = 3", 7))
    return cluster.frame_places(cards, ["SITELAT", "LAT-OBS"], ["SITELONG"]).where("lat between -90 and 90")


_SEEN = "CASE event_id % 6 WHEN 0 THEN 'ZWO ASI6200MC Pro' WHEN 1 THEN 'QHY268M' WHEN 2 THEN 'zwo asi 294' WHEN 3 THEN 'Canon EOS R' WHEN 4 THEN 'my asi2600 cooled' END"
_GLASS = "CASE event_id % 5 WHEN 0 THEN 'ha' WHEN 1 THEN 'H-Alpha' WHEN 2 THEN 'Sii' WHEN 3 THEN 'Oiii ' END"
#: Cameras of the model are ASI1000, 1100, ... with ids 0 to 4; filters have ids 0 to 5.
_CAMERAS = "CASE event_id % 6 WHEN 0 THEN CAST(2 AS INT) WHEN 1 THEN CAST(3 AS INT) WHEN 2 THEN CAST(6 AS INT) WHEN 4 THEN CAST(5 AS INT) END"


@query(f"""SELECT d.frame_id, d.camera_id, d.filter_id, r.rig_id, COALESCE(r.site_id, 4) AS site_id FROM (SELECT event_id AS frame_id, {_CAMERAS} AS camera_id, CASE event_id % 5 WHEN 0 THEN CAST(4 AS INT) WHEN 1 THEN CAST(4 AS INT) WHEN 2 THEN CAST(7 AS INT) WHEN 3 THEN CAST(6 AS INT) END AS filter_id, CAST(400 + 10 * (user_id % 25) + event_id % 2 AS INT) AS focal FROM events) d
    LEFT JOIN rigs r ON r.rig_id = (SELECT MIN(x.rig_id) FROM rigs x WHERE x.active AND x.camera_id = d.camera_id AND d.focal BETWEEN x.focal_min AND x.focal_max)""")
def equipment_resolve(a):
    """From names on cards to camera, filter, rig and site; two cameras and two filters are new."""
    aliases = a.spark.createDataFrame([("qhy268", "asi1300", 5), ("Asi6200", "ASI1200", 2), ("asi", "ASI1000", 9), ("X", "ASI1100", 1)], "alias string, camera string, priority int")
    named = a.spark.createDataFrame([("h-alpha", 4)], "alias string, filter_id int")
    cards = a.frames.select(ID, "focal_len_mm", F.expr(_SEEN.replace("event_id", ID)).alias("instrument"), F.expr(_GLASS.replace("event_id", ID)).alias("filter_raw"))
    registry = equipment.Registry(a.cameras, aliases.where("alias <> 'asi'"), a.filters, named, a.rigs, 4)
    return equipment.resolve(cards, registry).frames.select(ID, "camera_id", "filter_id", "rig_id", "site_id")


_PART = "CAST(CONCAT('0x', SUBSTR(md5(CONCAT(CAST(event_id AS VARCHAR), '|', event_type)), {at}, 15)) AS BIGINT)"


@query(f"SELECT user_id AS file_id, CASE WHEN COUNT(event_type) = 0 THEN '' ELSE CONCAT(COUNT(event_type), '-', SUM({_PART.format(at=1)}), '-', SUM({_PART.format(at=17)})) END AS content_key FROM events GROUP BY 1")
def content_digests(a):
    rows = a.spark.read.parquet(f"{a.sf_dir}/events.parquet").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("hdu"), F.col("event_type").alias("fingerprint"))
    return archive.content_digest(rows)


_SCANNED = "SELECT root_id, CAST(root_id <> 7 AS BOOLEAN) AS enabled, CAST(root_id % 4 * 30 AS INT) AS interval_minutes, CASE WHEN root_id % 5 <> 0 THEN TIMESTAMP '2024-03-01 11:00:00' - INTERVAL '1' MINUTE * (root_id * 37 % 100) END AS last_scan_utc FROM (SELECT DISTINCT CAST(user_id % 40 AS INT) AS root_id FROM {events}) r"


@query(f"SELECT root_id, row_number() OVER (ORDER BY last_scan_utc ASC NULLS FIRST, root_id) AS place FROM ({_SCANNED.format(events='events')}) s WHERE enabled AND interval_minutes > 0 AND (last_scan_utc IS NULL OR last_scan_utc + INTERVAL '1' MINUTE * interval_minutes <= TIMESTAMP '2024-03-01 12:00:00')")
def due_roots_in_order(a):
    """The order in which roots are swept, as places."""
    roots = a.spark.sql(_SCANNED, events=a.spark.read.parquet(f"{a.sf_dir}/events.parquet"))
    # the sorted rows as they come, from one partition: roots are few
    due = archive.due_roots(roots, F.lit(_TIMES[0]).cast("timestamp_ntz")).select("root_id").coalesce(1)
    return due.withColumn("place", F.monotonically_increasing_id() + 1)


@query("SELECT frame_id, strftime(date_trunc('second', date_obs_utc), '%Y-%m-%d %H:%M:%S') AS seen FROM frames")
def epoch_as_text(a):
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("second", F.col("date_obs_utc")).cast("timestamp_ntz"))
    return a.frames.select(ID, archive.epoch_text(seconds).alias("seen"))


_OLD_TAGS = "SELECT root_id, CASE WHEN event_type = 'view' THEN 'Séen ' ELSE event_type END AS name, 'old' AS note FROM (SELECT DISTINCT CAST(user_id % 3 AS INT) AS root_id, event_type FROM {events}) t"
_NEW_TAGS = "SELECT root_id, CASE WHEN event_type = 'view' THEN 'SEEN' WHEN event_type = 'click' THEN 'Clíck' ELSE CONCAT(UPPER(event_type), '?') END AS name, 'new' AS note FROM (SELECT DISTINCT CAST(1 + user_id % 3 AS INT) AS root_id, event_type FROM {events}) t"


@query(f"""SELECT n.root_id, COALESCE(o.name, n.name) AS name, n.note FROM ({_NEW_TAGS.format(events='events')}) n LEFT JOIN ({_OLD_TAGS.format(events='events')}) o ON o.root_id = n.root_id AND strip_accents(LOWER(RTRIM(o.name))) = strip_accents(LOWER(n.name))
    UNION ALL SELECT o.root_id, o.name, o.note FROM ({_OLD_TAGS.format(events='events')}) o WHERE NOT EXISTS (SELECT 1 FROM ({_NEW_TAGS.format(events='events')}) n WHERE n.root_id = o.root_id AND strip_accents(LOWER(RTRIM(o.name))) = strip_accents(LOWER(n.name)))""")
def upsert_any_spelling(a):
    events = a.spark.read.parquet(f"{a.sf_dir}/events.parquet")
    return archive.upsert(a.spark.sql(_OLD_TAGS, events=events), a.spark.sql(_NEW_TAGS, events=events), ["root_id", "name"], folded=("name",))


_WHOLE = ("value_normalize", "observing_night", "strict_number", "filter_default", "quarantine", "coord_parse", "fingerprint")


def _resolved_rows(spark, sf_dir):
    """Whole rows from units of images, whose cards name another size than the image has."""
    units = cards_of(spark, sf_dir).select(ID, F.map_concat(F.map_filter("cards", lambda k, v: ~k.isin("NAXIS1", "BITPIX")), F.create_map(F.lit("BITPIX"), F.lit("8"))).alias("first"), F.lit(16).alias("bitpix"), F.lit(2).alias("naxis"), (F.col(ID) % 100 + 1).alias("naxis1"), F.lit(24).cast("long").alias("naxis2"))
    rows = headers.resolve_frames(units, -7.0)
    return rows.select(ID, "width", "height", "bitpix", "naxis", "image_type", "date_obs_utc", "session_night", "exposure_s", "gain", "filter_raw", "filter_defaulted", "review_reason", F.round("ra_deg", 6).alias("ra_deg"), F.round("dec_deg", 6).alias("dec_deg"), "instrument", "fingerprint")


QUERIES["resolved_rows"] = _resolved_rows
ORACLES["resolved_rows"] = "SELECT *, CAST(frame_id % 100 + 1 AS BIGINT) AS width, CAST(24 AS BIGINT) AS height, 16 AS bitpix, 2 AS naxis FROM " + " JOIN ".join(f"({ORACLES[n]}) {n} USING (frame_id)" if k else f"({ORACLES[n]}) {n}" for k, n in enumerate(_WHOLE)) + " JOIN (SELECT frame_id, instrument FROM (" + ORACLES["camera_alias_resolve"] + ") c) i USING (frame_id)"


@query("SELECT c.id, c.name, COUNT(f.frame_id) AS n FROM collections c LEFT JOIN collection_frames f ON f.collection_id = c.id GROUP BY 1, 2")
def collection_counts_with_zero(a):
    return views.counts_with_zero(a.collections, a.collection_frames, "id", "collection_id")
