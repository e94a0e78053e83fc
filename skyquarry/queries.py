"""A query for every operator, and the same in SQL for a checking database."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquarry.functions import catalogs, headers
from skyquarry.model import Archive, oracle
from skyquarry.operators import actions, archive, cluster, match, views
from skyquarry.plans.filter_ast import browse, compile_filter, page, totals, visible

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ID = "frame_id"


def query(sql: str | None = None):
    """Registers a function of an Archive under its name, with its SQL over the model's views."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Archive(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


def filtered(name: str, node: dict, where: str):
    """A query for one filter node: the ids that pass."""
    QUERIES[name] = lambda spark, sf_dir: (lambda a: a.v_frames.where(compile_filter(node, a.context)).select(ID, "image_type"))(Archive(spark, sf_dir))
    ORACLES[name] = oracle(f"SELECT frame_id, image_type FROM v_frames v WHERE {where}")


def cmp(field: str, op: str, value=None) -> dict:
    return {"field": field, "op": op} | ({} if value is None else {"value": value})


_HAS = "EXISTS (SELECT 1 FROM {t} k WHERE k.frame_id = v.frame_id AND {c})"


def has(table: str, cond: str) -> str:
    return _HAS.format(t=table, c=cond)


_DIST = "DEGREES(2 * ASIN(SQRT(LEAST(1.0, POW(SIN(RADIANS(dec_deg - {d}) / 2), 2) + COS(RADIANS({d})) * COS(RADIANS(dec_deg)) * POW(SIN(RADIANS(ra_deg - {r}) / 2), 2)))))"
_BEST = {"op": "tagged", "value": "best"}

filtered("filter_all", {}, "TRUE")
filtered("filter_eq", cmp("image_type", "eq", "flat"), "image_type = 'flat'")
filtered("filter_exact_ci", cmp("image_type", "eq", "Light"), "image_type = 'light'")
filtered("filter_exact_in_ci", cmp("image_type", "in", ["DARK", "Flat"]), "image_type IN ('dark', 'flat')")
filtered("filter_eq_ci", cmp("rig", "eq", "nation_12"), "LOWER(rig) = 'nation_12'")
filtered("filter_ne_null", cmp("pier_side", "ne", "east"), "pier_side <> 'east'")
filtered("filter_lt", cmp("gain", "lt", 200), "gain < 200")
filtered("filter_lte", cmp("gain", "lte", 200), "gain <= 200")
filtered("filter_gt", cmp("exposure_s", "gt", "50"), "exposure_s > 50")
filtered("filter_gte", cmp("date_obs_utc", "gte", "2024-01-15 00:00:00"), "date_obs_utc >= TIMESTAMP '2024-01-15 00:00:00'")
filtered("filter_like_ci", cmp("camera", "like", "asi12%"), "camera ILIKE 'asi12%'")
filtered("filter_in", cmp("filter", "in", ["ha", "L"]), "LOWER(filter) IN ('ha', 'l')")
filtered("filter_between", cmp("session_night", "between", ["2024-01-05", "2024-01-09"]), "session_night BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
filtered("filter_isnull", cmp("filter", "isnull"), "filter IS NULL")
filtered("filter_notnull", cmp("gain", "notnull"), "gain IS NOT NULL")
filtered("logical_nested", {"op": "or", "clauses": [{"op": "and", "clauses": [cmp("image_type", "eq", "light"), cmp("gain", "eq", 100)]}, {"op": "not", "clauses": [cmp("exposure_s", "lt", 90)]}]}, "(image_type = 'light' AND gain = 100) OR NOT (exposure_s < 90)")
filtered("object_designation", cmp("object", "eq", "ngc224"), "LOWER(object_canonical) IN ('m 31', 'ngc 224')")
filtered("object_contains", cmp("object", "like", "M3"), "object_canonical ILIKE '%M 3%' OR object_canonical ILIKE '%NGC 5272%'")
filtered("object_raw_in", cmp("object", "in", ["m31", "icarus"]), "LOWER(object) IN ('m31', 'icarus')")
filtered("keyword_numeric", cmp("keyword:K", "gte", 90), has("cards", "k.keyword = 'K' AND TRY_CAST(k.value AS DECIMAL(20,6)) >= 90"))
filtered("keyword_text", cmp("keyword:USER", "eq", "USER7"), has("cards", "k.keyword = 'USER' AND LOWER(k.value) = 'user7'"))
filtered("keyword_like", cmp("keyword:TYPE", "like", "%u%"), has("cards", "k.keyword = 'TYPE' AND k.value ILIKE '%u%'"))
filtered("keyword_absent", cmp("keyword:VALUE", "isnull"), "NOT " + has("cards", "k.keyword = 'VALUE'"))
filtered("keyword_present", cmp("keyword:TYPE", "notnull"), has("cards", "k.keyword = 'TYPE'"))
filtered("tagged", _BEST, has("frame_tags", "k.tag_id = 1"))
filtered("tagged_by_id", {"op": "tagged", "value": 2}, has("frame_tags", "k.tag_id = 2"))
filtered("untagged", {"op": "untagged", "value": "REVIEW"}, "NOT " + has("frame_tags", "k.tag_id = 2"))
filtered("in_collection", {"op": "in_collection", "value": "project x"}, has("collection_frames", "k.collection_id = 2"))
filtered("membership_under_or", {"op": "or", "clauses": [_BEST, {"op": "not", "clauses": [cmp("keyword:K", "lt", 80)]}]}, has("frame_tags", "k.tag_id = 1") + " OR NOT " + has("cards", "k.keyword = 'K' AND TRY_CAST(k.value AS DECIMAL(20,6)) < 80"))
filtered("cone_exact", {"op": "cone", "ra": 120, "dec": -20, "radius_deg": 15}, _DIST.format(r=120, d=-20) + " <= 15")
filtered("cone_wrap", {"op": "cone", "ra": 0.5, "dec": 30, "radius_deg": 10}, _DIST.format(r=0.5, d=30) + " <= 10")
filtered("cone_pole", {"op": "cone", "ra": 200, "dec": 85, "radius_deg": 12}, _DIST.format(r=200, d=85) + " <= 12")

_LIGHTS = {"op": "and", "clauses": [cmp("image_type", "eq", "light"), cmp("rig", "eq", "NATION_7"), cmp("exposure_s", "between", [10, 80])]}


@query("SELECT frame_id, date_obs_utc, exposure_s, filter, abs_path FROM v_frames WHERE image_type = 'light' AND LOWER(rig) = 'nation_7' AND exposure_s BETWEEN 10 AND 80 AND file_status <> 'missing'")
def entry_lights(a):
    return visible(a.v_frames, _LIGHTS).orderBy(F.desc("date_obs_utc"), ID).select(ID, "date_obs_utc", "exposure_s", "filter", "abs_path")


@query("SELECT frame_id, image_type, master_of, session_night, rig, camera, site, filter, root_label, abs_path, file_status, bucket FROM v_frames")
def v_frames(a):
    return a.v_frames.select(ID, "image_type", "master_of", "session_night", "rig", "camera", "site", "filter", "root_label", "abs_path", "file_status", "bucket")


@query("SELECT frame_id, rig, exposure_s FROM v_frames WHERE image_type = 'dark' AND file_status <> 'missing' ORDER BY exposure_s DESC NULLS LAST, rig NULLS FIRST, frame_id LIMIT 20 OFFSET 5")
def sort_page(a):
    return page(a.v_frames, cmp("image_type", "eq", "dark"), [{"field": "exposure_s", "dir": "desc"}, {"field": "rig"}], limit=20, offset=5).select(ID, "rig", "exposure_s")


@query("SELECT CAST(COUNT(*) FILTER (WHERE file_status <> 'missing') AS BIGINT) AS total, CAST(COUNT(*) FILTER (WHERE file_status = 'missing') AS BIGINT) AS missing_hidden FROM v_frames WHERE image_type = 'light'")
def hide_missing_totals(a):
    return totals(a.v_frames, cmp("image_type", "eq", "light"))


@query("SELECT DISTINCT object_canonical AS value FROM v_frames WHERE object_canonical <> ''")
def facet_object(a):
    return views.facet(a.v_frames, "object")


@query("SELECT DISTINCT rig AS value FROM v_frames WHERE rig <> ''")
def facet_rig(a):
    return views.facet(a.v_frames, "rig")


@query("SELECT COUNT(*) AS frames, COUNT(*) FILTER (WHERE image_type = 'light') AS lights, COUNT(*) FILTER (WHERE file_status = 'missing') AS missing, COUNT(*) FILTER (WHERE file_status = 'error') AS errors, COUNT(DISTINCT NULLIF(object_canonical, '')) AS objects, COUNT(DISTINCT session_night) AS nights FROM v_frames")
def status_tiles(a):
    return views.status(a.v_frames)


def _summary_sql(label: str, where: str) -> str:
    return f"SELECT {label} AS label, image_type, COUNT(*) AS n, ROUND(CAST(COALESCE(SUM(exposure_s), 0) AS DOUBLE) / 3600, 2) AS hours FROM v_frames WHERE {where} GROUP BY 1, 2 ORDER BY n DESC, label, image_type LIMIT 500"


@query(_summary_sql("object_canonical", "object_canonical <> ''"))
def summary_object(a):
    return views.summary(a.v_frames, "object")


@query(_summary_sql("CAST(session_night AS VARCHAR)", "TRUE"))
def summary_night(a):
    return views.summary(a.v_frames, "night")


@query(_summary_sql("COALESCE(filter, '(none)')", "TRUE"))
def summary_filter(a):
    return views.summary(a.v_frames, "filter")


@query(f"SELECT label, CAST(SUM(n) AS BIGINT) AS frames, ROUND(SUM(hours), 2) AS hours, STRING_AGG(DISTINCT image_type, ',' ORDER BY image_type) AS types FROM ({_summary_sql('object_canonical', chr(39).join(['object_canonical <> ', '', '']))}) GROUP BY label")
def target_rollup(a):
    return views.targets(views.summary(a.v_frames, "object"))


@query("SELECT session_night, image_type, object_canonical, rig, filter, COUNT(*) AS n, CAST(SUM(exposure_s) AS BIGINT) AS exposure, MIN(date_obs_utc) AS first_utc, MAX(date_obs_utc) AS last_utc FROM v_frames GROUP BY ALL")
def frame_summary_view(a):
    return views.frame_summary(views.named(a))


@query("SELECT rig_id, rig, camera, focal_min, focal_max FROM rigs JOIN cameras USING (camera_id) WHERE active")
def rig_resolve_view(a):
    return views.rig_resolve(a.rigs, a.cameras)


@query("SELECT file_status, COUNT(*) AS n FROM files GROUP BY 1")
def files_by_status(a):
    return views.counts(a.files, "file_status")


@query("SELECT camera_id, focal_len_mm, COUNT(*) AS n FROM frames GROUP BY 1, 2")
def camera_focal_counts(a):
    return views.counts(a.frames, "camera_id", "focal_len_mm")


@query("SELECT object, MAX(object_canonical) AS canonical, COUNT(*) AS n FROM frames WHERE object IS NOT NULL GROUP BY 1")
def objects_rollup(a):
    return views.objects(a.frames)


@query("SELECT t.id, t.name, COUNT(f.frame_id) AS n FROM tags t LEFT JOIN frame_tags f ON f.tag_id = t.id GROUP BY 1, 2")
def tag_counts_with_zero(a):
    return views.counts_with_zero(a.tags, a.frame_tags, "id", "tag_id")


@query("SELECT flat_set_id, MIN(session_night) AS night FROM frames WHERE flat_set_id IS NOT NULL GROUP BY 1")
def flat_set_nights(a):
    return a.frames.where("flat_set_id is not null").groupBy("flat_set_id").agg(F.min("session_night").alias("night"))


@query("SELECT frame_id, COALESCE(MAX(value) FILTER (WHERE keyword = 'VALUE'), MAX(value) FILTER (WHERE keyword = 'TYPE'), MAX(value) FILTER (WHERE keyword = 'K')) AS value FROM cards WHERE keyword IN ('VALUE', 'TYPE', 'K') GROUP BY 1")
def keyword_priority_resolve(a):
    return views.first_card(a.cards, ["VALUE", "TYPE", "K"], "value")


# -- normalisation, on header texts made of the event's number

_CARDS = {
    "IMAGETYP": "CASE event_id % 11 WHEN 0 THEN 'Light Frame' WHEN 1 THEN 'DARK' WHEN 2 THEN ' flat ' WHEN 3 THEN 'Master Dark' WHEN 4 THEN 'FlatDark' WHEN 5 THEN 'zero' WHEN 6 THEN 'Bias Frame' WHEN 7 THEN 'my integration' WHEN 8 THEN 'Wibble' WHEN 9 THEN 'LIGHT' END",
    "DATE-OBS": "CASE event_id % 5 WHEN 0 THEN 'garbage' WHEN 1 THEN CONCAT('2025-11-27T0', CAST(event_id % 10 AS STRING), ':32:39.6264089') WHEN 2 THEN '2025-11-27T18:00:00Z' WHEN 3 THEN ' 2025-11-27 20:00:00 ' END",
    "EXPTIME": "CASE event_id % 4 WHEN 0 THEN CAST(event_id % 600 AS STRING) WHEN 1 THEN ' 300.5 ' WHEN 2 THEN '12abc' END",
    "EXPOSURE": "'7'",
    "GAIN": "CASE event_id % 3 WHEN 0 THEN '100.5' WHEN 1 THEN '-2.5' ELSE ' ' END",
    "FILTER": "CASE event_id % 6 WHEN 0 THEN 'Ha' WHEN 1 THEN '!Shutter!' WHEN 2 THEN 'none' WHEN 3 THEN '' WHEN 4 THEN 'OIII' END",
    "OBJCTRA": "CASE event_id % 2 WHEN 0 THEN CONCAT(CAST(event_id % 24 AS STRING), ' 45 42') END",
    "RA": "CASE event_id % 4 WHEN 1 THEN CAST(event_id % 360 AS STRING) END",
    "DEC": "CASE event_id % 3 WHEN 0 THEN CONCAT('-', CAST(event_id % 90 AS STRING), ':30:00') WHEN 1 THEN '+30 43 00' ELSE CAST(event_id % 90 AS STRING) END",
    "INSTRUME": "CASE event_id % 4 WHEN 0 THEN 'ZWO ASI6200MC Pro' WHEN 1 THEN 'QHY268M' WHEN 2 THEN 'zwo asi 294' END",
}
_DUCK_CARDS = "raw AS (SELECT event_id AS frame_id, " + ", ".join(f"NULLIF(TRIM({v}), '') AS \"{k}\"" for k, v in _CARDS.items()) + " FROM events)"


def _header_oracle(name: str, select: str) -> None:
    ORACLES[name] = f"WITH {_DUCK_CARDS.replace('AS STRING', 'AS VARCHAR')} SELECT frame_id, {select} FROM raw"


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = ", ".join(f"'{k}', {v}" for k, v in _CARDS.items())
    return spark.sql(f"SELECT event_id AS frame_id, map_filter(map({pairs}), (k, v) -> v IS NOT NULL) AS cards FROM parquet.`{sf_dir}/events.parquet`")


def normalised(name: str, columns: list[str], select: str):
    def run(spark, sf_dir):
        fields = headers.resolve(F.col("cards"), -7.0)
        return _cards(spark, sf_dir).select(ID, *(fields[c].alias(c) for c in columns))

    QUERIES[name] = run
    _header_oracle(name, select)


_TYPE = "CASE WHEN t LIKE '%flatdark%' THEN 'darkflat' WHEN t LIKE '%master%' OR t LIKE '%integration%' THEN 'master' WHEN t IN ('light', 'light frame') THEN 'light' WHEN t = 'dark' THEN 'dark' WHEN t = 'flat' THEN 'flat' WHEN t IN ('bias frame') OR t LIKE '%zero%' THEN 'bias' ELSE 'unknown' END".replace("t LIKE", 'LOWER("IMAGETYP") LIKE').replace("t IN", 'LOWER("IMAGETYP") IN').replace("t =", 'LOWER("IMAGETYP") =')
_AT = "CASE WHEN \"DATE-OBS\" LIKE '____-__-__%:%' THEN TRY_CAST(REGEXP_REPLACE(REGEXP_REPLACE(\"DATE-OBS\", 'Z$', ''), '(\\.\\d{6})\\d+$', '\\1') AS TIMESTAMP) END"
normalised("value_normalize", ["image_type"], f"{_TYPE} AS image_type")
normalised("observing_night", ["date_obs_utc", "session_night"], f"{_AT} AS date_obs_utc, CAST({_AT} - INTERVAL 19 HOUR AS DATE) AS session_night")
normalised("strict_number", ["exposure_s", "gain"], "TRY_CAST(TRY_CAST(COALESCE(\"EXPTIME\", \"EXPOSURE\") AS DOUBLE) AS DECIMAL(10,3)) AS exposure_s, CAST(ROUND(TRY_CAST(\"GAIN\" AS DOUBLE)) AS INT) AS gain")
_F = "CASE WHEN LOWER(\"FILTER\") NOT IN ('!shutter!', 'none', 'dark') THEN \"FILTER\" END"
normalised("filter_default", ["filter_raw", "filter_defaulted"], f"CASE WHEN ({_TYPE}) IN ('light', 'flat') AND {_F} IS NULL THEN 'CLEAR' ELSE {_F} END AS filter_raw, ({_TYPE}) IN ('light', 'flat') AND {_F} IS NULL AS filter_defaulted")
normalised("quarantine", ["review_reason"], f"CASE WHEN {_AT} IS NULL THEN 'no-dateobs' WHEN ({_TYPE}) = 'unknown' THEN 'unknown-type' END AS review_reason")


# a dialect from tables: keywords in another order, one switched off, rules of all modes
_HEADER_MAP = "(VALUES (1, 'exposure_s', 'EXPOSURE', 10, true), (2, 'exposure_s', 'EXPTIME', 20, true), (3, 'filter', 'FILTER', 10, true), (4, 'gain', 'GAIN', 10, false), (5, 'image_type', 'IMAGETYP', 10, true)) AS t(id, field, keyword, priority, enabled)"
_VALUE_MAP = "(VALUES (1, 'filter', '^!', '', 'regex', 10), (2, 'filter', 'none', 'Luminance', 'exact', 10), (3, 'image_type', 'frame', 'light', 'contains', 20), (4, 'image_type', 'dark', 'dark', 'no such mode', 10)) AS t(id, field, raw_value, normalized, match_mode, priority)"


def _header_mapping(spark, sf_dir):
    mapping = headers.load_mapping(spark.sql(f"SELECT * FROM {_HEADER_MAP}"), spark.sql(f"SELECT * FROM {_VALUE_MAP}"))
    fields = headers.resolve(F.col("cards"), -7.0, mapping)
    return _cards(spark, sf_dir).select(ID, *(fields[c].alias(c) for c in ("exposure_s", "gain", "image_type", "filter_raw")))


QUERIES["header_mapping"] = _header_mapping
_KIND = "CASE WHEN LOWER(\"IMAGETYP\") = 'dark' THEN 'dark' WHEN LOWER(\"IMAGETYP\") LIKE '%frame%' THEN 'light' WHEN \"IMAGETYP\" IN ('light', 'dark', 'flat', 'bias', 'darkflat', 'master') THEN \"IMAGETYP\" ELSE 'unknown' END"
_USED = "CASE WHEN regexp_matches(\"FILTER\", '^!') THEN NULL WHEN LOWER(\"FILTER\") = 'none' THEN 'Luminance' ELSE \"FILTER\" END"
_header_oracle("header_mapping", f"TRY_CAST(TRY_CAST(COALESCE(\"EXPOSURE\", \"EXPTIME\") AS DOUBLE) AS DECIMAL(10,3)) AS exposure_s, CAST(NULL AS INT) AS gain, {_KIND} AS image_type, CASE WHEN {_KIND} IN ('light', 'flat') AND {_USED} IS NULL THEN 'CLEAR' ELSE {_USED} END AS filter_raw")


_BROKEN_MAP = "(VALUES (1, 'filter', '([', 'never', 'regex', 5), (2, 'filter', '^!', '', 'regex', 10), (3, 'filter', 'none', 'Luminance', 'exact', 10), (4, 'image_type', '*dark', 'never', 'regex', 5), (5, 'image_type', 'frame', 'light', 'contains', 20)) AS t(id, field, raw_value, normalized, match_mode, priority)"


def _header_mapping_bad_rule(spark, sf_dir):
    """Value rules whose pattern is no regular expression: left out, the others apply."""
    mapping = headers.load_mapping(spark.sql(f"SELECT * FROM {_HEADER_MAP}"), spark.sql(f"SELECT * FROM {_BROKEN_MAP}"))
    fields = headers.resolve(F.col("cards"), -7.0, mapping)
    return _cards(spark, sf_dir).select(ID, *(fields[c].alias(c) for c in ("image_type", "filter_raw")))


QUERIES["header_mapping_bad_rule"] = _header_mapping_bad_rule
_PLAIN_KIND = _KIND.replace("WHEN LOWER(\"IMAGETYP\") = 'dark' THEN 'dark' ", "")
_header_oracle("header_mapping_bad_rule", f"{_PLAIN_KIND} AS image_type, CASE WHEN {_PLAIN_KIND} IN ('light', 'flat') AND {_USED} IS NULL THEN 'CLEAR' ELSE {_USED} END AS filter_raw")


def _fingerprint(spark, sf_dir):
    return _cards(spark, sf_dir).select(ID, headers.fingerprint(F.col("cards")).alias("fingerprint"))


QUERIES["fingerprint"] = _fingerprint
ORACLES["fingerprint"] = "SELECT event_id AS frame_id, md5(CONCAT(" + ", ".join(f"COALESCE({_CARDS[k]}, ''), '|'" if k in _CARDS else "'|'" for k in headers.FINGERPRINT).replace("AS STRING", "AS VARCHAR") + ")) AS fingerprint FROM events"


def _coord_parse(spark, sf_dir):
    f = headers.resolve(F.col("cards"))
    return _cards(spark, sf_dir).select(ID, F.round(f["ra_deg"], 6).alias("ra_deg"), F.round(f["dec_deg"], 6).alias("dec_deg"))


QUERIES["coord_parse"] = _coord_parse
_header_oracle("coord_parse", "ROUND(COALESCE(TRY_CAST(\"RA\" AS DOUBLE), (TRY_CAST(SPLIT_PART(\"OBJCTRA\", ' ', 1) AS DOUBLE) + 45 / 60.0::DOUBLE + 42 / 3600.0::DOUBLE) * 15), 6) AS ra_deg, ROUND(CASE WHEN \"DEC\" LIKE '-%' THEN -(TRY_CAST(REGEXP_EXTRACT(\"DEC\", '^-(\\d+):', 1) AS DOUBLE) + 0.5::DOUBLE) WHEN \"DEC\" LIKE '+%' THEN 30 + 43 / 60.0::DOUBLE ELSE TRY_CAST(\"DEC\" AS DOUBLE) END, 6) AS dec_deg")


@query("SELECT frame_id, object_canonical AS canonical, CASE WHEN object_canonical LIKE 'M %' THEN 'M' WHEN object_canonical LIKE 'NGC %' THEN 'NGC' WHEN object_canonical LIKE 'IC %' THEN 'IC' END AS catalog, object = 'Target' AS placeholder FROM frames WHERE object IS NOT NULL")
def canonical_name(a):
    c = catalogs.canonical(F.col("object"))
    return a.frames.where("object is not null").select(ID, F.when(~c["placeholder"], c["canonical"]).alias("canonical"), c["catalog"].alias("catalog"), c["placeholder"].alias("placeholder"))


# The cross-list, apart from the one in functions/catalogs.py.
_CROSS_LIST = """(VALUES
    ('M 1', 'NGC 1952'), ('M 2', 'NGC 7089'), ('M 3', 'NGC 5272'), ('M 4', 'NGC 6121'), ('M 5', 'NGC 5904'), ('M 6', 'NGC 6405'), ('M 7', 'NGC 6475'), ('M 8', 'NGC 6523'),
    ('M 9', 'NGC 6333'), ('M 10', 'NGC 6254'), ('M 11', 'NGC 6705'), ('M 12', 'NGC 6218'), ('M 13', 'NGC 6205'), ('M 14', 'NGC 6402'), ('M 15', 'NGC 7078'), ('M 16', 'NGC 6611'),
    ('M 17', 'NGC 6618'), ('M 18', 'NGC 6613'), ('M 19', 'NGC 6273'), ('M 20', 'NGC 6514'), ('M 21', 'NGC 6531'), ('M 22', 'NGC 6656'), ('M 23', 'NGC 6494'), ('M 24', 'IC 4715'),
    ('M 25', 'IC 4725'), ('M 26', 'NGC 6694'), ('M 27', 'NGC 6853'), ('M 28', 'NGC 6626'), ('M 29', 'NGC 6913'), ('M 30', 'NGC 7099'), ('M 31', 'NGC 224'), ('M 32', 'NGC 221'),
    ('M 33', 'NGC 598'), ('M 34', 'NGC 1039'), ('M 35', 'NGC 2168'), ('M 36', 'NGC 1960'), ('M 37', 'NGC 2099'), ('M 38', 'NGC 1912'), ('M 39', 'NGC 7092'), ('M 41', 'NGC 2287'),
    ('M 42', 'NGC 1976'), ('M 43', 'NGC 1982'), ('M 44', 'NGC 2632'), ('M 46', 'NGC 2437'), ('M 47', 'NGC 2422'), ('M 48', 'NGC 2548'), ('M 49', 'NGC 4472'), ('M 50', 'NGC 2323'),
    ('M 51', 'NGC 5194'), ('M 52', 'NGC 7654'), ('M 53', 'NGC 5024'), ('M 54', 'NGC 6715'), ('M 55', 'NGC 6809'), ('M 56', 'NGC 6779'), ('M 57', 'NGC 6720'), ('M 58', 'NGC 4579'),
    ('M 59', 'NGC 4621'), ('M 60', 'NGC 4649'), ('M 61', 'NGC 4303'), ('M 62', 'NGC 6266'), ('M 63', 'NGC 5055'), ('M 64', 'NGC 4826'), ('M 65', 'NGC 3623'), ('M 66', 'NGC 3627'),
    ('M 67', 'NGC 2682'), ('M 68', 'NGC 4590'), ('M 69', 'NGC 6637'), ('M 70', 'NGC 6681'), ('M 71', 'NGC 6838'), ('M 72', 'NGC 6981'), ('M 73', 'NGC 6994'), ('M 74', 'NGC 628'),
    ('M 75', 'NGC 6864'), ('M 76', 'NGC 650'), ('M 77', 'NGC 1068'), ('M 78', 'NGC 2068'), ('M 79', 'NGC 1904'), ('M 80', 'NGC 6093'), ('M 81', 'NGC 3031'), ('M 82', 'NGC 3034'),
    ('M 83', 'NGC 5236'), ('M 84', 'NGC 4374'), ('M 85', 'NGC 4382'), ('M 86', 'NGC 4406'), ('M 87', 'NGC 4486'), ('M 88', 'NGC 4501'), ('M 89', 'NGC 4552'), ('M 90', 'NGC 4569'),
    ('M 91', 'NGC 4548'), ('M 92', 'NGC 6341'), ('M 93', 'NGC 2447'), ('M 94', 'NGC 4736'), ('M 95', 'NGC 3351'), ('M 96', 'NGC 3368'), ('M 97', 'NGC 3587'), ('M 98', 'NGC 4192'),
    ('M 99', 'NGC 4254'), ('M 100', 'NGC 4321'), ('M 101', 'NGC 5457'), ('M 102', 'NGC 5866'), ('M 103', 'NGC 581'), ('M 104', 'NGC 4594'), ('M 105', 'NGC 3379'), ('M 106', 'NGC 4258'),
    ('M 107', 'NGC 6171'), ('M 108', 'NGC 3556'), ('M 109', 'NGC 3992'), ('M 110', 'NGC 205'))"""


@query(f"SELECT frame_id, CONCAT_WS(',', object_canonical, x.other) AS names FROM frames LEFT JOIN {_CROSS_LIST} AS x(name, other) ON x.name = object_canonical")
def designations(a):
    return a.frames.select(ID, F.array_join(catalogs.designations(F.col("object_canonical")), ",").alias("names"))


def _camera_alias(spark, sf_dir):
    aliases = spark.createDataFrame([("qhy268", "QHY 268", 1), ("asi6200", "ASI 6200", 2), ("zwo", "Some ZWO", 9)], "alias string, camera string, priority int")
    raw = _cards(spark, sf_dir).select(ID, headers.first_value(F.col("cards"), "INSTRUME").alias("instrument"))
    return archive.resolve_camera(raw, aliases.where("priority < 9")).select(ID, "instrument", "camera")


QUERIES["camera_alias_resolve"] = _camera_alias
_header_oracle("camera_alias_resolve", "\"INSTRUME\" AS instrument, CASE WHEN \"INSTRUME\" ILIKE '%qhy268%' THEN 'QHY 268' WHEN \"INSTRUME\" ILIKE '%asi6200%' THEN 'ASI 6200' WHEN \"INSTRUME\" ILIKE '%asi 294%' THEN 'ASI294' END AS camera")


def _filter_resolve(spark, sf_dir):
    a = Archive(spark, sf_dir)
    aliases = spark.createDataFrame([("h-alpha", 4), ("OIII", 3)], "alias string, filter_id int")
    raw = _cards(spark, sf_dir).select(ID, headers.first_value(F.col("cards"), "FILTER").alias("filter_raw"))
    return archive.resolve_filter(raw, aliases, a.filters).select(ID, "filter_raw", "filter_id")


QUERIES["filter_alias_resolve"] = _filter_resolve
_header_oracle("filter_alias_resolve", "\"FILTER\" AS filter_raw, CASE LOWER(\"FILTER\") WHEN 'ha' THEN CAST(4 AS INT) WHEN 'oiii' THEN CAST(3 AS INT) END AS filter_id")


@query("SELECT f.frame_id, MIN(r.rig_id) AS resolved_rig FROM frames f LEFT JOIN rigs r ON r.active AND r.camera_id = f.camera_id AND f.focal_len_mm BETWEEN r.focal_min AND r.focal_max GROUP BY 1")
def rig_range_join(a):
    return archive.resolve_rig(a.frames, a.rigs).select(ID, "resolved_rig")


@query("SELECT a.rig_id, b.rig_id AS other_id FROM rigs a JOIN rigs b ON a.camera_id = b.camera_id AND a.rig_id < b.rig_id AND a.focal_min <= b.focal_max AND a.focal_max >= b.focal_min WHERE a.active AND b.active")
def rig_overlap(a):
    return cluster.rig_overlaps(a.rigs)


# -- calibration

_DAYS = "ABS(date_sub('day', c.date_obs_utc, l.date_obs_utc))"
_SECS = "ABS(date_sub('second', c.date_obs_utc, l.date_obs_utc))"
_MATCH = {
    "dark": ("(c.image_type = 'dark' OR c.master_of = 'dark') AND c.camera_id = l.camera_id AND (c.gain = l.gain OR c.gain IS NULL) AND (c.offset_adu = l.offset_adu OR c.offset_adu IS NULL) AND c.binx = l.binx AND c.biny = l.biny AND ABS(c.set_temp_c - l.set_temp_c) <= 1 AND (l.exposure_s IS NULL OR ABS(c.exposure_s - l.exposure_s) <= 5)", 365, f"c.image_type = 'master' DESC, {_SECS}, c.frame_id"),
    "bias": ("(c.image_type = 'bias' OR c.master_of = 'bias') AND c.camera_id = l.camera_id AND c.gain IS NOT DISTINCT FROM l.gain AND c.offset_adu IS NOT DISTINCT FROM l.offset_adu AND c.binx = l.binx AND c.biny = l.biny", 365, f"c.image_type = 'master' DESC, {_SECS}, c.frame_id"),
    "flat": ("(c.image_type = 'flat' OR c.master_of = 'flat') AND c.rig_id = l.rig_id AND c.filter_id IS NOT DISTINCT FROM l.filter_id AND c.binx = l.binx AND c.biny = l.biny AND (l.rotator_deg IS NULL OR ABS(c.rotator_deg - l.rotator_deg) <= 5)", 30, f"c.image_type = 'master' DESC, c.session_night = l.session_night DESC, {_SECS}, c.frame_id"),
}


def _rule(target: str) -> match.Rule:
    return next(r for r in match.DEFAULT_RULES if r.target == target)


def calibration(name: str, target: str):
    cond, age, order = _MATCH[target]
    QUERIES[name] = lambda spark, sf_dir: match.match(Archive(spark, sf_dir).frames, _rule(target), 10).select("light_id", "rank", "frame_id", "image_type", F.round("score", 6).alias("score"), "total")
    ORACLES[name] = oracle(f"SELECT light_id, CAST(r - 1 AS INT) AS rank, frame_id, image_type, ROUND(1 - (r - 1) / 11.0::DOUBLE, 6) AS score, total FROM (SELECT l.frame_id AS light_id, c.frame_id, c.image_type, ROW_NUMBER() OVER (PARTITION BY l.frame_id ORDER BY {order}) AS r, COUNT(*) OVER (PARTITION BY l.frame_id) AS total FROM frames l JOIN frames c ON {cond} AND {_DAYS} <= {age} WHERE l.image_type = 'light') WHERE r <= 10")


calibration("calib_dark_ranked", "dark")
calibration("calib_bias_ranked", "bias")
calibration("calib_flat_session", "flat")


@query(f"SELECT light_id, frame_id, CONCAT_WS(' · ', CASE WHEN image_type = 'master' THEN 'master bias' ELSE 'bias' END, CONCAT('binx ', binx, ', biny ', binx, ', camera_id ', camera_id, ', gain ', gain, ', offset_adu 50'), CONCAT(days, ' day(s) from light')) AS reason FROM (SELECT l.frame_id AS light_id, c.frame_id, c.image_type, l.camera_id, l.gain, l.binx, {_DAYS} AS days, ROW_NUMBER() OVER (PARTITION BY l.frame_id ORDER BY {_MATCH['bias'][2]}) AS r FROM frames l JOIN frames c ON {_MATCH['bias'][0]} AND {_DAYS} <= 365 WHERE l.image_type = 'light') WHERE r <= 3")
def calib_reasons(a):
    return match.match(a.frames, _rule("bias"), 3).select("light_id", "frame_id", "reason")


@query(f"SELECT l.frame_id AS light_id, COUNT(c.frame_id) AS total, CASE WHEN COUNT(c.frame_id) = 0 THEN 'no matching flat frames found' WHEN COUNT(c.frame_id) < 10 THEN CONCAT('only ', COUNT(c.frame_id), ' flat frames (rule suggests at least 10)') END AS warning FROM frames l LEFT JOIN frames c ON {_MATCH['flat'][0]} AND {_DAYS} <= 30 WHERE l.image_type = 'light' GROUP BY 1")
def calib_warnings(a):
    return match.warnings(a.frames, _rule("flat"))


@query("SELECT frame_id AS light_id, CAST(0 AS BIGINT) AS total, 'rule has invalid match_json' AS warning FROM frames WHERE image_type = 'light'")
def calib_rule_errors(a):
    return match.warnings(a.frames, match.Rule.from_json("broken", "flat", '{"rig_id": '))


_FIT = "(s.filter_id IS NULL OR s.filter_id = l.filter_id)"
_FLAT_SETS = f"""SELECT light_id, flat_set_id, how FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY light_id ORDER BY step, (filter_id IS NOT NULL) DESC, captured_night DESC NULLS LAST, flat_set_id DESC) AS r FROM (
    SELECT l.frame_id AS light_id, s.flat_set_id, s.filter_id, s.captured_night, 1 AS step, 'pin' AS how FROM frames l JOIN rigs g ON g.rig_id = l.rig_id JOIN pins p ON p.rig_id = l.rig_id AND p.session_night = l.session_night JOIN flat_sets s ON s.flat_set_id = p.flat_set_id WHERE l.image_type = 'light' AND {_FIT}
    UNION ALL SELECT l.frame_id, s.flat_set_id, s.filter_id, s.captured_night, 2, 'window' FROM frames l JOIN rigs g ON g.rig_id = l.rig_id JOIN flat_sets s ON s.rig_id = l.rig_id WHERE l.image_type = 'light' AND g.site_id IS NOT NULL AND {_FIT} AND s.valid_from <= l.session_night AND (s.valid_to IS NULL OR l.session_night <= s.valid_to)
    UNION ALL SELECT l.frame_id, s.flat_set_id, s.filter_id, s.captured_night, 3, 'on or before' FROM frames l JOIN rigs g ON g.rig_id = l.rig_id JOIN flat_sets s ON s.rig_id = l.rig_id WHERE l.image_type = 'light' AND g.site_id IS NOT NULL AND {_FIT} AND (s.captured_night IS NULL OR s.captured_night <= l.session_night)
    UNION ALL SELECT l.frame_id, s.flat_set_id, s.filter_id, s.captured_night, 4, 'active' FROM frames l JOIN rigs g ON g.rig_id = l.rig_id JOIN flat_sets s ON s.flat_set_id = g.active_flat_set_id WHERE l.image_type = 'light' AND g.site_id IS NOT NULL AND {_FIT}
    UNION ALL SELECT l.frame_id, s.flat_set_id, s.filter_id, s.captured_night, 5, 'same night' FROM frames l JOIN rigs g ON g.rig_id = l.rig_id JOIN flat_sets s ON s.rig_id = l.rig_id WHERE l.image_type = 'light' AND g.site_id IS NULL AND {_FIT} AND s.captured_night = l.session_night)) WHERE r = 1"""


def _flat_sets(a) -> DataFrame:
    return match.flat_sets(a.frames.where("image_type = 'light'"), a.rigs, a.flat_sets, a.pins)


_FLAT_HOW = "CASE how WHEN 'pin' THEN CONCAT('pinned flat set ''', label, ''' for ', session_night) WHEN 'window' THEN CONCAT('flat set ''', label, ''' (window covers ', session_night, ')') WHEN 'on or before' THEN CONCAT('flat set ''', label, ''' (newest on/before ', session_night, ', fixed rig)') WHEN 'active' THEN CONCAT('active flat set ''', label, ''' (fixed rig)') ELSE CONCAT('flat set ''', label, ''' from the same session (', session_night, ')') END"


@query(f"""SELECT light_id, 'default-flat (flat set)' AS rule, CAST(r - 1 AS INT) AS rank, frame_id, CONCAT(CASE WHEN image_type = 'master' THEN 'master flat · ' ELSE 'flat · ' END, {_FLAT_HOW}) AS reason, total FROM (
    SELECT p.light_id, p.how, s.label, l.session_night, c.frame_id, c.image_type, ROW_NUMBER() OVER (PARTITION BY p.light_id ORDER BY c.image_type = 'master' DESC, c.date_obs_utc, c.frame_id) AS r, COUNT(*) OVER (PARTITION BY p.light_id) AS total
    FROM ({_FLAT_SETS}) p JOIN frames l ON l.frame_id = p.light_id JOIN flat_sets s ON s.flat_set_id = p.flat_set_id JOIN frames c ON c.flat_set_id = p.flat_set_id AND (l.filter_id IS NULL OR c.filter_id IS NULL OR c.filter_id = l.filter_id)) WHERE r <= 3
    UNION ALL SELECT light_id, 'default-flat', CAST(r - 1 AS INT), frame_id, CONCAT_WS(' · ', CASE WHEN image_type = 'master' THEN 'master flat' ELSE 'flat' END, CONCAT_WS(', ', CONCAT('binx ', binx), CONCAT('biny ', binx), CASE WHEN filter_id IS NOT NULL THEN CONCAT('filter_id ', filter_id) END, CONCAT('rig_id ', rig_id), CASE WHEN rotator_deg IS NOT NULL THEN CONCAT('rotator_deg ', rotator_deg, '±5') END),
        CASE WHEN night = session_night THEN CONCAT('same night (', session_night, ')') ELSE CONCAT(days, ' day(s) from light') END), total FROM (
    SELECT l.frame_id AS light_id, l.binx, l.filter_id, l.rig_id, l.rotator_deg, l.session_night, c.session_night AS night, c.frame_id, c.image_type, {_DAYS} AS days, ROW_NUMBER() OVER (PARTITION BY l.frame_id ORDER BY {_MATCH['flat'][2]}) AS r, COUNT(*) OVER (PARTITION BY l.frame_id) AS total
    FROM frames l JOIN frames c ON {_MATCH['flat'][0]} AND {_DAYS} <= 30 WHERE l.image_type = 'light' AND l.frame_id NOT IN (SELECT light_id FROM ({_FLAT_SETS}))) WHERE r <= 3""")
def calib_flat_override(a):
    return match.match_all(a.frames, (_rule("flat"),), 3, _flat_sets(a)).select("light_id", "rule", "rank", "frame_id", "reason", "total")


@query(f"""SELECT p.light_id, COUNT(c.frame_id) AS total, CASE WHEN COUNT(c.frame_id) = 0 THEN 'flat set resolved, but it has no flats for this filter' END AS warning FROM ({_FLAT_SETS}) p JOIN frames l ON l.frame_id = p.light_id
    LEFT JOIN frames c ON c.flat_set_id = p.flat_set_id AND (l.filter_id IS NULL OR c.filter_id IS NULL OR c.filter_id = l.filter_id) GROUP BY 1
    UNION ALL SELECT l.frame_id, COUNT(c.frame_id), CASE WHEN COUNT(c.frame_id) = 0 THEN 'no matching flat frames found' WHEN COUNT(c.frame_id) < 10 THEN CONCAT('only ', COUNT(c.frame_id), ' flat frames (rule suggests at least 10)') END FROM frames l LEFT JOIN frames c ON {_MATCH['flat'][0]} AND {_DAYS} <= 30
    WHERE l.image_type = 'light' AND l.frame_id NOT IN (SELECT light_id FROM ({_FLAT_SETS})) GROUP BY 1""")
def calib_flat_warnings(a):
    return match.warnings(a.frames, _rule("flat"), _flat_sets(a))


@query(f"SELECT light_id, frame_id, filename, abs_path FROM (SELECT l.frame_id AS light_id, c.frame_id, c.filename, c.abs_path, ROW_NUMBER() OVER (PARTITION BY l.frame_id ORDER BY {_MATCH['dark'][2]}) AS r FROM frames l JOIN v_frames c ON {_MATCH['dark'][0]} AND {_DAYS} <= 365 WHERE l.image_type = 'light') WHERE r <= 5")
def calib_paths(a):
    return match.with_paths(match.match(a.frames, _rule("dark"), 5), a.v_frames).select("light_id", "frame_id", "filename", "abs_path")


@query(_FLAT_SETS)
def flatset_resolution(a):
    return _flat_sets(a).select("light_id", "flat_set_id", "how")


for _name, _how in (("flatset_pin", "pin"), ("flatset_window", "window"), ("flatset_asof", "on or before"), ("flatset_active", "active"), ("flatset_mobile", "same night")):
    QUERIES[_name] = lambda spark, sf_dir, how=_how: _flat_sets(Archive(spark, sf_dir)).where(F.col("how") == how).select("light_id", "flat_set_id", "how")
    ORACLES[_name] = oracle(f"SELECT * FROM ({_FLAT_SETS}) WHERE how = '{_how}'")

# -- runs and clusters

_RUNS = """SELECT rig_id, filter_id, run, COUNT(*) AS n, MIN(date_obs_utc) AS first_utc, MAX(date_obs_utc) AS last_utc, MIN(session_night) AS night FROM (SELECT *, CAST(SUM(b) OVER (PARTITION BY rig_id, filter_id ORDER BY date_obs_utc, frame_id) AS BIGINT) AS run FROM (SELECT *, CASE WHEN p IS NULL OR date_sub('second', date_trunc('second', p), date_trunc('second', date_obs_utc)) > 28800 THEN 1 ELSE 0 END AS b FROM (SELECT *, LAG(date_obs_utc) OVER (PARTITION BY rig_id, filter_id ORDER BY date_obs_utc, frame_id) AS p FROM frames WHERE image_type = 'flat'))) GROUP BY 1, 2, 3"""


@query(_RUNS)
def flat_runs(a):
    return cluster.runs(a.frames.where("image_type = 'flat'"), minutes=480)


_CHAINS = "SELECT camera_id, CAST(chain AS BIGINT) AS chain, MIN(focal_len_mm) AS lo, MAX(focal_len_mm) AS hi, CAST(SUM(n) AS BIGINT) AS n, CAST(FLOOR(MIN(focal_len_mm) - GREATEST(MIN(focal_len_mm) * 0.015, 1)) AS BIGINT) AS range_min, CAST(CEIL(MAX(focal_len_mm) + GREATEST(MAX(focal_len_mm) * 0.015, 1)) AS BIGINT) AS range_max FROM (SELECT *, SUM(b) OVER (PARTITION BY camera_id ORDER BY focal_len_mm) AS chain FROM (SELECT *, CASE WHEN focal_len_mm > 1.02 * LAG(focal_len_mm) OVER (PARTITION BY camera_id ORDER BY focal_len_mm) THEN 1 WHEN LAG(focal_len_mm) OVER (PARTITION BY camera_id ORDER BY focal_len_mm) IS NULL THEN 1 ELSE 0 END AS b FROM (SELECT camera_id, focal_len_mm, COUNT(*) AS n FROM frames GROUP BY 1, 2))) GROUP BY 1, 2"


@query(_CHAINS)
def focal_clusters(a):
    return cluster.focal_clusters(a.frames)


@query(f"SELECT c.* FROM ({_CHAINS}) c WHERE NOT EXISTS (SELECT 1 FROM rigs r WHERE r.camera_id = c.camera_id AND r.focal_min <= c.hi AND r.focal_max >= c.lo AND r.rig_id % 2 = 0)")
def focal_suggestions(a):
    return cluster.focal_clusters(a.frames, a.rigs.where("rig_id % 2 = 0"))


_PLACES = "SELECT frame_id, dec_deg AS lat, ra_deg / 2 - 90 AS lon FROM frames"
_METRES = "2 * 6371000.0 * ASIN(SQRT(LEAST(1.0, POW(SIN(RADIANS(p.lat - s.lat) / 2), 2) + COS(RADIANS(p.lat)) * COS(RADIANS(s.lat)) * POW(SIN(RADIANS(p.lon - s.lon) / 2), 2))))"


@query(f"SELECT p.frame_id, s.site_id FROM ({_PLACES}) p LEFT JOIN sites s ON {_METRES} <= 800000")
def site_within_distance(a):
    return cluster.sites_within(a.frames.selectExpr(ID, "dec_deg AS lat", "ra_deg / 2 - 90 AS lon"), a.sites, 800_000).select(ID, "site_id")


def _spots(a) -> DataFrame:
    """Places that grow with the frames: around each rig, none equal."""
    return a.frames.selectExpr(ID, "rig_id * 2 - 15 + (frame_id * 7919 % 100003) / 25000000 AS lat", "camera_id * 40 - 100 + (frame_id * 104729 % 100003) / 25000000 AS lon")


@query()
def site_clusters(a):
    return cluster.site_clusters(_spots(a), 250.0)


@query()
def site_coverage(a):
    return cluster.site_coverage(_spots(a), a.sites, 600_000.0)


# -- sweeps: the files against a listing in which some are gone, new, moved or changed

_LISTING = "SELECT root_id, CASE WHEN file_id % 20 = 3 THEN CONCAT('moved/', filename) ELSE rel_path END AS rel_path, CASE WHEN file_id % 20 = 5 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, CASE WHEN file_id % 50 = 9 THEN TIMESTAMP '2024-03-01 11:59:50' ELSE mtime_utc END AS mtime_utc, file_id FROM files WHERE file_id % 20 <> 4"
_KNOWN = "SELECT * FROM files WHERE file_id % 20 <> 6"


def _listing(a) -> tuple[DataFrame, DataFrame]:
    f = a.files
    moved = F.when(F.col("file_id") % 20 == 3, F.concat(F.lit("moved/"), F.col("filename"))).otherwise(F.col("rel_path"))
    size = F.when(F.col("file_id") % 20 == 5, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))
    new = F.when(F.col("file_id") % 50 == 9, F.lit("2024-03-01 11:59:50").cast("timestamp_ntz")).otherwise(F.col("mtime_utc"))
    return f.where("file_id % 20 <> 4").select("root_id", moved.alias("rel_path"), size.alias("size_bytes"), new.alias("mtime_utc"), "file_id"), f.where("file_id % 20 <> 6")


_CLASSES = f"SELECT l.root_id, l.rel_path, CASE WHEN date_sub('second', l.mtime_utc, TIMESTAMP '2024-03-01 12:00:00') < 30 THEN 'settling' WHEN k.file_status IS NULL THEN 'add' WHEN k.file_status = 'ok' AND k.size_bytes = l.size_bytes AND date_trunc('second', k.mtime_utc) = date_trunc('second', l.mtime_utc) THEN 'skip' ELSE 'update' END AS action FROM ({_LISTING}) l LEFT JOIN ({_KNOWN}) k ON k.root_id = l.root_id AND k.rel_path = l.rel_path"
_NOW = "2024-03-01 12:00:00"


@query(_CLASSES)
def sweep_classify(a):
    listing, known = _listing(a)
    return archive.classify(listing, known, F.lit(_NOW).cast("timestamp_ntz")).select("root_id", "rel_path", "action")


@query(f"SELECT action, COUNT(*) AS n FROM ({_CLASSES}) GROUP BY 1")
def sweep_stats(a):
    listing, known = _listing(a)
    return archive.scan_stats(archive.classify(listing, known, F.lit(_NOW).cast("timestamp_ntz")))


@query(f"SELECT k.file_id, k.rel_path FROM ({_KNOWN}) k WHERE k.file_status = 'ok' AND NOT EXISTS (SELECT 1 FROM ({_LISTING}) l WHERE l.root_id = k.root_id AND l.rel_path = k.rel_path)")
def reconcile_missing(a):
    listing, known = _listing(a)
    return archive.missing(known, listing).select("file_id", "rel_path")


_MOVE_KEY = "CASE WHEN file_id % 60 = 43 THEN '' ELSE CONCAT('k', CAST(file_id // 30 AS VARCHAR), '-', CAST(file_id % 30 % 7 AS VARCHAR)) END"
_VANISHED = f"SELECT file_id, {_MOVE_KEY} AS content_key FROM ({_KNOWN}) k WHERE file_status = 'ok' AND NOT EXISTS (SELECT 1 FROM ({_LISTING}) l WHERE l.root_id = k.root_id AND l.rel_path = k.rel_path)"
_APPEARED = f"SELECT -file_id AS file_id, {_MOVE_KEY} AS content_key FROM ({_LISTING}) l WHERE mtime_utc < TIMESTAMP '2024-03-01 11:59:30' AND NOT EXISTS (SELECT 1 FROM ({_KNOWN}) k WHERE k.root_id = l.root_id AND k.rel_path = l.rel_path)"


@query(f"SELECT a.id AS old_id, b.id AS new_id FROM (SELECT content_key, MIN(file_id) AS id FROM ({_VANISHED}) WHERE content_key <> '' GROUP BY 1 HAVING COUNT(*) = 1) a JOIN (SELECT content_key, MIN(file_id) AS id FROM ({_APPEARED}) GROUP BY 1 HAVING COUNT(*) = 1) b USING (content_key)")
def reconcile_moves(a):
    """The files that a sweep misses and those that it adds, matched by content; several have the same content, and some none."""
    key = F.when(F.col("file_id") % 60 == 43, "").otherwise(F.concat(F.lit("k"), F.floor(F.col("file_id") / 30).cast("string"), F.lit("-"), (F.col("file_id") % 30 % 7).cast("string")))
    listing, known = _listing(a)
    added = archive.classify(listing, known, F.lit(_NOW).cast("timestamp_ntz")).where("action = 'add'")
    pair = lambda df, i: df.select(i.alias("file_id"), key.alias("content_key"))
    return archive.moves(pair(archive.missing(known, listing), F.col("file_id")), pair(added, -F.col("file_id")))


# a root of which too little was seen, and what was read of new and changed files; two of the moved have one key
_SWEPT = f"SELECT * FROM ({_LISTING}) WHERE root_id <> 2 OR file_id % 5 = 0"
_KEY = "CONCAT('k', CAST(file_id - CASE WHEN file_id % 60 = 43 THEN 20 ELSE 0 END AS VARCHAR))"
_GUARD = f"SELECT k.root_id, COALESCE(s.seen, 0) AS seen, k.known_ok, k.known_ok = 0 OR COALESCE(s.seen, 0) > 0 AND s.seen >= k.known_ok // 2 AS safe FROM (SELECT root_id, COUNT(*) FILTER (WHERE file_status = 'ok') AS known_ok FROM ({_KNOWN}) GROUP BY 1) k LEFT JOIN (SELECT root_id, COUNT(*) AS seen FROM ({_SWEPT}) GROUP BY 1) s USING (root_id)"


def _swept(a) -> tuple[DataFrame, DataFrame, DataFrame]:
    listing, known = _listing(a)
    listing = listing.where("root_id <> 2 or file_id % 5 = 0")
    key = F.concat(F.lit("k"), (F.col("file_id") - F.when(F.col("file_id") % 60 == 43, 20).otherwise(0)).cast("string"))
    read = listing.select("root_id", "rel_path", key.alias("content_key"), F.when(F.col("file_id") % 40 == 5, "no image").alias("error"))
    return listing.drop("file_id"), known.withColumn("content_key", key), read


@query(_GUARD)
def mount_guard(a):
    listing, known, _ = _swept(a)
    return archive.mount_guard(listing, known)


_SWEEP = f"""WITH k AS (SELECT *, {_KEY} AS content_key FROM ({_KNOWN})), l AS (SELECT *, {_KEY} AS ck, CASE WHEN file_id % 40 = 5 THEN 'no image' END AS error FROM ({_SWEPT})), guard AS ({_GUARD}),
    c AS (SELECT l.root_id, l.rel_path, k.file_id AS old, l.size_bytes, l.mtime_utc, l.ck, l.error, k.file_status, k.size_bytes AS size0, k.content_key, CASE WHEN date_sub('second', l.mtime_utc, TIMESTAMP '2024-03-01 12:00:00') < 30 THEN 'settling' WHEN k.file_status IS NULL THEN 'add' WHEN k.file_status = 'ok' AND k.size_bytes = l.size_bytes AND date_trunc('second', k.mtime_utc) = date_trunc('second', l.mtime_utc) THEN 'skip' ELSE 'update' END AS action
        FROM l LEFT JOIN k ON k.root_id = l.root_id AND k.rel_path = l.rel_path),
    t AS (SELECT COALESCE(old, CAST(CONCAT('0x', SUBSTR(md5(CONCAT(root_id, '|', rel_path)), 1, 15)) AS BIGINT)) AS file_id, root_id, rel_path, CASE WHEN action = 'settling' THEN size0 ELSE size_bytes END AS size_bytes, CASE WHEN action IN ('add', 'update') AND error IS NOT NULL THEN 'error' WHEN action = 'settling' THEN file_status ELSE 'ok' END AS file_status,
        CASE WHEN action IN ('add', 'update') THEN ck ELSE content_key END AS content_key, CASE WHEN action IN ('add', 'update') AND error IS NOT NULL THEN 'error' ELSE action END AS outcome, action = 'add' AS new FROM c WHERE action <> 'settling' OR old IS NOT NULL),
    absent AS (SELECT k.*, g.safe AND k.file_status <> 'missing' AS gone FROM k JOIN guard g USING (root_id) WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.root_id = k.root_id AND l.rel_path = k.rel_path)),
    m AS (SELECT o.id AS old_id, n.id AS new_id FROM (SELECT root_id, content_key, MIN(file_id) AS id FROM absent WHERE gone GROUP BY 1, 2 HAVING COUNT(*) = 1) o JOIN (SELECT root_id, content_key, MIN(file_id) AS id FROM t WHERE new GROUP BY 1, 2 HAVING COUNT(*) = 1) n ON n.root_id = o.root_id AND n.content_key = o.content_key),
    after AS (SELECT CASE WHEN m.old_id IS NOT NULL THEN m.old_id ELSE t.file_id END AS file_id, root_id, rel_path, size_bytes, file_status, CASE WHEN m.old_id IS NOT NULL THEN 'moved' ELSE outcome END AS outcome FROM t LEFT JOIN m ON m.new_id = t.file_id
        UNION ALL SELECT file_id, root_id, rel_path, size_bytes, CASE WHEN gone THEN 'missing' ELSE file_status END, CASE WHEN gone THEN 'missing' ELSE 'kept' END FROM absent WHERE file_id NOT IN (SELECT old_id FROM m))"""


def _after(a) -> DataFrame:
    return archive.sweep(*_swept(a), F.lit(_NOW).cast("timestamp_ntz"))


def swept(sql: str):
    """`query` over the tables of a sweep."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Archive(spark, sf_dir))
        ORACLES[f.__name__] = oracle(f",{_SWEEP.removeprefix('WITH ')}\n{sql}")
        return f

    return add


@swept("SELECT file_id, root_id, rel_path, size_bytes, file_status, outcome FROM after")
def sweep_snapshot(a):
    return _after(a).select("file_id", "root_id", "rel_path", "size_bytes", "file_status", "outcome")


@swept("SELECT root_id, outcome, COUNT(*) AS n FROM after GROUP BY 1, 2")
def sweep_statistics(a):
    return _after(a).groupBy("root_id", "outcome").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN file_id % 10 = 1 THEN file_id - 1 ELSE file_id END AS file_id, rel_path, size_bytes FROM files WHERE NOT (file_id % 10 = 0 AND EXISTS (SELECT 1 FROM files g WHERE g.file_id = files.file_id + 1))")
def re_anchor(a):
    ids = a.files.where("file_id % 10 = 1").select((F.col("file_id") - 1).alias("old_id"), F.col("file_id").alias("new_id"))
    return archive.re_anchor(a.files, ids).select("file_id", "rel_path", "size_bytes")


@query("SELECT user_id AS file_id, STRING_AGG(event_type, ';' ORDER BY event_id) AS content_key FROM events GROUP BY 1")
def content_keys(a):
    rows = a.spark.read.parquet(f"{a.sf_dir}/events.parquet").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("hdu"), F.col("event_type").alias("fingerprint"))
    return archive.content_key(rows)


@query("SELECT file_id, md5(LOWER(UPPER(rel_path))) AS path_hash FROM files")
def path_identity(a):
    return a.files.select("file_id", archive.path_hash(F.upper("rel_path"), case_sensitive=False).alias("path_hash"))


@query("SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'xisf' WHEN file_id % 3 = 1 THEN 'fits' ELSE 'other' END AS format, CASE file_id % 6 WHEN 2 THEN 'log' WHEN 5 THEN 'sidecar' END AS sidecar, bucket FROM files")
def file_kinds(a):
    name = F.concat(F.col("rel_path"), F.element_at(F.array(*(F.lit(x) for x in (".XISF", ".fit.gz", ".log", ".xisf", ".fz", ".json"))), (F.col("file_id") % 6 + 1).cast("int")))
    return a.files.select("file_id", archive.file_format(name).alias("format"), archive.sidecar_kind(name).alias("sidecar"), archive.bucket(F.col("rel_path")).alias("bucket"))


@query("SELECT file_id, rel_path FROM files WHERE NOT (rel_path LIKE '%/f1%' OR rel_path LIKE 'other/%' OR rel_path LIKE '%7.fits')")
def ignore_names(a):
    return a.files.where(~archive.ignored(F.col("rel_path"), archive.ignore_list("f1*, OTHER\n*7.fits"))).select("file_id", "rel_path")


@query("SELECT s.root_id, s.rel_path, MIN(f.file_id) AS frame_id FROM (SELECT root_id, CONCAT(LEFT(rel_path, LENGTH(rel_path) - 5), CASE file_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.stars.csv' ELSE 'x.log' END) AS rel_path FROM files) s LEFT JOIN files f ON f.root_id = s.root_id AND STARTS_WITH(s.rel_path, CONCAT(LEFT(f.rel_path, LENGTH(f.rel_path) - 5), '.')) GROUP BY 1, 2")
def sidecar_link(a):
    end = F.element_at(F.array(*(F.lit(x) for x in (".json", ".stars.csv", "x.log"))), (F.col("file_id") % 3 + 1).cast("int"))
    sidecars = a.files.select("root_id", F.concat(F.regexp_replace("rel_path", r"\.fits$", ""), end).alias("rel_path"))
    return archive.link_sidecars(sidecars, a.files, a.frames.select("frame_id", "file_id"))


@query("SELECT frame_id, abs_path, CASE WHEN STARTS_WITH(abs_path, '/data/south/old/') THEN CAST(2 AS INT) WHEN STARTS_WITH(abs_path, '/data/south/') THEN CAST(1 AS INT) ELSE CAST(0 AS INT) END AS root_of_path FROM v_frames")
def longest_prefix_root(a):
    return archive.root_of(a.v_frames.select(ID, "abs_path"), a.roots)


_NEW = "SELECT file_id, size_bytes + 7 AS size_bytes, TIMESTAMP '2024-02-02 00:00:00' AS first_seen FROM files WHERE file_id % 4 = 0"
_OLD = "SELECT file_id, size_bytes, mtime_utc AS first_seen FROM files WHERE file_id % 6 <> 0"


@query(f"SELECT o.file_id, COALESCE(n.size_bytes, o.size_bytes) AS size_bytes, o.first_seen FROM ({_OLD}) o LEFT JOIN ({_NEW}) n USING (file_id) UNION ALL SELECT file_id, size_bytes, first_seen FROM ({_NEW}) n WHERE NOT EXISTS (SELECT 1 FROM ({_OLD}) o WHERE o.file_id = n.file_id)")
def upsert_snapshot(a):
    old = a.files.where("file_id % 6 <> 0").select("file_id", "size_bytes", F.col("mtime_utc").alias("first_seen"))
    new = a.files.where("file_id % 4 = 0").select("file_id", (F.col("size_bytes") + 7).alias("size_bytes"), F.lit("2024-02-02 00:00:00").cast("timestamp_ntz").alias("first_seen"))
    return archive.upsert(old, new, ["file_id"], keep=("first_seen",))


@query("SELECT DISTINCT frame_id, tag_id FROM (SELECT * FROM frame_tags UNION ALL SELECT frame_id, CAST(2 AS INT) FROM frames WHERE image_type = 'light')")
def insert_ignore_tags(a):
    return archive.insert_ignore(a.frame_tags, a.frames.where("image_type = 'light'").select(ID, F.lit(2).alias("tag_id")), [ID, "tag_id"])


@query("SELECT frame_id, ord, keyword, value FROM cards WHERE frame_id % 10 <> 0 UNION ALL SELECT frame_id, 0, 'NEW', 'x' FROM frames WHERE frame_id % 10 = 0")
def replace_child_cards(a):
    new = a.frames.where("frame_id % 10 = 0").select(ID, F.lit(0).alias("ord"), F.lit("NEW").alias("keyword"), F.lit("x").alias("value"))
    return archive.replace_children(a.cards, new, ID)


@query("SELECT c.frame_id, c.keyword FROM cards c JOIN files f ON f.file_id = c.frame_id WHERE f.file_status <> 'missing'")
def cascade_delete_cards(a):
    gone = a.files.where("file_status = 'missing'").withColumnRenamed("file_id", ID)
    return archive.cascade_delete(a.frames, gone, ID, {"cards": a.cards})["cards"].select(ID, "keyword")


@query("SELECT COUNT(*) AS files, COUNT(f.frame_id) AS frames FROM files l LEFT JOIN frames f ON f.file_id = l.file_id WHERE l.file_status = 'missing' AND l.last_seen_utc < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 DAY")
def prune_counts(a):
    gone = archive.prunable(a.files, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 5)
    return gone.join(a.frames.select("file_id", ID), "file_id", "left").agg(F.count_distinct("file_id").alias("files"), F.count(ID).alias("frames"))


@query("SELECT frame_id, CASE WHEN frame_id % 5 = 0 THEN 'renamed' ELSE object_canonical END AS object_canonical FROM frames")
def conditional_update(a):
    changes = a.frames.where("frame_id % 5 = 0").select(ID, F.lit("renamed").alias("object_canonical"))
    return archive.set_where(a.frames.select(ID, "object_canonical"), changes, [ID], "object_canonical")


@query("SELECT image_type, COUNT(*) AS n FROM frames WHERE object IS NOT NULL AND object_canonical IS DISTINCT FROM TRIM(object) GROUP BY 1")
def canonical_would_change(a):
    new = catalogs.object_canonical(F.col("object"))
    return a.frames.where(F.col("object").isNotNull() & ~new.eqNullSafe(F.trim("object"))).groupBy("image_type").agg(F.count("*").alias("n"))


_NAMES = "(VALUES ('M31', 'M 31'), ('Target', 'Unknown field'), ('ngc_7000', 'NGC 7000'), ('Icarus', ''), ('no such', 'M 1'))"


def _names(a) -> DataFrame:
    return a.spark.sql(f"SELECT a AS raw, b AS canonical FROM {_NAMES} AS t(a, b)")


@query(f"SELECT raw, canonical, COUNT(*) AS frames FROM {_NAMES} AS t(raw, canonical) JOIN frames f ON f.object = raw WHERE canonical <> '' AND f.object_canonical IS DISTINCT FROM canonical GROUP BY 1, 2")
def names_preview(a):
    return archive.preview_names(a.frames, _names(a))


@query(f"SELECT frame_id, COALESCE(NULLIF(canonical, ''), object_canonical) AS object_canonical FROM frames LEFT JOIN {_NAMES} AS t(raw, canonical) ON object = raw")
def names_applied(a):
    return archive.apply_names(a.frames, _names(a)).select(ID, "object_canonical")


@query("SELECT f.frame_id, COALESCE(r.site_id, 4) AS resolved_site FROM frames f LEFT JOIN rigs r USING (rig_id)")
def site_resolve(a):
    return archive.resolve_site(a.frames, a.rigs, default_site=4).select(ID, "resolved_site")


# -- actions

@query("SELECT frame_id, abs_path AS src, CONCAT('/stage/', image_type, '/', CASE WHEN n = 0 THEN CONCAT('f', u, '.fits') ELSE CONCAT('f', u, '_', n, '.fits') END) AS dst, 'symlink' AS action FROM (SELECT *, frame_id % 50 AS u, ROW_NUMBER() OVER (PARTITION BY image_type, frame_id % 50 ORDER BY frame_id) - 1 AS n FROM v_frames WHERE image_type <> 'light')")
def stage_plan(a):
    rows = a.v_frames.where("image_type <> 'light'").withColumn("filename", F.concat(F.lit("f"), (F.col(ID) % 50).cast("string"), F.lit(".fits")))
    return actions.stage_plan(rows, "/stage/")


@query("SELECT frame_id, CONCAT(CAST(frame_id AS VARCHAR), ',', image_type, ',\"a,', COALESCE(object, ''), '\"') AS line FROM frames")
def export_csv(a):
    return actions.export_lines(a.frames.withColumn("o", F.concat(F.lit("a,"), F.coalesce("object", F.lit("")))), "csv", (ID, "image_type", "o"))


@query("SELECT frame_id, abs_path AS line FROM v_frames WHERE image_type = 'flat' AND gain = 200 ORDER BY date_obs_utc DESC, frame_id LIMIT 100000")
def export_paths(a):
    node = {"op": "and", "clauses": [cmp("image_type", "eq", "flat"), cmp("gain", "eq", 200)]}
    return actions.export_lines(actions.by_filter(a.v_frames, node), "paths")


@query("SELECT frame_id, abs_path AS src, CONCAT('/data/north/archive/', filename) AS dst, CONCAT('archive/', filename) AS rel_path, 'move' AS action FROM v_frames WHERE image_type = 'bias'")
def move_plan(a):
    return actions.move_plan(a.v_frames.where("image_type = 'bias'"), "/data/north", "archive")


@query("SELECT frame_id, image_type FROM frames WHERE frame_id IN (SELECT frame_id FROM collection_frames WHERE collection_id = 2)")
def resolve_by_ids(a):
    return actions.by_ids(a.frames, a.collection_frames.where("collection_id = 2")).select(ID, "image_type")


@query("SELECT f.frame_id, h.header, t.tags, c.collections, a.artifacts FROM frames f JOIN (SELECT frame_id, STRING_AGG(CONCAT(keyword, '=', value), ';' ORDER BY ord) AS header FROM cards GROUP BY 1) h USING (frame_id) LEFT JOIN (SELECT frame_id, STRING_AGG(name, ';' ORDER BY name) AS tags FROM frame_tags JOIN tags ON tags.id = tag_id GROUP BY 1) t USING (frame_id) LEFT JOIN (SELECT frame_id, STRING_AGG(name, ';' ORDER BY name) AS collections FROM collection_frames JOIN collections ON id = collection_id GROUP BY 1) c USING (frame_id) LEFT JOIN (SELECT file_id // 3 AS frame_id, STRING_AGG(CONCAT(filename, '.txt:', size_bytes), ';' ORDER BY filename) AS artifacts FROM files GROUP BY 1) a USING (frame_id) WHERE f.image_type = 'master'")
def frame_detail_nested(a):
    ids = a.frames.where("image_type = 'master'").select(ID)
    beside = a.files.select(F.floor(F.col("file_id") / 3).alias(ID), F.lit("sidecar").alias("kind"), F.concat("filename", F.lit(".txt")).alias("filename"), "rel_path", "size_bytes", "mtime_utc")
    d = views.detail(a.frames, a.cards, a.frame_tags, a.tags, ids, a.collection_frames, a.collections, beside)
    joined = lambda c, f: F.array_join(F.transform(c, f), ";").alias(c)
    return d.select(ID, joined("header", lambda c: F.concat_ws("=", c["keyword"], c["value"])), F.array_join("tags", ";").alias("tags"), F.array_join("collections", ";").alias("collections"), joined("artifacts", lambda x: F.concat_ws(":", x["filename"], x["size_bytes"].cast("string"))))


@query("SELECT frame_id, image_type FROM v_frames WHERE image_type = 'flat' AND LOWER(filter) = 'ha' AND LOWER(object_canonical) IN ('m 31', 'ngc 224')")
def browse_bar(a):
    node = browse(image_type="flat", filter="Ha", object="M31")
    return a.v_frames.where(compile_filter(node)).select(ID, "image_type")


_BEST_OF = " UNION ALL ".join(f"SELECT {k} AS rule_order, light_id, frame_id, total FROM (SELECT l.frame_id AS light_id, c.frame_id, ROW_NUMBER() OVER (PARTITION BY l.frame_id ORDER BY {_MATCH[t][2]}) AS r, COUNT(*) OVER (PARTITION BY l.frame_id) AS total FROM frames l JOIN frames c ON {_MATCH[t][0]} AND {_DAYS} <= {_MATCH[t][1]} WHERE l.image_type = 'light') WHERE r = 1" for k, t in enumerate(("dark", "bias", "flat")))


@query(_BEST_OF)
def calib_all_rules(a):
    return match.match_all(a.frames, limit=1).select("rule_order", "light_id", "frame_id", "total")


_ROOT_SQL = "SELECT CAST(n_nationkey AS INT) AS root_id, n_nationkey % 4 <> 0 AS enabled, CAST(n_nationkey % 5 * 30 AS INT) AS interval_minutes, CASE WHEN n_nationkey % 3 <> 0 THEN TIMESTAMP '2024-01-01 12:00:00' - INTERVAL 10 MINUTE * n_nationkey END AS last_scan_utc FROM nation"


@query(f"SELECT root_id FROM ({_ROOT_SQL}) WHERE enabled AND interval_minutes > 0 AND (last_scan_utc IS NULL OR last_scan_utc + INTERVAL 1 MINUTE * interval_minutes <= TIMESTAMP '2024-01-01 12:00:00')")
def due_roots(a):
    key = F.col("rig_id")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    last = F.when(key % 3 != 0, now - F.make_interval(mins=key * 10))
    roots = a.rigs.select(key.alias("root_id"), (key % 4 != 0).alias("enabled"), (key % 5 * 30).alias("interval_minutes"), last.alias("last_scan_utc"))
    return archive.due_roots(roots, now).select("root_id")


@query("SELECT frame_id, collection_id FROM collection_frames c WHERE NOT EXISTS (SELECT 1 FROM frames f WHERE f.frame_id = c.frame_id AND f.image_type = 'light' AND c.collection_id = 1)")
def membership_remove(a):
    gone = a.frames.where("image_type = 'light'").select(ID, F.lit(1).alias("collection_id"))
    return a.collection_frames.join(gone, [ID, "collection_id"], "left_anti")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, COUNT(*) AS n FROM {t}" for t in ("frames", "files", "cards", "rigs", "flat_sets", "frame_tags")))
def table_counts(a):
    out = None
    for t in ("frames", "files", "cards", "rigs", "flat_sets", "frame_tags"):
        one = getattr(a, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")).select("name", "n")
        out = one if out is None else out.unionByName(one)
    return out


_SAVED = {"bright": (cmp("exposure_s", "lt", 30), "exposure_s < 30"), "best": (_BEST, has("frame_tags", "k.tag_id = 1")), "galaxy": (cmp("object", "eq", "M 31"), "LOWER(object_canonical) IN ('m 31', 'ngc 224')")}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, COUNT(*) AS last_count FROM v_frames v WHERE {w}" for n, (_, w) in _SAVED.items()))
def saved_query_counts(a):
    out = None
    for name, (node, _) in _SAVED.items():
        one = a.v_frames.where(compile_filter(node, a.context)).agg(F.lit(name).alias("name"), F.count("*").alias("last_count")).select("name", "last_count")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'best' AS name, abs_path FROM v_frames v WHERE " + _SAVED["best"][1])
def saved_query_paths(a):
    return actions.saved_paths(a.v_frames, "best", _SAVED["best"][0], a.context)


@query("SELECT 'job-1' AS job, frame_id, abs_path AS src, CONCAT('/data/north/trash/', filename) AS dst, 'trash' AS action, 'planned' AS state FROM v_frames WHERE file_status = 'error'")
def job_ledger(a):
    return actions.ledger("job-1", actions.move_plan(a.v_frames.where("file_status = 'error'"), "/data/north", "trash", "trash"))


@query("SELECT filter_id, name FROM filters UNION ALL SELECT CAST(5 + ROW_NUMBER() OVER (ORDER BY LOWER(name)) AS INT), name FROM (SELECT DISTINCT event_type AS name FROM events WHERE event_type <> 'view')")
def register_names(a):
    names = a.cards.where("keyword = 'TYPE'").select(F.col("value").alias("name")).where("name <> 'view'").unionByName(a.filters.select(F.lower("name").alias("name")))
    return archive.register(names, a.filters, "name", "filter_id")


@query("SELECT COALESCE(MAX(flat_set_id), 0) AS version FROM flat_sets")
def max_version(a):
    return a.flat_sets.agg(F.coalesce(F.max("flat_set_id"), F.lit(0)).alias("version"))


@query(_RUNS.replace("28800", "43200").replace("WHERE image_type = 'flat'", "").replace("rig_id, filter_id", "rig_id").replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2").replace("SELECT rig_id, run, COUNT(*) AS n, MIN(date_obs_utc) AS first_utc, MAX(date_obs_utc) AS last_utc, MIN(session_night) AS night", "SELECT rig_id, run, COUNT(*) AS n, MIN(date_obs_utc) AS first_utc, MAX(date_obs_utc) AS last_utc").replace("SELECT rig_id, run,", "SELECT rig_id,").replace("GROUP BY 1, 2", "GROUP BY rig_id, run"))
def streaming_runs(a):
    from skyquarry.streaming.runs import run_to_end

    return run_to_end(a.spark, a.sf_dir)
