"""Header values to typed fields, as Column expressions over a map of first card values (keyword -> text)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogs import object_canonical

# Candidate keywords of each field, first non-blank wins.
KEYWORDS = {
    "date_obs": ("DATE-OBS", "DATE_OBS"), "exposure_s": ("EXPTIME", "EXPOSURE"), "gain": ("GAIN", "GAINRAW", "GAINADU"), "offset_adu": ("OFFSET", "BLKLEVEL"),
    "binx": ("XBINNING", "CCDXBIN"), "biny": ("YBINNING", "CCDYBIN"), "set_temp_c": ("SET-TEMP",), "ccd_temp_c": ("CCD-TEMP",), "focal_len_mm": ("FOCALLEN",),
    "instrument": ("INSTRUME", "CAMERA"), "telescope": ("TELESCOP",), "image_type": ("IMAGETYP", "FRAME", "PICTTYPE"), "object": ("OBJECT",), "ra": ("RA", "OBJCTRA"),
    "dec": ("DEC", "OBJCTDEC"), "filter": ("FILTER",), "airmass": ("AIRMASS",), "sqm": ("SQM",), "sqm_sensor": ("SQMSRC",), "sqm_time": ("SQMTIME",),
    "sqm_dt_s": ("SQMDT",), "pier_side": ("PIERSIDE",), "row_order": ("ROWORDER",),
}
# Fixed values: (mode, pattern, result) in order of priority; comparisons ignore case.
VALUES = {
    "image_type": (
        ("contains", "flatdark", "darkflat"), ("contains", "dark flat", "darkflat"), ("contains", "darkflat", "darkflat"), ("exact", "master dark", "master"), ("contains", "master", "master"),
        ("contains", "integration", "master"), ("contains", "stack", "master"), ("exact", "light", "light"), ("exact", "light frame", "light"), ("exact", "dark", "dark"),
        ("exact", "dark frame", "dark"), ("exact", "flat", "flat"), ("exact", "flat field", "flat"), ("exact", "bias", "bias"), ("exact", "bias frame", "bias"), ("contains", "zero", "bias"),
    ),
    "filter": (("exact", "!shutter!", ""), ("exact", "dark", ""), ("exact", "none", "")),
    "object": (("exact", "flatwizard", ""),),
    "pier_side": (("exact", "east", "east"), ("exact", "west", "west")),
    "row_order": (("exact", "top-down", "top-down"), ("exact", "bottom-up", "bottom-up")),
}
IMAGE_TYPES = ("light", "dark", "flat", "bias", "darkflat", "master")
FINGERPRINT = ("DATE-OBS", "INSTRUME", "EXPTIME", "NAXIS1", "NAXIS2", "IMAGETYP", "XBINNING")


@dataclass(frozen=True)
class Mapping:
    """A dialect: field -> its keywords, field -> its value rules (mode, pattern, result), both in order of priority."""

    keywords: dict[str, tuple[str, ...]]
    values: dict[str, tuple[tuple[str, str, str], ...]]


DEFAULT_MAPPING = Mapping(KEYWORDS, VALUES)
MODES = ("exact", "contains", "regex")


def _compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine takes the pattern; asked before the query that would fail by it."""
    try:
        spark.range(1).select(F.lit("").rlike(f"(?i){pattern}")).collect()
    except PySparkException:
        return False
    return True


def load_mapping(header_map: DataFrame, value_map: DataFrame) -> Mapping:
    """The dialect that an operator's tables give: header_map (field, keyword, priority, id, enabled) and value_map (field, raw_value, normalized,
    match_mode, priority, id). Unknown modes are exact. Without any enabled keyword the default dialect.

    A regex that can't be compiled is left out, as if it never matched. Both are configuration, a few rows for each of two dozen fields, and are read
    by the driver."""
    keywords: dict[str, list] = {}
    for r in header_map.where("enabled and field is not null and keyword is not null").orderBy("field", "priority", "id").collect():
        keywords.setdefault(r.field, []).append(r.keyword)
    if not keywords:
        return DEFAULT_MAPPING
    values: dict[str, list] = {}
    for r in value_map.where("field is not null and raw_value is not null and normalized is not null").orderBy("field", "priority", "id").collect():
        mode = r.match_mode if r.match_mode in MODES else "exact"
        if mode != "regex" or _compiles(value_map.sparkSession, r.raw_value):
            values.setdefault(r.field, []).append((mode, r.raw_value, r.normalized))
    return Mapping({k: tuple(v) for k, v in keywords.items()}, {k: tuple(v) for k, v in values.items()})


def same_text(value: Column) -> Column:
    """The key under which names are equal: case, accents and blanks at the end don't count."""
    return F.collate(value, "UNICODE_CI_AI_RTRIM")


def first_value(cards: Column, *keywords: str) -> Column:
    """The first of the keywords whose value is there and not blank."""
    return F.coalesce(*(F.nullif(F.trim(F.element_at(cards, k)), F.lit("")) for k in keywords)) if keywords else F.lit(None).cast("string")


def normalise(value: Column, rules: tuple) -> Column:
    """The result of the first rule that applies, else the value; regex rules search."""
    low, out = F.lower(value), None
    for mode, pattern, result in rules:
        cond = {"exact": lambda p: low == p.lower(), "contains": lambda p: low.contains(p.lower()), "regex": lambda p: value.rlike(f"(?i){p}")}[mode](pattern)
        out = F.when(cond, F.lit(result)) if out is None else out.when(cond, F.lit(result))
    return value if out is None else out.otherwise(value)


def image_type(value: Column, mapping: Mapping = DEFAULT_MAPPING) -> Column:
    kind = normalise(value, mapping.values.get("image_type", ()))
    return F.when(kind.isin(*IMAGE_TYPES), kind).otherwise(F.lit("unknown"))


def number(value: Column) -> Column:
    return F.trim(value).try_cast("double")


def integer(value: Column) -> Column:
    """Rounded half away from zero; null unless the whole text is a number."""
    d = number(value)
    return F.when(d >= 0, F.floor(d + 0.5)).otherwise(F.ceil(d - 0.5)).cast("int")


def coordinate(value: Column, hours: bool) -> Column:
    """Degrees: a decimal number as it is, sexagesimal [+-]d m s with spaces or colons (hours: times 15)."""
    pattern = r"^\s*([+-]?)(\d+)[ :]+(\d+)(?:[ :]+(\d+(?:\.\d*)?))?\s*$"
    part = lambda i: F.nullif(F.regexp_extract(value, pattern, i), F.lit("")).cast("double")
    size = part(2) + part(3) / 60 + F.coalesce(part(4), F.lit(0.0)) / 3600
    signed = F.when(F.regexp_extract(value, pattern, 1) == "-", -size).otherwise(size)
    return F.coalesce(number(value), signed * (15 if hours else 1))


def timestamp(value: Column) -> Column:
    """Trimmed, without Z, with at most six digits of fraction; null unless a date and time."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(value), "Z$", ""), r"(\.\d{6})\d+$", "$1")
    return F.when(plain.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d"), plain.try_cast("timestamp_ntz"))


def observing_night(at: Column, offset_hours: float | Column) -> Column:
    """The date of local noon before the moment: UTC plus offset, less twelve hours."""
    seconds = F.round((F.lit(offset_hours) if not isinstance(offset_hours, Column) else offset_hours) * 3600) - 12 * 3600
    return (F.date_trunc("second", at).cast("timestamp_ntz") + F.make_interval(secs=seconds)).cast("date")


def fingerprint(cards: Column) -> Column:
    """MD5 of the identity cards, each followed by a bar."""
    return F.md5(F.concat(*(F.concat(F.coalesce(F.element_at(cards, k), F.lit("")), F.lit("|")) for k in FINGERPRINT)))


def quarantine_reason(date: Column, kind: Column) -> Column:
    return F.when(date.isNull(), F.lit("no-dateobs")).when(kind == "unknown", F.lit("unknown-type"))


def resolve(cards: Column, offset_hours: float | Column = 0.0, mapping: Mapping = DEFAULT_MAPPING) -> dict[str, Column]:
    """All fields of a frame from its cards, by a dialect; fields that it doesn't map are null."""
    raw = {k: first_value(cards, *mapping.keywords.get(k, ())) for k in KEYWORDS}
    rules = {k: mapping.values.get(k, ()) for k in VALUES}
    kind = image_type(raw["image_type"], mapping)
    at = timestamp(raw["date_obs"])
    name = F.nullif(normalise(raw["object"], rules["object"]), F.lit(""))
    used = F.nullif(normalise(raw["filter"], rules["filter"]), F.lit(""))
    missing = kind.isin("light", "flat") & used.isNull()
    return {
        "image_type": kind, "object": name, "object_canonical": object_canonical(name), "ra_deg": coordinate(raw["ra"], False), "dec_deg": coordinate(raw["dec"], False), "date_obs_utc": at,
        "session_night": observing_night(at, offset_hours), "exposure_s": number(raw["exposure_s"]).cast("decimal(10,3)"), "gain": integer(raw["gain"]), "offset_adu": integer(raw["offset_adu"]),
        "binx": integer(raw["binx"]), "biny": integer(raw["biny"]), "set_temp_c": number(raw["set_temp_c"]).cast("decimal(5,2)"), "ccd_temp_c": number(raw["ccd_temp_c"]).cast("decimal(5,2)"),
        "focal_len_mm": number(raw["focal_len_mm"]).cast("decimal(7,1)"), "filter_raw": F.when(missing, F.lit("CLEAR")).otherwise(used), "filter_defaulted": missing,
        "airmass": number(raw["airmass"]).cast("decimal(6,3)"), "sqm_mag_arcsec2": number(raw["sqm"]).cast("decimal(6,3)"), "sqm_sensor": raw["sqm_sensor"], "sqm_time": raw["sqm_time"], "sqm_dt_s": number(raw["sqm_dt_s"]),
        "pier_side": normalise(raw["pier_side"], rules["pier_side"]), "row_order": normalise(raw["row_order"], rules["row_order"]), "instrument": raw["instrument"], "telescope": raw["telescope"],
        "fingerprint": fingerprint(cards), "review_reason": quarantine_reason(at, kind),
    } | {"ra_deg": F.when(F.element_at(cards, "RA").isNotNull(), coordinate(raw["ra"], False)).otherwise(coordinate(raw["ra"], True))}


def resolve_frames(units: DataFrame, offset_hours: float | Column = 0.0, mapping: Mapping = DEFAULT_MAPPING) -> DataFrame:
    """One whole row for each image unit (what `sources.headers.card_map` gives: first, bitpix, naxis, naxis1, naxis2, and columns that are kept, such as path and
    hdu): width, height, bitpix and naxis of the image itself, whatever its cards say of them, and all fields of the cards."""
    kept = [c for c in units.columns if c not in ("first", "cards", "is_image", "bitpix", "naxis", "naxis1", "naxis2", "error", "format")]
    fields = resolve(F.col("first"), offset_hours, mapping)
    return units.select(*kept, F.col("naxis1").alias("width"), F.col("naxis2").alias("height"), "bitpix", "naxis", *(c.alias(name) for name, c in fields.items()))


def haversine_deg(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in degrees."""
    half = F.pow(F.sin(F.radians(dec1 - dec2) / 2), 2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(F.radians(ra1 - ra2) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), half))))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere of 6,371,000 m."""
    return F.radians(haversine_deg(lon1, lat1, lon2, lat2)) * 6371000.0


def csv_cell(value: Column) -> Column:
    """Quoted where a comma, a quote or a line end needs it."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))).otherwise(text)


def safe_leaf(name: Column) -> Column:
    """A file name's part without separators or control characters."""
    return F.regexp_replace(F.trim(name), r"[/\\\x00-\x1f]+", "_")
