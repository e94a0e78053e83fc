"""The JSON filter language, compiled to Columns.

A node is {} (everything), {"op": "and" | "or" | "not", "clauses": [...]}, {"op": "cone", "ra", "dec", "radius_deg"},
{"op": "tagged" | "untagged" | "in_collection", "value": name or id}, or a comparison {"field", "op", "value"}; the field "keyword:XYZ"
compares header cards. Membership becomes a correlated EXISTS, which Catalyst turns into a semi, anti or existence join,
also below "or" and "not".
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquarry.functions.catalogs import designation_values
from skyquarry.functions.headers import haversine_deg

# The fields of the filter language, by kind.
TEXT = ("image_type", "object", "object_canonical", "filter", "rig", "camera", "site", "bucket", "file_status", "root_label", "pier_side", "row_order")
DATE = ("session_night", "date_obs_utc")
NUMBER = ("exposure_s", "gain", "offset_adu", "binx", "biny", "ccd_temp_c", "set_temp_c", "airmass", "sqm_mag_arcsec2", "ra_deg", "dec_deg", "focus_pos", "rotator_deg", "guide_rms_arcsec", "naxis1", "naxis2")
FIELDS = {f: "text" for f in TEXT} | {f: "date" for f in DATE} | {f: "number" for f in NUMBER}
#: Text fields from closed vocabularies of lower-case words: only the literal is folded, so that equality reaches the Parquet scan.
EXACT = ("image_type", "file_status", "bucket")
COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b,
}


class QueryError(ValueError):
    """The filter or sort is not valid."""


@dataclass
class Context:
    """The relations that membership nodes look into."""

    keywords: DataFrame | None = None
    tags: DataFrame | None = None
    frame_tags: DataFrame | None = None
    collections: DataFrame | None = None
    collection_frames: DataFrame | None = None
    lenient_numeric: bool = False


def _literal(kind: str, value: Any) -> Any:
    if kind == "number":
        if isinstance(value, bool):
            raise QueryError("numeric field needs a number")
        if isinstance(value, (int, float)):
            return value
        try:
            return float(value)
        except (TypeError, ValueError):
            raise QueryError(f"numeric field needs a number, got {value!r}") from None
    if isinstance(value, bool) or not isinstance(value, (str, int, float)):
        raise QueryError("value must be a string for this field")
    return value if isinstance(value, str) else f"{value:.6f}"


def _typed(field: str, kind: str, value: Any) -> tuple[Column, Column]:
    """The two sides of a comparison."""
    plain = _literal(kind, value)
    if kind == "text":
        return F.col(field) if field in EXACT else F.lower(F.col(field)), F.lit(plain.lower())
    if kind == "date":
        return F.col(field), F.lit(plain).cast("date" if field == "session_night" else "timestamp_ntz")
    return F.col(field), F.lit(plain)


def _need(node: dict, key: str = "value") -> Any:
    if key not in node:
        raise QueryError(f"{node.get('op', 'comparison')} needs {key}")
    return node[key]


def _comparison(field: str, node: dict) -> Column:
    if field not in FIELDS:
        raise QueryError(f"unknown field {field!r}")
    kind, op = FIELDS[field], node.get("op", "eq")
    if op == "isnull":
        return F.col(field).isNull()
    if op == "notnull":
        return F.col(field).isNotNull()
    if field == "object" and op in ("eq", "like") and isinstance(node.get("value"), str):
        names = designation_values(node["value"])
        if op == "eq":
            return F.lower("object_canonical").isin(*(n.lower() for n in names))
        return reduce(lambda a, b: a | b, (F.col("object_canonical").ilike(f"%{n}%") for n in names))
    if op == "in":
        values = _need(node)
        if not isinstance(values, list) or not values:
            raise QueryError("in needs a non-empty list")
        left = _typed(field, kind, values[0])[0]
        return left.isin(*(_typed(field, kind, v)[1] for v in values))
    if op == "between":
        values = _need(node)
        if not isinstance(values, list) or len(values) != 2:
            raise QueryError("between needs two values")
        (left, low), (_, high) = (_typed(field, kind, v) for v in values)
        return left.between(low, high)
    if op == "like":
        return F.col(field).cast("string").ilike(str(_literal("text", _need(node))))
    if op not in COMPARE:
        raise QueryError(f"unsupported operator {op!r}")
    return COMPARE[op](*_typed(field, kind, _need(node)))


def _keyword(field: str, node: dict, ctx: Context) -> Column:
    name, op = field.removeprefix("keyword:"), node.get("op", "eq")
    if not name:
        raise QueryError("empty keyword name")
    if ctx.keywords is None:
        raise QueryError("no header cards to look into")
    # the alias keeps frame_id below from being found before the outer one
    cards = ctx.keywords.select(F.col("frame_id").alias("_frame"), "keyword", "value").alias("_cards")
    same = (F.col("_frame") == F.col("frame_id").outer()) & (F.upper("keyword") == name.upper())
    if op in ("isnull", "notnull"):
        found = cards.where(same).exists()
        return ~found if op == "isnull" else found
    value = _need(node)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        text = F.col("value")
        left = text.try_cast("decimal(20,6)")
        if ctx.lenient_numeric:
            left = F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+(?:\.\d*)?)", 1), F.lit("")).try_cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)"))
        cond = left.cast("string").ilike(str(value)) if op == "like" else COMPARE.get(op, lambda *_: None)(left, F.lit(str(value)).cast("decimal(20,6)"))
    else:
        right = _literal("text", value)
        cond = F.col("value").ilike(right) if op == "like" else COMPARE.get(op, lambda *_: None)(F.lower("value"), F.lit(right.lower()))
    if cond is None:
        raise QueryError(f"unsupported keyword operator {op!r}")
    return cards.where(same & cond).exists()


def _member(node: dict, bridge: DataFrame | None, names: DataFrame | None, key: str) -> Column:
    value = _need(node)
    if bridge is None or isinstance(value, bool) or not isinstance(value, (str, int)):
        raise QueryError(f"{node['op']} needs a name or an id")
    rows = bridge.select(F.col("frame_id").alias("_frame"), F.col(key).alias("_group")).alias("_members")
    if isinstance(value, int):
        rows = rows.where(F.col("_group") == value)
    else:
        if names is None:
            raise QueryError("no names to look into")
        rows = rows.join(F.broadcast(names.where(F.lower("name") == value.lower()).select(F.col("id").alias("_group"))), "_group", "left_semi")  # ids of one name
    return rows.where(F.col("_frame") == F.col("frame_id").outer()).exists()


def cone(ra: float, dec: float, radius: float) -> Column:
    """Within `radius` degrees of a point; a box that respects 0/360 and the poles comes first, so that row groups can be skipped."""
    if not 0 < radius <= 180:
        raise QueryError("cone radius_deg out of range")
    box = F.col("dec_deg").between(dec - radius, dec + radius)
    if abs(dec) + radius < 90:
        half = math.degrees(math.asin(min(1.0, math.sin(math.radians(min(radius, 90))) / math.cos(math.radians(dec)))))
        low, high = (ra - half) % 360, (ra + half) % 360
        side = F.col("ra_deg").between(low, high) if low <= high else (F.col("ra_deg") >= low) | (F.col("ra_deg") <= high)
        box = box & side
    return F.col("ra_deg").isNotNull() & F.col("dec_deg").isNotNull() & box & (haversine_deg(F.col("ra_deg"), F.col("dec_deg"), F.lit(float(ra)), F.lit(float(dec))) <= radius)


def compile_filter(node: dict | None, ctx: Context | None = None) -> Column:
    """The predicate of a filter; QueryError before anything is sent to Spark."""
    ctx = ctx or Context()
    if node is None or node == {}:
        return F.lit(True)
    if not isinstance(node, dict):
        raise QueryError("a node must be an object")
    op = node.get("op")
    if op in ("and", "or", "not"):
        clauses = node.get("clauses")
        if not isinstance(clauses, list) or not clauses:
            raise QueryError(f"{op} needs clauses")
        if op == "not":
            if len(clauses) != 1:
                raise QueryError("not needs one clause")
            return ~compile_filter(clauses[0], ctx)
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), (compile_filter(c, ctx) for c in clauses))
    if op == "cone":
        try:
            return cone(float(_need(node, "ra")), float(_need(node, "dec")), float(_need(node, "radius_deg")))
        except (TypeError, ValueError) as e:
            raise e if isinstance(e, QueryError) else QueryError("cone needs numbers") from None
    if op in ("tagged", "untagged"):
        found = _member(node, ctx.frame_tags, ctx.tags, "tag_id")
        return ~found if op == "untagged" else found
    if op == "in_collection":
        return _member(node, ctx.collection_frames, ctx.collections, "collection_id")
    field = node.get("field")
    if not isinstance(field, str):
        raise QueryError("a comparison needs a field")
    return _keyword(field, node, ctx) if field.startswith("keyword:") else _comparison(field, node)


def filter_fields(node: dict | None) -> list[str]:
    """The fields that a filter names, in order of first appearance."""
    found: dict[str, None] = {}

    def walk(n):
        if isinstance(n, dict):
            if n.get("field") in FIELDS:
                found.setdefault(n["field"])
            for c in n.get("clauses", []) if isinstance(n.get("clauses"), list) else []:
                walk(c)

    walk(node)
    return list(found)


def compile_sort(spec: list[dict] | None) -> list[Column]:
    """Sort keys; nulls first ascending and last descending, newest first by default, frame_id last."""
    keys = []
    for item in spec or [{"field": "date_obs_utc", "dir": "desc"}]:
        if not isinstance(item, dict) or item.get("field") not in FIELDS:
            raise QueryError(f"cannot sort by {item!r}")
        c, way = F.col(item["field"]), item.get("dir", "asc")
        if way not in ("asc", "desc"):
            raise QueryError(f"sort dir must be asc or desc, not {way!r}")
        keys.append(c.desc_nulls_last() if way == "desc" else c.asc_nulls_first())
    return [*keys, F.col("frame_id").asc()]


def browse(image_type=None, filter=None, session_night=None, rig=None, camera=None, root_label=None, object=None) -> dict:
    """The filter bar as a filter; the object is catalog-aware."""
    named = {"image_type": image_type, "filter": filter, "session_night": session_night, "rig": rig, "camera": camera, "root_label": root_label, "object": object}
    clauses = [{"field": k, "op": "eq", "value": v} for k, v in named.items() if v is not None]
    return {"op": "and", "clauses": clauses} if clauses else {}


def page(frames: DataFrame, node: dict | None = None, sort: list[dict] | None = None, limit: int = 50, offset: int = 0, include_missing: bool = False, ctx: Context | None = None) -> DataFrame:
    """A page of the matching frames, in order; missing files are hidden unless asked for or named in the filter."""
    return visible(frames, node, include_missing, ctx).orderBy(*compile_sort(sort)).offset(max(0, offset)).limit(min(500, max(1, limit)))


def visible(frames: DataFrame, node: dict | None = None, include_missing: bool = False, ctx: Context | None = None) -> DataFrame:
    found = frames.where(compile_filter(node, ctx))
    return found if include_missing or "file_status" in filter_fields(node) else found.where(F.col("file_status") != "missing")


def totals(frames: DataFrame, node: dict | None = None, ctx: Context | None = None) -> DataFrame:
    """One row: total and missing_hidden of a filter, in one pass."""
    missing = F.col("file_status") == "missing"
    shown = "file_status" in filter_fields(node)
    found = frames.where(compile_filter(node, ctx))
    return found.agg(F.count(F.when(F.lit(True) if shown else ~missing, 1)).alias("total"), F.count(F.when(F.lit(False) if shown else missing, 1)).alias("missing_hidden"))
