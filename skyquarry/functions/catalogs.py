"""Target names: canonical catalog designations as Column expressions, and the same on the driver for query values."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Catalogs as (acronym, separator, aliases), in order of precedence.
CATALOGS = (
    ("M", " ", ("messier", "m")),
    ("NGC", " ", ("ngc",)),
    ("IC", " ", ("ic",)),
    ("UGC", " ", ("ugc",)),
    ("PGC", " ", ("pgc",)),
    ("Arp", " ", ("arp",)),
    ("Abell", " ", ("abell", "aco")),
    ("Sh2", "-", ("sharpless", "sh2", "sh")),
    ("LBN", " ", ("lbn",)),
    ("LDN", " ", ("ldn",)),
    ("Cr", " ", ("collinder", "cr")),
    ("Mel", " ", ("melotte", "mel")),
    ("vdB", " ", ("vdb",)),
    ("Ced", " ", ("cederblad", "ced")),
    ("C", " ", ("caldwell",)),
    ("B", " ", ("barnard", "b")),
)
# Names that stand for no object.
PLACEHOLDERS = ("", "target", "none", "unknown", "n/a", "na", "test", "flatwizard", "flat", "dark", "bias", "object", "no target", "-")
# NGC numbers of Messier objects 1 to 110; 24 and 25 are IC numbers, 40 and 45 have neither.
_MESSIER = {
    1: 1952, 2: 7089, 3: 5272, 4: 6121, 5: 5904, 6: 6405, 7: 6475, 8: 6523, 9: 6333, 10: 6254,
    11: 6705, 12: 6218, 13: 6205, 14: 6402, 15: 7078, 16: 6611, 17: 6618, 18: 6613, 19: 6273, 20: 6514,
    21: 6531, 22: 6656, 23: 6494, 26: 6694, 27: 6853, 28: 6626, 29: 6913, 30: 7099, 31: 224, 32: 221,
    33: 598, 34: 1039, 35: 2168, 36: 1960, 37: 2099, 38: 1912, 39: 7092, 41: 2287, 42: 1976, 43: 1982,
    44: 2632, 46: 2437, 47: 2422, 48: 2548, 49: 4472, 50: 2323, 51: 5194, 52: 7654, 53: 5024, 54: 6715,
    55: 6809, 56: 6779, 57: 6720, 58: 4579, 59: 4621, 60: 4649, 61: 4303, 62: 6266, 63: 5055, 64: 4826,
    65: 3623, 66: 3627, 67: 2682, 68: 4590, 69: 6637, 70: 6681, 71: 6838, 72: 6981, 73: 6994, 74: 628,
    75: 6864, 76: 650, 77: 1068, 78: 2068, 79: 1904, 80: 6093, 81: 3031, 82: 3034, 83: 5236, 84: 4374,
    85: 4382, 86: 4406, 87: 4486, 88: 4501, 89: 4552, 90: 4569, 91: 4548, 92: 6341, 93: 2447, 94: 4736,
    95: 3351, 96: 3368, 97: 3587, 98: 4192, 99: 4254, 100: 4321, 101: 5457, 102: 5866, 103: 581, 104: 4594,
    105: 3379, 106: 4258, 107: 6171, 108: 3556, 109: 3992, 110: 205,
}
_MESSIER_IC = {24: 4715, 25: 4725}
ALTERNATE = {f"M {m}": f"NGC {n}" for m, n in _MESSIER.items()} | {f"M {m}": f"IC {n}" for m, n in _MESSIER_IC.items()}
MESSIER = {other: m for m, other in ALTERNATE.items()}
_NUMBER = r"[ _-]*([0-9]+)([A-Za-z]?)$"
_PREFIX = {alias: acronym + sep for acronym, sep, aliases in CATALOGS for alias in aliases}
#: alias, number and letter; backtracking tries the aliases in their order.
_PATTERN = f"(?i)^({'|'.join(_PREFIX)}){_NUMBER}"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(pairs.items())))


def tidy(name: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def canonical(name: Column) -> Column:
    """struct<canonical, catalog, placeholder, changed> of a raw name; null for null. Built-in expressions only."""
    plain = tidy(name)
    prefix = F.element_at(_map(_PREFIX), F.lower(F.regexp_extract(plain, _PATTERN, 1)))  # null without a match
    full = F.concat(prefix, F.regexp_extract(plain, _PATTERN, 2), F.upper(F.regexp_extract(plain, _PATTERN, 3)))
    messier = F.element_at(_map(MESSIER), full)
    placeholder = F.lower(plain).isin(*PLACEHOLDERS)
    best = F.when(placeholder, plain).otherwise(F.coalesce(messier, full, plain))
    catalog = F.when(~placeholder, F.when(messier.isNotNull(), F.lit("M")).otherwise(F.regexp_replace(prefix, "[ -]$", "")))
    return F.when(name.isNotNull(), F.struct(best.alias("canonical"), catalog.alias("catalog"), placeholder.alias("placeholder"), (best != plain).alias("changed")))


def object_canonical(name: Column) -> Column:
    """The canonical name, null for placeholders."""
    c = canonical(name)
    return F.when(~c["placeholder"], c["canonical"])


def designations(canonical_name: Column) -> Column:
    """The canonical name and, for a Messier object, its other designation."""
    return F.array_compact(F.array(canonical_name, F.element_at(_map(ALTERNATE), canonical_name)))


def canonical_value(name: str) -> str:
    """canonical() of one Python value, for query values."""
    plain = re.sub(r"\s+", " ", name).strip()
    if plain.lower() in PLACEHOLDERS:
        return plain
    if m := re.match(_PATTERN, plain):
        found = f"{_PREFIX[m[1].lower()]}{m[2]}{m[3].upper()}"
        return MESSIER.get(found, found)
    return plain


def designation_values(name: str) -> list[str]:
    first = canonical_value(name)
    return [first, ALTERNATE[first]] if first in ALTERNATE else [first]
