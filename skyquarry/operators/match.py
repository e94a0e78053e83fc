"""Calibration matching without pairs of frames.

Frames with equal values in a rule's fields have one profile. Which profiles of lights and of candidates fit is a join of distinct profiles, one for all
rules. Profiles of lights that are near one another are a block: a candidate goes to a block once, with the numbers of those of its profiles that it
fits, and is repeated for them in the block's task only. A block's time is divided into buckets of about as many such repeats (one where it has few),
and a light meets the candidates of its own bucket, the nearest few before and after it, which are carried over the buckets of a profile, and those
without a date. The same is done within nights for rules that prefer the light's session. A light's number of candidates is the difference of two
running counts, at both ends of the age limit; an end outside the times of a block's candidates is told from the profile alone.
Lights and candidates meet by buckets dealt out to groups, where sorted arrays are merged at once for all lights; there are as many groups as the
plan itself counts frames for, nothing is counted while a plan is built, and all rules go through one such merge. Keys of profiles are 64-bit hashes.

What a light is given for each bucket are at most `limit` candidates on either side and those whose whole seconds tie with the last of them; of
candidates with one moment and kind the `limit` smallest ids.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The fields that a rule can match on.
MATCH_FIELDS = ("camera_id", "rig_id", "filter_id", "gain", "offset_adu", "binx", "biny", "readout_mode", "set_temp_c", "exposure_s", "rotator_deg")


@dataclass(frozen=True)
class Rule:
    """spec: field -> "exact", "null_ok" or a tolerance; unknown fields are ignored."""

    name: str
    target: str
    spec: dict = field(default_factory=dict)
    max_age_days: int | None = None
    prefer_masters: bool = True
    prefer_same_session: bool = False
    min_frames: int = 0
    priority: int = 10
    enabled: bool = True
    #: Whether the rule's JSON could not be read: it matches nothing, and says so in its warning.
    invalid: bool = False

    @classmethod
    def from_json(cls, name: str, target: str, match: dict | str, **options) -> Rule:
        """match: an object, or its text; text that isn't an object in JSON makes an invalid rule."""
        spec = {}
        if isinstance(match, str):
            try:
                match = json.loads(match)
            except ValueError:
                match = None
        if not isinstance(match, dict):
            return cls(name, target, spec, invalid=True, **options)
        for k, v in match.items():
            if k in MATCH_FIELDS:
                spec[k] = float(v["tol"]) if isinstance(v, dict) and "tol" in v else "null_ok" if isinstance(v, dict) and v.get("null_ok") else "exact"
        return cls(name, target, spec, **options)


# The default rules.
DEFAULT_RULES = (
    Rule("default-dark", "dark", {"camera_id": "exact", "gain": "null_ok", "offset_adu": "null_ok", "binx": "exact", "biny": "exact", "readout_mode": "exact", "set_temp_c": 1.0, "exposure_s": 5.0}, 365, True, False, 10),
    Rule("default-bias", "bias", {"camera_id": "exact", "gain": "exact", "offset_adu": "exact", "binx": "exact", "biny": "exact", "readout_mode": "exact"}, 365, True, False, 20),
    Rule("default-flat", "flat", {"rig_id": "exact", "filter_id": "exact", "binx": "exact", "biny": "exact", "rotator_deg": 5.0}, 30, True, True, 10),
    Rule("default-darkflat", "darkflat", {"camera_id": "exact", "gain": "exact", "offset_adu": "exact", "binx": "exact", "biny": "exact", "exposure_s": 0.5}, 30, True, True, 10),
)


def _number(c: Column) -> Column:
    """Whole numbers plainly, others with six significant digits."""
    d = c.cast("double")
    return F.when(d == F.floor(d), d.cast("long").cast("string")).otherwise(F.format_string("%.6g", d))


def _by_rule(values: list[Column | None]) -> Column:
    """The value of the row's rule (r)."""
    return reduce(lambda c, x: c if x[1] is None else c.when(F.col("r") == x[0], x[1]), enumerate(values), F.when(F.lit(False), None))


def _rest(rule: Rule) -> Column:
    """What equal keys leave to be checked. Columns of lights carry the prefix l_."""
    rest = F.lit(True)
    for name, how in rule.spec.items():
        light, other = F.col(f"l_{name}"), F.col(name)
        if how == "null_ok":
            rest &= light.isNull() | other.isNull() | (light == other)
        elif how != "exact":
            rest &= light.isNull() | (F.abs(other.cast("double") - light.cast("double")) <= how)
    return F.coalesce(rest, F.lit(False))


_SECOND, _DAY = 1_000_000, 86_400_000_000
#: Lights, and candidates once for each profile that they fit, of a block for each of its buckets, on average.
BUCKET = 100_000
#: Tolerances that a block of profiles is wide.
WIDE = 4
#: Frames for each group of places that one call merges, on average.
GROUP = 50_000
#: The bucket of frames without a date.
_UNDATED = -9


def _micros(c: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def _profile(rule: Rule, r: int) -> Column:
    """One number for equal values of the rule's fields."""
    return F.xxhash64(F.lit(r), *(c for n in rule.spec for c in (F.col(n), F.col(n).isNull())))


def _tolerant(rule: Rule) -> list[tuple[str, float]]:
    return [(n, how) for n, how in rule.spec.items() if not isinstance(how, str)]


def _cell(value: Column, width: float) -> Column:
    return F.floor(value.cast("double") / (width or 1.0))


def _block(rule: Rule, r: int) -> Column:
    """The block of a light's profile: its exact values, and wide cells of those with a tolerance."""
    parts = [F.col(n) if how == "exact" else _cell(F.col(n), WIDE * how).alias(n) for n, how in rule.spec.items() if how != "null_ok"]
    return F.xxhash64(F.lit(r), F.to_json(F.struct(*parts)) if parts else F.lit(""))


def _masked(df: DataFrame, rule: Rule, fields: list[str]) -> list[Column]:
    """The rule's own fields; others are null."""
    return [(F.col(n) if n in rule.spec else F.lit(None).cast(df.schema[n].dataType)).alias(n) for n in fields if n in df.columns]


def _asking(jobs: list[tuple[Rule, DataFrame]], fields: list[str]) -> DataFrame:
    """l_id, l_us, l_night, r, p (profile) and the fields of each light under each rule; equal lights are read once for all their rules."""
    shared = {}
    for r, (rule, lights) in enumerate(jobs):
        shared.setdefault(id(lights), (lights, []))[1].append((r, rule))
    parts = []
    for lights, mine in shared.values():
        asks = F.array(*(F.struct(F.lit(r).alias("r"), _profile(rule, r).alias("p"), *_masked(lights, rule, fields)) for r, rule in mine))
        parts.append(lights.select(F.col("frame_id").alias("l_id"), _micros(F.col("date_obs_utc")).alias("l_us"), F.unix_date(F.col("session_night").cast("date")).alias("l_night"), F.explode(asks).alias("_a")).select("l_id", "l_us", "l_night", "_a.*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _offering(frames: DataFrame, rules: tuple[Rule, ...], fields: list[str]) -> DataFrame:
    """id, us, m, night, r, q (profile) and the fields of each candidate under each rule."""
    kinds = [(F.col("image_type") == rule.target) | ((F.col("image_type") == "master") & (F.col("master_of") == rule.target)) for rule in rules]
    offers = F.array_compact(F.array(*(F.when(kind, F.struct(F.lit(r).alias("r"), _profile(rule, r).alias("q"), *_masked(frames, rule, fields))) for r, (rule, kind) in enumerate(zip(rules, kinds)))))
    own = frames.where(reduce(Column.__or__, kinds)).select(F.col("frame_id").alias("id"), _micros(F.col("date_obs_utc")).alias("us"), (F.col("image_type") == "master").alias("m"), F.unix_date(F.col("session_night").cast("date")).alias("night"), F.explode(offers).alias("_o"))
    return own.select("id", "us", "m", "night", "_o.*")


def _fitting(asking: DataFrame, offering: DataFrame, rules: tuple[Rule, ...], fields: list[str]) -> DataFrame:
    """p, q: the profiles of lights and of candidates that fit; c: p's number in its block k; bits: what p says of a match; dated: q's candidates with
    a date; t0, t1, nb, width: the first and last moment of the block's candidates, the number and width of its buckets.

    Exact values are keys. A field with a tolerance is a key by cells of its width: a light asks for three cells, or, without a value, for the key that
    all candidates offer."""
    own, every = Window.partitionBy("k"), F.array(F.lit(None).cast("long"))
    ls = asking.groupBy("r", "p", *fields).agg(F.count(F.lit(1)).alias("n")).withColumn("k", _by_rule([_block(x, r) for r, x in enumerate(rules)]))
    ls = ls.select("*", _by_rule([_bits(x) for x in rules]).alias("bits"), (F.row_number().over(own.orderBy("p")) - 1).alias("c"), F.sum("n").over(own).alias("lights"))
    cs = offering.groupBy("r", "q", *fields).agg(F.count("us").alias("dated"), F.count_if(F.col("us").isNull()).alias("undated"), F.min("us").alias("t0"), F.max("us").alias("t1"))
    for i in range(max(len(_tolerant(x)) for x in rules)):
        mine = [(_tolerant(x)[i : i + 1] or [None])[0] for x in rules]
        asked = [x and F.when(F.col(x[0]).isNotNull(), F.sequence(_cell(F.col(x[0]), x[1]) - 1, _cell(F.col(x[0]), x[1]) + 1)) for x in mine]
        offered = [x and F.array_distinct(F.array(_cell(F.col(x[0]), x[1]), F.lit(None).cast("long"))) for x in mine]
        ls, cs = ls.withColumn(f"_k{i}", F.explode(F.coalesce(_by_rule(asked), every))), cs.withColumn(f"_k{i}", F.explode(F.coalesce(_by_rule(offered), every)))
    cells = [x for x in ls.columns if x.startswith("_k")]
    exact = lambda n: _by_rule([F.col(n) if x.spec.get(n) == "exact" else None for x in rules]).alias(f"_e{n}")
    equal = [n for n in fields if any(x.spec.get(n) == "exact" for x in rules)]
    ls = ls.select("r", "p", "k", "c", "bits", "lights", *(F.col(n).alias(f"l_{n}") for n in fields), *cells, *(exact(n) for n in equal))
    cs = cs.select(F.col("r").alias("_r"), "q", "dated", "undated", "t0", "t1", *fields, *cells, *(exact(n) for n in equal))
    keys = [ls["r"] == cs["_r"], *(ls[x].eqNullSafe(cs[x]) for x in [*cells, *(f"_e{n}" for n in equal)])]
    fit = ls.join(cs, [*keys, _by_rule([_rest(x) for x in rules])])
    nb = F.greatest(F.lit(1), F.ceil((F.sum(F.col("dated") + F.col("undated")).over(own) + F.col("lights")) / BUCKET))
    fit = fit.select("p", "q", "k", "c", "bits", "dated", F.min("t0").over(own).alias("t0"), F.max("t1").over(own).alias("t1"), nb.alias("nb"))
    return fit.withColumn("width", F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0") + 1) / F.col("nb"))))


def _bucket(us: Column) -> Column:
    """The bucket of a moment by its block's t0, width and nb; moments before and after all candidates have one bucket each."""
    inside = F.least(F.greatest(F.floor((us - F.col("t0")) / F.col("width")), F.lit(-1)), F.col("nb"))
    return F.when(us.isNull(), F.lit(_UNDATED)).otherwise(F.coalesce(inside, F.lit(0))).cast("long")


def _sides(frames: DataFrame, jobs: list[tuple[Rule, DataFrame]], every: bool = False) -> tuple[DataFrame, DataFrame]:
    """All rules' asks (k, c, b, role, x, base, r, l_id, l_us, l_night, bits) and entries (k, b, us, id, m, night, ps).

    k is the block's key, or that of a block's night, c a light's profile and ps those that a candidate fits. A light asks for its nearest candidates
    (role near, for a session rule also night), and for the counts below both ends of the age limit (low, high: x is the moment) where candidates of its
    block lie on both sides of them; base is what the other ends add to the light's count. every: with lights whose profile no
    candidate fits, which else ask nothing."""
    rules = tuple(rule for rule, _ in jobs)
    fields = list(dict.fromkeys(n for x in rules for n in x.spec))
    asking, offering = _asking(jobs, fields), _offering(frames, rules, fields)
    fit = _fitting(asking, offering, rules, fields)
    of_night = lambda night: F.xxhash64(F.col("k"), F.lit("night"), night)
    session = F.col("r").isin([r for r, x in enumerate(rules) if x.prefer_same_session])
    of_q = fit.groupBy("q", "k", "t0", "nb", "width").agg(F.collect_list("c").alias("ps"))
    entries = offering.select("id", "us", "m", "night", "r", "q").join(of_q, "q").withColumn("b", _bucket(F.col("us")))
    keys = F.when(session & F.col("night").isNotNull(), F.array("k", of_night(F.col("night")))).otherwise(F.array("k"))
    entries = entries.select(F.explode(keys).alias("k"), "b", "us", "id", "m", "night", "ps")
    of_p = fit.groupBy("p", "k", "c", "bits", "t0", "t1", "nb", "width").agg(F.sum("dated").alias("dated"))
    at = F.col("l_us")
    reach = _by_rule([None if x.max_age_days is None else F.lit((x.max_age_days + 1) * _DAY) for x in rules])  # whole days count, so the limit ends a day later
    low, high = at - reach + 1, at + reach
    within = lambda x: (x > F.col("t0")) & (x <= F.col("t1"))
    beyond = lambda x: F.when(x > F.col("t1"), F.col("dated")).otherwise(F.lit(0))
    role = lambda name, key, x, when: F.when(when, F.struct(F.lit(name).alias("role"), key.alias("k"), x.cast("long").alias("x"), _bucket(x).alias("b")))
    k, fits = F.coalesce("k", "p"), F.col("k").isNotNull()
    roles = [role("near", k, at, F.lit(True)), role("night", of_night(F.col("l_night")), at, fits & session & F.col("l_night").isNotNull()), role("low", k, low, within(low)), role("high", k, high, within(high))]
    asks = asking.select("r", "p", "l_id", "l_us", "l_night").join(of_p, "p", "left" if every else "inner")
    asks = asks.select("r", F.coalesce("c", F.lit(-1)).alias("c"), "l_id", "l_us", "l_night", "bits", (beyond(high) - beyond(low)).alias("base"), F.explode(F.array_compact(F.array(*roles))).alias("_a"))
    return asks.select(F.col("_a.k").alias("k"), "c", F.col("_a.b").alias("b"), F.col("_a.role").alias("role"), F.col("_a.x").alias("x"), "base", "r", "l_id", "l_us", "l_night", "bits"), entries


# -- arrays of a partition: rows of many profiles and buckets at once

_CARRIED = "k long, c int, b long, what string, us long, id long, m boolean, night int, n long, every long, undated long"


def _place(k: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for a key and a bucket."""
    h = k.astype(np.uint64) ^ (b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _key(k: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The key of a profile in a block, or in a block's night."""
    return _place(k, c.astype(np.int64)).view(np.int64)


def _bound(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, after: bool) -> np.ndarray:
    """For each span lo..hi of sorted values, where x belongs: before its equals, or after them."""
    lo, hi = lo.copy(), hi.copy()
    while (live := lo < hi).any():
        mid = np.minimum((lo + hi) // 2, len(values) - 1)
        up = live & ((values[mid] <= x) if after else (values[mid] < x))
        lo, hi = np.where(up, mid + 1, lo), np.where(live & ~up, mid, hi)
    return lo


def _spans(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all spans, one after the other, and for each the number of its span."""
    size = np.maximum(stops - starts, 0)
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size), of


def _nth(*keys: np.ndarray) -> np.ndarray:
    """For sorted rows, how many rows before have the same keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))


class _Pool:
    """Dated entries sorted by place, kind and moment; of equal moments the `limit` smallest ids. They come sorted by moment and id."""

    def __init__(self, place, m, us, id_, night, limit):
        group = place ^ (m.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(group, kind="stable")
        order = order[_nth(group[order], us[order]) < limit]
        self.group, self.us, self.id, self.m, self.night, self.limit = group[order], us[order], id_[order], m[order], night[order], limit

    def near(self, place: np.ndarray, m: bool, x: np.ndarray, sides: tuple[bool, bool] = (True, True)) -> tuple[np.ndarray, np.ndarray]:
        """For each place and moment the nearest entries of a kind before and after it, with ties in whole seconds: entry numbers, and whose they are."""
        q = place ^ (np.uint64(m) * np.uint64(0xD6E8FEB86659FD93))
        start, stop = np.searchsorted(self.group, q), np.searchsorted(self.group, q, "right")
        at = _bound(self.us, start, stop, x, False)
        last = max(len(self.us) - 1, 0)
        a, e = at, at
        if sides[0]:
            a = np.maximum(start, at - self.limit)
            a = np.where(a > start, _bound(self.us, start, a, self.us[np.minimum(a, last)] - _SECOND, False), a) if len(self.us) else a
        if sides[1]:
            e = np.minimum(stop, at + self.limit)
            e = np.where(e < stop, _bound(self.us, e, stop, self.us[np.clip(e - 1, 0, last)] + _SECOND, True), e) if len(self.us) else e
        return _spans(a, e)


def _numpy(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as arrays; nulls of numbers are 0."""
    return [pc.fill_null(table.column(n), False if pa.types.is_boolean(table.schema.field(n).type) else 0).to_numpy() for n in names]


def _flags(column: pa.ChunkedArray, *names: str) -> list[np.ndarray]:
    """For each name, which rows have it."""
    return [pc.fill_null(pc.equal(column, n), False).to_numpy() for n in names]


_NO_NIGHT = 1 - (1 << 31)


def _entry_columns(t: pa.Table) -> tuple:
    k, b, us, id_, m = _numpy(t, "k", "b", "us", "id", "m")
    return k, b, us, id_, m, pc.fill_null(t.column("night"), _NO_NIGHT).to_numpy()


def _offers(t: pa.Table) -> tuple:
    """The columns of entries, the numbers of the profiles that they fit, and where each entry's begin and how many it has."""
    size = pc.list_value_length(t.column("ps")).to_numpy().astype(np.int64)
    return *_entry_columns(t), pc.list_flatten(t.column("ps")).to_numpy(), np.cumsum(size) - size, size


def _repeated(order: np.ndarray, codes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in an order, each as often as it fits a profile, and the profile's number."""
    i, of = _spans(starts[order], starts[order] + size[order])
    return order[of], codes[i]


def _rows(schema: list[str], **columns) -> pa.Table:
    kinds = {"what": pa.string(), "m": pa.bool_(), "night": pa.int32(), "c": pa.int32()}
    n = len(next(iter(columns.values())))
    return pa.table({c: pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in schema})


_CARRIED_NAMES = [c.split()[0] for c in _CARRIED.split(", ")]


def _summary(limit: int):
    """Of each place and profile: its number of entries, the first and last few by time, the few with the smallest ids."""

    def work(t: pa.Table) -> pa.Table:
        k, b, us, id_, m, night, *fits = _offers(t)
        row, c = _repeated(np.lexsort((us, id_, m)), *fits)
        place = _place(_key(k[row], c), b[row])
        order = np.argsort(place, kind="stable")
        row, c, place = row[order], c[order], place[order]
        few = np.flatnonzero(_nth(place, m[row]) < limit)
        first = np.flatnonzero(_nth(place) == 0)
        n = np.diff(np.append(first, len(place)))
        one, ids = row[first], row[few]
        some = np.lexsort((id_, us))
        e, ec = _repeated(some[b[some] != _UNDATED], *fits)
        pool = _Pool(_place(_key(k[e], ec), b[e]), m[e], us[e], id_[e], night[e], limit)
        # the ends of each place: nearest after the beginning of time and before its end
        dated = first[b[one] != _UNDATED]
        edge = []
        for kind in (False, True):
            for x, sides in ((-(1 << 60), (False, True)), (1 << 60, (True, False))):
                i, of = pool.near(place[dated], kind, np.full(len(dated), x), sides)
                edge.append((dated[of], i))
        i, once = np.unique(np.concatenate([j for _, j in edge]), return_index=True)  # a small place has the same entries at both ends
        whose = np.concatenate([w for w, _ in edge])[once]
        return pa.concat_tables([
            _rows(_CARRIED_NAMES, k=k[one], c=c[first], b=b[one], what=["count"] * len(one), n=n),
            _rows(_CARRIED_NAMES, k=k[row[whose]], c=c[whose], b=b[row[whose]], what=["edge"] * len(i), us=pool.us[i], id=pool.id[i], m=pool.m[i], night=pool.night[i]),
            _rows(_CARRIED_NAMES, k=k[ids], c=c[few], b=b[ids], what=["id"] * len(ids), us=us[ids], id=id_[ids], m=m[ids], night=night[ids]),
        ])

    return work


def _carry(limit: int):
    """For each place that is asked for: how many dated entries of its key are in earlier buckets, how many there are, how many without a date; and for
    lights the nearest few outside the place and the undated ones with the smallest ids, or for undated lights the smallest ids of all."""

    def work(t: pa.Table) -> pa.Table:
        is_near, is_end, is_count, is_edge, is_id = _flags(t.column("what"), "near", "end", "count", "edge", "id")
        block, b, us, id_, m, night = _entry_columns(t)
        number, n = _numpy(t, "c", "n")
        k = _key(block, number)
        asked = np.flatnonzero(is_near | is_end)
        c = np.flatnonzero(is_count)
        c = c[np.lexsort((b[c], k[c]))]
        total, undated = np.concatenate([[0], np.cumsum(n[c])]), np.concatenate([[0], np.cumsum(np.where(b[c] == _UNDATED, n[c], 0))])
        lo, hi = np.searchsorted(k[c], k[asked]), np.searchsorted(k[c], k[asked], "right")
        at = _bound(b[c], lo, hi, b[asked], False)
        without = undated[hi] - undated[lo]
        before = np.where(b[asked] == _UNDATED, 0, total[at] - total[lo] - without)
        out = [_rows(_CARRIED_NAMES, k=block[asked], c=number[asked], b=b[asked], what=["count"] * len(asked), n=before, every=total[hi] - total[lo], undated=without)]

        def take(of: np.ndarray, i: np.ndarray, name: str) -> None:
            out.append(_rows(_CARRIED_NAMES, k=block[of], c=number[of], b=b[of], what=[name] * len(i), us=us[i], id=id_[i], m=m[i], night=night[i]))

        near, e = np.flatnonzero(is_near), np.flatnonzero(is_edge)
        for kind in (False, True):
            dated = near[b[near] != _UNDATED]
            own = e[m[e] == kind]
            own = own[np.lexsort((id_[own], us[own], b[own], k[own]))]  # buckets are in the order of time
            lo, hi = np.searchsorted(k[own], k[dated]), np.searchsorted(k[own], k[dated], "right")
            a, z = _bound(b[own], lo, hi, b[dated], False), _bound(b[own], lo, hi, b[dated], True)
            last = max(len(own) - 1, 0)
            if len(own):
                left, right = np.maximum(lo, a - limit), np.minimum(hi, z + limit)
                left = np.where(left > lo, _bound(us[own], lo, left, us[own][np.minimum(left, last)] - _SECOND, False), left)
                right = np.where(right < hi, _bound(us[own], right, hi, us[own][np.clip(right - 1, 0, last)] + _SECOND, True), right)
                for s, f in ((left, a), (z, right)):
                    i, of = _spans(s, f)
                    take(dated[of], own[i], "dated")
            ids = np.flatnonzero(is_id & (m == kind))
            for some, mine in ((dated, ids[b[ids] == _UNDATED]), (near[b[near] == _UNDATED], ids)):
                mine = mine[np.lexsort((id_[mine], k[mine]))]
                mine = mine[_nth(k[mine]) < limit]
                i, of = _spans(np.searchsorted(k[mine], k[some]), np.searchsorted(k[mine], k[some], "right"))
                take(some[of], mine[i], "free")
                if some is not dated:  # of all entries: those with a date keep it
                    out[-1] = out[-1].set_column(_CARRIED_NAMES.index("what"), "what", pa.array(np.where(b[mine[i]] == _UNDATED, "free", "with date"), pa.string()))
        return pa.concat_tables(out)

    return work


_BEST = "r int, l_id long, l_us long, l_night int, bits string, id long, m boolean, us long, night int, cnt long"


def _merge(rules: tuple[Rule, ...], limit: int):
    """The best few candidates of each ask for the nearest, and the counts of each ask."""
    reach = np.array([-1 if x.max_age_days is None else (x.max_age_days + 1) * _DAY for x in rules], np.int64)
    masters, session = (np.array([getattr(x, f) for x in rules], bool) for f in ("prefer_masters", "prefer_same_session"))

    def work(asks: pa.Table, entries: pa.Table) -> pa.Table:
        low, high, for_near, for_night = _flags(asks.column("role"), "low", "high", "near", "night")
        is_ask, is_count, is_dated, is_free, with_date = _flags(asks.column("what"), "ask", "count", "dated", "free", "with date")
        k, b, us, id_, m, night = _entry_columns(asks)
        number, x, base, r, before, every, undated = _numpy(asks, "c", "x", "base", "r", "n", "every", "undated")
        l_us, l_night, no_date = _numpy(asks, "l_us")[0], pc.fill_null(asks.column("l_night"), _NO_NIGHT - 1).to_numpy(), pc.is_null(asks.column("l_us")).to_numpy()
        place = _place(_key(k, number), b)
        ek, eb, eus, eid, em, enight, *fits = _offers(entries)
        # counts
        ask, counts = np.flatnonzero(is_ask), np.flatnonzero(is_count)
        counts = counts[np.argsort(place[counts], kind="stable")]
        mine = counts[np.searchsorted(place[counts], place[ask])] if len(counts) else np.zeros(0, np.int64)
        inside, ends = np.zeros(len(ask), np.int64), np.flatnonzero(low[ask] | high[ask])
        if len(ends):
            e = np.argsort(eus, kind="stable")
            e, c = _repeated(e[eb[e] != _UNDATED], *fits)
            eplace = _place(_key(ek[e], c), eb[e])
            order = np.argsort(eplace, kind="stable")
            moments, eplace, q = eus[e[order]], eplace[order], place[ask[ends]]
            start = np.searchsorted(eplace, q)
            inside[ends] = _bound(moments, start, np.searchsorted(eplace, q, "right"), x[ask[ends]], False) - start
        below = before[mine] + inside
        free = np.where((reach[r[ask]] < 0) | no_date[ask], every[mine], undated[mine])
        cnt = np.select([low[ask], high[ask], for_near[ask]], [-below, below, free + base[ask]], 0)
        # the nearest
        c, codes, starts, size = np.flatnonzero(is_dated), *fits
        every_us, every_id = np.concatenate([eus, us[c]]), np.concatenate([eid, id_[c]])
        o = np.lexsort((every_id, every_us))
        o = o[np.concatenate([eb != _UNDATED, np.ones(len(c), bool)])[o]]
        e, of = _repeated(o, np.concatenate([codes, number[c]]), np.concatenate([starts, len(codes) + np.arange(len(c))]), np.concatenate([size, np.ones(len(c), np.int64)]))
        at = _place(_key(np.concatenate([ek, k[c]])[e], of), np.concatenate([eb, b[c]])[e])
        pool = _Pool(at, np.concatenate([em, m[c]])[e], every_us[e], every_id[e], np.concatenate([enight, night[c]])[e], limit)
        near = ask[for_near[ask] | for_night[ask]]
        lights = near[~no_date[near]]
        found = []
        for kind in (False, True):
            i, of = pool.near(place[lights], kind, l_us[lights])
            found.append((lights[of], pool.us[i], pool.id[i], pool.m[i], pool.night[i], np.ones(len(i), bool)))
        u = np.flatnonzero(is_free | with_date)
        u = u[np.argsort(place[u], kind="stable")]
        i, of = _spans(np.searchsorted(place[u], place[near]), np.searchsorted(place[u], place[near], "right"))
        found.append((near[of], us[u[i]], id_[u[i]], m[u[i]], night[u[i]], with_date[u[i]]))
        light, f_us, f_id, f_m, f_night, f_dated = (np.concatenate(v) for v in zip(*found))
        both = f_dated & ~no_date[light]
        gap = np.where(both, np.abs(f_us - l_us[light]), 0)
        age = reach[r[light]]
        # of a session rule the light's own night is the other ask's
        twice = session[r[light]] & for_near[light] & (f_night == l_night[light])
        keep = np.flatnonzero(((age < 0) | ~both | (gap < age)) & ~twice)
        first = np.where(masters[r[light[keep]]], ~f_m[keep], False)
        # undated candidates go last and first: which of the two the caller wants is told by the final order
        seconds = np.where(both[keep], gap[keep] // _SECOND, -1)
        order = np.lexsort((f_id[keep], seconds, seconds < 0, first, light[keep]))
        keep = keep[order]
        rank = _nth(light[keep], first[order], seconds[order] < 0)
        keep = keep[rank < limit]
        kept = light[keep]
        # a count goes with the ask's first candidate; alone where there is none
        counted, found = np.zeros(len(k), np.int64), np.zeros(len(k), bool)
        counted[ask], found[kept] = cnt, True
        alone = ask[~found[ask] & (for_near[ask] | (cnt != 0))]
        plain = asks.select(["r", "l_id", "l_us", "l_night", "bits"]).take(pa.array(np.concatenate([alone, kept])))
        pad = lambda values, kind, gone=None: pa.concat_arrays([pa.nulls(len(alone), kind), pa.array(values, kind, mask=gone)])
        columns = {
            "id": pad(f_id[keep], pa.int64()), "m": pad(f_m[keep], pa.bool_()), "us": pad(f_us[keep], pa.int64(), ~f_dated[keep]), "night": pad(f_night[keep], pa.int32(), f_night[keep] == _NO_NIGHT),
            "cnt": pa.array(np.concatenate([counted[alone], np.where(_nth(kept) == 0, counted[kept], 0)]), pa.int64()),
        }
        for name, values in columns.items():
            plain = plain.append_column(name, values)
        return plain

    return work


def _tasks(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _groups(frames: DataFrame) -> DataFrame:
    """One row: the number of groups."""
    return frames.agg(F.greatest(F.lit(_tasks(frames)), F.ceil(F.count(F.lit(1)) / GROUP)).alias("groups"))


def _merged(frames: DataFrame, jobs: list[tuple[Rule, DataFrame]], limit: int, every: bool = False) -> DataFrame:
    """r (the rule's place in jobs), light, candidate and cnt of all rules' lights, through one merge; rows without a candidate carry counts only. every: with lights
    that no candidate fits."""
    rules = tuple(rule for rule, _ in jobs)
    asks, entries = _sides(frames, jobs, every)
    # tasks as many as explicit exchanges give, which adaptive execution doesn't make fewer; groups as many as frames ask for, so that one stays small
    tasks = _tasks(frames)
    groups = F.broadcast(_groups(frames))
    asks, entries = asks.crossJoin(groups), entries.crossJoin(groups)
    part = lambda *keys: F.pmod(F.xxhash64(*keys), F.col("groups")).alias("part")
    dealt = lambda df, *keys: df.select(part(*keys), *(c for c in df.columns if c != "groups")).repartition(tasks, "part")
    carried_columns = [*_CARRIED_NAMES, "groups"]
    entries = dealt(entries.select("groups", "k", "b", "us", "id", "m", "night", "ps"), "k", "b")
    summary = entries.groupBy("part").applyInArrow(_summary(limit), _CARRIED).crossJoin(groups)
    asked = asks.groupBy("k", "c", "b", "groups").agg(F.max(F.col("role").isin("near", "night")).alias("_near")).select("groups", "k", "c", "b", F.when(F.col("_near"), "near").otherwise("end").alias("what"))
    carried = dealt(summary.unionByName(asked, allowMissingColumns=True).select(carried_columns), "k").groupBy("part").applyInArrow(_carry(limit), _CARRIED).crossJoin(groups)
    left = dealt(asks.withColumn("what", F.lit("ask")).unionByName(carried, allowMissingColumns=True), "k", "b")
    return left.groupBy("part").cogroup(entries.groupBy("part")).applyInArrow(_merge(rules, limit), _BEST)


def _bits(rule: Rule) -> Column:
    """What a light's fields say of the match, in the order of their names."""
    bits = []
    for name, how in sorted(rule.spec.items()):
        value = F.col(name)
        text = value if name == "readout_mode" else _number(value)
        shown = F.concat(F.lit(f"{name} "), text) if isinstance(how, str) else F.concat(F.lit(f"{name} "), text, F.lit(f"±{how:g}"))
        bits.append(F.when(value.isNotNull(), shown))
    return F.nullif(F.concat_ws(", ", *bits), F.lit("")) if bits else F.lit(None).cast("string")


def reason(rule: Rule) -> Column:
    """Why a candidate (m, us, night) matched the light (bits, l_us, l_night)."""
    head = F.when(F.col("m"), F.lit(f"master {rule.target}")).otherwise(F.lit(rule.target))
    days = F.floor(F.abs(F.col("us") - F.col("l_us")) / _DAY)
    when = F.when(days.isNotNull(), F.concat(days.cast("string"), F.lit(" day(s) from light")))
    if rule.prefer_same_session:
        when = F.when(F.col("night") == F.col("l_night"), F.concat(F.lit("same night ("), F.date_from_unix_date("night").cast("string"), F.lit(")"))).otherwise(when)
    return F.concat_ws(" · ", head, "bits", when)


MATCHED = ("light_id", "rule", "rank", "frame_id", "image_type", "score", "reason", "total")


def _ranked(merged: DataFrame, rules: list[Rule], limit: int, undated_first: bool) -> DataFrame:
    """The columns of `MATCHED` and r, of all rules; ranks and totals take one exchange by light.

    Masters come first, then the same session, then the nearest in time by whole seconds, then the id; undated candidates are last unless asked for."""
    per_light = Window.partitionBy("r", "l_id")
    of = lambda f: reduce(lambda c, x: c.when(F.col("r") == x[0], x[1]), enumerate(f), F.when(F.lit(False), None))
    # the rules' orders differ in their first two keys only
    first = of([~F.col("m") if r.prefer_masters else F.lit(False) for r in rules])
    second = of([~F.coalesce(F.col("night") == F.col("l_night"), F.lit(False)) if r.prefer_same_session else F.lit(False) for r in rules])
    seconds = F.floor(F.abs(F.col("us") - F.col("l_us")) / _SECOND)
    order = [F.col("id").isNull(), first, second, seconds.asc_nulls_first() if undated_first else seconds.asc_nulls_last(), F.col("id").asc()]
    own = per_light.orderBy(*order)  # one sort for both
    rows = merged.repartition(_tasks(merged), "r", "l_id").withColumns({"total": F.sum("cnt").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "rank": F.row_number().over(own) - 1}).where(F.col("id").isNotNull() & (F.col("rank") < limit))
    image_type = F.when(F.col("m"), F.lit("master")).otherwise(of([F.lit(r.target) for r in rules]))
    return rows.select("r", F.col("l_id").alias("light_id"), of([F.lit(r.name) for r in rules]).alias("rule"), "rank", F.col("id").alias("frame_id"), image_type.alias("image_type"), (1 - F.col("rank") / (limit + 1)).alias("score"), of([reason(r) for r in rules]).alias("reason"), "total")


def match(frames: DataFrame, rule: Rule, limit: int = 10, lights: DataFrame | None = None, undated_first: bool = False) -> DataFrame:
    """light_id, rule, rank (from 0), frame_id, image_type, score, reason, total: the best `limit` candidates of each light."""
    limit = min(100, max(1, limit))
    lights = frames.where("image_type = 'light'") if lights is None else lights
    return _ranked(_merged(frames, [(rule, lights)], limit), [rule], limit, undated_first).drop("r")


def _of_sets(frames: DataFrame, picks: DataFrame) -> DataFrame:
    """The frames of each set and filter asked for (_set, _filter): those of the filter or without one, or all where the light has none."""
    asked = picks.select(F.col("flat_set_id").alias("_set"), F.col("l_filter").alias("_filter")).distinct()
    own = frames.select("flat_set_id", "frame_id", "image_type", "filter_id", "date_obs_utc")
    return own.join(asked, F.col("flat_set_id") == F.col("_set")).where("_filter is null or filter_id is null or filter_id = _filter")


def _same_set() -> list[Column]:
    return [F.col("flat_set_id") == F.col("_set"), F.col("l_filter").eqNullSafe(F.col("_filter"))]


def match_set(frames: DataFrame, rule: Rule, picks: DataFrame, limit: int = 10) -> DataFrame:
    """Like `match`, for lights with a flat set (`flat_sets`): the set's frames for the light's filter, masters first, then from the oldest on.

    They are ranked once for each set and filter."""
    limit = min(100, max(1, limit))
    own = _of_sets(frames, picks)
    totals = own.groupBy("_set", "_filter").agg(F.count("*").alias("total"))
    order = Window.partitionBy("_set", "_filter").orderBy((F.col("image_type") == "master").desc(), F.col("date_obs_utc").asc_nulls_first(), "frame_id")
    best = own.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < limit).join(totals.select(F.col("_set").alias("_s"), F.col("_filter").alias("_f"), "total"), [F.col("_set") == F.col("_s"), F.col("_filter").eqNullSafe(F.col("_f"))])
    rows = picks.select("light_id", "flat_set_id", "how", "label", "l_filter", "l_night").join(best.select("_set", "_filter", "rank", "frame_id", "image_type", "total"), _same_set())
    night, label = F.col("l_night").cast("string"), F.concat(F.lit("flat set '"), F.coalesce("label", F.lit("")), F.lit("'"))
    why = (
        F.when(F.col("how") == "pin", F.concat(F.lit("pinned "), label, F.lit(" for "), night)).when(F.col("how") == "window", F.concat(label, F.lit(" (window covers "), night, F.lit(")")))
        .when(F.col("how") == "on or before", F.concat(label, F.lit(" (newest on/before "), night, F.lit(", fixed rig)"))).when(F.col("how") == "active", F.concat(F.lit("active "), label, F.lit(" (fixed rig)")))
        .otherwise(F.concat(label, F.lit(" from the same session ("), night, F.lit(")")))
    )
    head = F.when(F.col("image_type") == "master", F.lit("master flat · ")).otherwise(F.lit("flat · "))
    return rows.select("light_id", F.lit(f"{rule.name} (flat set)").alias("rule"), "rank", "frame_id", "image_type", (1 - F.col("rank") / (limit + 1)).alias("score"), F.concat(head, why).alias("reason"), "total")


def match_all(frames: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, limit: int = 10, sets: DataFrame | None = None) -> DataFrame:
    """The enabled rules in their order (priority, then their place), with a column rule_order. sets: what `flat_sets` gives; the set of a light
    overrides the rules for flats."""
    ordered = sorted((r for r in rules if r.enabled), key=lambda r: r.priority)
    limit, lights = min(100, max(1, limit)), frames.where("image_type = 'light'")
    free = lights if sets is None else lights.join(sets.select(F.col("light_id").alias("frame_id")), "frame_id", "left_anti")
    jobs = [(k, rule) for k, rule in enumerate(ordered) if not rule.invalid]
    if not jobs:
        return _ranked(_merged(frames, [(Rule("", ""), lights.where("false"))], limit), [Rule("", "")], limit, False).withColumnRenamed("r", "rule_order")
    merged = _merged(frames, [(rule, free if rule.target == "flat" else lights) for _, rule in jobs], limit)
    out = _ranked(merged, [rule for _, rule in jobs], limit, False)
    place = F.element_at(F.array(*(F.lit(k) for k, _ in jobs)), F.col("r") + 1)
    out = out.withColumn("rule_order", place).drop("r")
    for k, rule in jobs:
        if rule.target == "flat" and sets is not None:
            out = out.unionByName(match_set(frames, rule, sets, limit).withColumn("rule_order", F.lit(k)))
    return out


def with_paths(matches: DataFrame, v_frames: DataFrame) -> DataFrame:
    """Matches with filename, abs_path, session_night and date_obs_utc of their frames."""
    return matches.join(v_frames.select("frame_id", "filename", "abs_path", "session_night", "date_obs_utc"), "frame_id")


def warnings(frames: DataFrame, rule: Rule, sets: DataFrame | None = None) -> DataFrame:
    """light_id, total, warning of every light: null where there are candidates enough. sets: as for `match_all`, for a rule of flats."""
    lights = frames.where("image_type = 'light'")
    if rule.invalid:
        return lights.select(F.col("frame_id").alias("light_id"), F.lit(0).cast("long").alias("total"), F.lit("rule has invalid match_json").alias("warning"))
    free = lights if sets is None else lights.join(sets.select(F.col("light_id").alias("frame_id")), "frame_id", "left_anti")
    total = F.col("total")
    text = F.when(total == 0, F.lit(f"no matching {rule.target} frames found")).when(total < rule.min_frames, F.concat(F.lit("only "), total.cast("string"), F.lit(f" {rule.target} frames (rule suggests at least {rule.min_frames})")))
    counted = _merged(frames, [(rule, free)], 1, True).groupBy("l_id").agg(F.sum("cnt").alias("total"))
    out = counted.select(F.col("l_id").alias("light_id"), "total", text.alias("warning"))
    if sets is None:
        return out
    own = _of_sets(frames, sets).groupBy("_set", "_filter").agg(F.count("*").alias("total"))
    rows = sets.join(own, _same_set(), "left").select("light_id", F.coalesce("total", F.lit(0)).alias("total"))
    return out.unionByName(rows.withColumn("warning", F.when(total == 0, F.lit("flat set resolved, but it has no flats for this filter"))))


def flat_sets(lights: DataFrame, rigs: DataFrame, sets: DataFrame, pins: DataFrame) -> DataFrame:
    """light_id, flat_set_id, how, label, l_filter, l_night (the light's) of each light with a set: its pin, else for a rig with a site the newest valid window, the newest on or before the night, or the active set; for one without, the same night."""
    l = lights.select(F.col("frame_id").alias("light_id"), "rig_id", "session_night", F.col("filter_id").alias("l_filter")).join(rigs.select("rig_id", "site_id", "active_flat_set_id"), "rig_id")
    fits = F.col("filter_id").isNull() | (F.col("filter_id") == F.col("l_filter"))
    pinned = l.join(pins, ["rig_id", "session_night"]).join(sets.drop("rig_id"), "flat_set_id").where(fits).withColumn("_step", F.lit(1)).withColumn("how", F.lit("pin"))
    own = l.join(sets, "rig_id").where(fits)
    fixed, night = F.col("site_id").isNotNull(), F.col("session_night")
    window = night.between(F.col("valid_from"), F.col("valid_to")) | (F.col("valid_to").isNull() & (night >= F.col("valid_from")))
    step = (
        F.when(fixed & window, 2)
        .when(fixed & night.isNotNull() & (F.col("captured_night").isNull() | (F.col("captured_night") <= night)), 3)
        .when(~fixed & (F.col("captured_night") == night), 5)
    )
    how = F.element_at(F.create_map(F.lit(2), F.lit("window"), F.lit(3), F.lit("on or before"), F.lit(5), F.lit("same night")), F.col("_step"))
    ranked = own.withColumn("_step", step).where("_step is not null").withColumn("how", how)
    active = l.where(fixed).join(sets.drop("rig_id"), F.col("active_flat_set_id") == F.col("flat_set_id")).where(fits).withColumn("_step", F.lit(4)).withColumn("how", F.lit("active"))
    columns = ["light_id", "flat_set_id", "filter_id", "captured_night", "_step", "how", "label", "l_filter", F.col("session_night").alias("l_night")]
    every = pinned.select(columns).unionByName(ranked.select(columns)).unionByName(active.select(columns))
    order = Window.partitionBy("light_id").orderBy("_step", F.col("filter_id").isNotNull().desc(), F.col("captured_night").desc_nulls_last(), F.desc("flat_set_id"))
    return every.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("light_id", "flat_set_id", "how", "label", "l_filter", "l_night")
