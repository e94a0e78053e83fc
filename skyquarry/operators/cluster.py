"""Runs, clusters and places of captures."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquarry.functions.headers import coordinate, haversine_m

from .views import first_card


def runs(frames: DataFrame, keys: tuple[str, ...] = ("rig_id", "filter_id"), minutes: int = 45) -> DataFrame:
    """Runs of frames of the same keys (missing ones are a key too) with gaps of at most `minutes`: n, first_utc, last_utc, night."""
    own = Window.partitionBy(*keys).orderBy("date_obs_utc", "frame_id")
    gap = F.timestamp_diff("SECOND", F.date_trunc("second", F.lag("date_obs_utc").over(own)), F.date_trunc("second", F.col("date_obs_utc")))
    marked = frames.where("date_obs_utc is not null").withColumn("_break", F.when(gap.isNull() | (gap > minutes * 60), 1).otherwise(0))
    numbered = marked.withColumn("run", F.sum("_break").over(own))
    return numbered.groupBy(*keys, "run").agg(F.count("*").alias("n"), F.min("date_obs_utc").alias("first_utc"), F.max("date_obs_utc").alias("last_utc"), F.min("session_night").alias("night"))


def focal_clusters(frames: DataFrame, rigs: DataFrame | None = None, ratio: float = 1.02) -> DataFrame:
    """Chains of focal lengths of each camera, each at most `ratio` times the one before, with a suggested range; chains
    that overlap the range of any rig of the camera, active or not, are left out."""
    counts = frames.where("camera_id is not null and focal_len_mm > 0").groupBy("camera_id", "focal_len_mm").agg(F.count("*").alias("n"))
    own = Window.partitionBy("camera_id").orderBy("focal_len_mm")  # distinct focal lengths only
    before = F.lag("focal_len_mm").over(own)
    chained = counts.withColumn("_b", F.when(before.isNull() | (F.col("focal_len_mm") > before * ratio), 1).otherwise(0)).withColumn("chain", F.sum("_b").over(own))
    out = chained.groupBy("camera_id", "chain").agg(F.min("focal_len_mm").alias("lo"), F.max("focal_len_mm").alias("hi"), F.sum("n").alias("n"))
    slack = lambda c: F.greatest(F.col(c) * 0.015, F.lit(1.0))
    out = out.withColumns({"range_min": F.floor(F.col("lo") - slack("lo")), "range_max": F.ceil(F.col("hi") + slack("hi"))})
    if rigs is None:
        return out
    taken = rigs.select(F.col("camera_id").alias("_cam"), "focal_min", "focal_max")
    return out.join(taken, (F.col("camera_id") == F.col("_cam")) & (F.col("focal_min") <= F.col("hi")) & (F.col("focal_max") >= F.col("lo")), "left_anti")


_EARTH_M = 6371000


def _metres(lat: np.ndarray, lon: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    at, to = np.radians(lat), np.radians(y)
    a = np.sin((to - at) / 2) ** 2 + np.cos(at) * np.cos(to) * np.sin(np.radians(x - lon) / 2) ** 2
    return 2 * _EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(a)))


class _Fold:
    """The clusters of places that are taken one after another.

    A stretch of places is decided at once: each against the clusters as they are after the places before it, which follow from the decisions
    so far, and again until no decision changes. A place whose predecessors are right is right, so what comes out is what single steps give."""

    def __init__(self, metres: float):
        self.metres, self.size, self.stretch = metres, 0, 32
        self.lat, self.lon, self.n = np.zeros(4), np.zeros(4), np.zeros(4, np.int64)

    def _start(self, y: float, x: float) -> None:
        if self.size == len(self.n):
            self.lat, self.lon, self.n = (np.concatenate([v, np.zeros_like(v)]) for v in (self.lat, self.lon, self.n))
        self.lat[self.size], self.lon[self.size], self.n[self.size] = y, x, 1
        self.size += 1

    def _paths(self, y: np.ndarray, x: np.ndarray, pick: np.ndarray) -> dict:
        """Of each cluster that is picked: which places join it, and its centroids before the first and after each of them."""
        paths = {}
        for k in np.unique(pick[pick >= 0]).tolist():
            mine = pick == k
            la, lo, n = float(self.lat[k]), float(self.lon[k]), int(self.n[k])
            lats, lons = [la], [lo]
            for v, w in zip(y[mine].tolist(), x[mine].tolist()):
                la, lo, n = (la * n + v) / (n + 1), (lo * n + w) / (n + 1), n + 1
                lats.append(la)
                lons.append(lo)
            paths[k] = mine, np.array(lats), np.array(lons)
        return paths

    def _decide(self, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """The cluster of each of the first places, as far as they are settled, -1 where a place starts one (it is the last then)."""
        still = _metres(self.lat[: self.size], self.lon[: self.size], y[:, None], x[:, None]) <= self.metres
        first = lambda near: np.where(near.any(axis=1), near.argmax(axis=1), -1)
        pick, right = first(still), 0
        for _ in range(6):
            stop = np.flatnonzero(pick < 0)
            if len(stop):
                pick, still, y, x = pick[: stop[0] + 1], still[: stop[0] + 1], y[: stop[0] + 1], x[: stop[0] + 1]
            paths, near = self._paths(y, x, pick), still.copy()  # clusters that nothing joins stay where they are
            for k, (mine, lats, lons) in paths.items():
                before = np.cumsum(mine) - mine
                near[:, k] = _metres(lats[before], lons[before], y, x) <= self.metres
            now = first(near)
            changed = np.flatnonzero(now != pick)
            if not len(changed):
                return pick, paths
            # what comes before the first change is right, and so is the change
            pick, right = now, changed[0] + 1
        pick = pick[:right]
        return pick, self._paths(y[:right], x[:right], pick)

    def take(self, y: np.ndarray, x: np.ndarray) -> list[int]:
        """Takes places in; the numbers of those that started a cluster."""
        at, started = 0, []
        while at < len(y):
            if not self.size:
                self._start(y[at], x[at])
                started.append(at)
                at += 1
                continue
            length = max(1, min(self.stretch, len(y) - at, (1 << 20) // self.size))
            pick, paths = self._decide(y[at : at + length], x[at : at + length])
            for k, (_, lats, lons) in paths.items():
                self.lat[k], self.lon[k], self.n[k] = lats[-1], lons[-1], self.n[k] + len(lats) - 1
            at += len(pick)
            if pick[-1] < 0:
                self._start(y[at - 1], x[at - 1])
                started.append(at - 1)
            self.stretch = max(8, min(2048, self.stretch * 2 if len(pick) == length else 2 * len(pick)))
        return started


def _regions(places: DataFrame, metres: float) -> DataFrame:
    """places with _band and _part, a region: no place can meet a cluster of another region's places.

    A centroid is within `metres` of the place that joined last, and lies between it and the centroid before, so places with a gap of more than twice
    that in latitude, or within a band of latitudes in longitude, are apart. Bands near a pole and those across 180 degrees are one region. Only cells that
    have places are compared: at most some 180,000 rows of latitude, and a band's cells."""
    step = max(2.5 * metres / 111_000.0, 1e-3)
    celled = places.withColumns({"_y": F.floor(F.col("lat") / step), "_x": F.floor(F.col("lon") / step)})
    cells = celled.groupBy("_y", "_x").agg(F.min("lon").alias("_lo"), F.max("lon").alias("_hi"), F.max(F.abs("lat")).alias("_abs"))
    rows = cells.groupBy("_y").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_abs").alias("_abs"))
    above = F.col("_y") - F.lag("_y").over(Window.orderBy("_y"))
    banded = rows.withColumn("_new", F.when(above <= 1, 0).otherwise(1)).withColumn("_band", F.sum("_new").over(Window.orderBy("_y")))
    of_band = Window.partitionBy("_band")
    top = F.max("_abs").over(of_band)
    reach = 2.5 * F.degrees(2 * F.asin(F.least(F.lit(1.0), math.sin(min(metres / 2 / _EARTH_M, math.pi / 2)) / F.cos(F.radians(top)))))
    lone = (top > 85) | (F.min("_lo").over(of_band) + 360 - F.max("_hi").over(of_band) <= reach)
    bands = banded.select("_y", "_band", reach.alias("_reach"), lone.alias("_lone"))
    along = Window.partitionBy("_band").orderBy("_lo", "_y", "_x")
    gap = F.col("_lo") - F.max("_hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    parted = cells.join(bands, "_y").withColumn("_new", F.when(~F.col("_lone") & (gap > F.col("_reach")), 1).otherwise(0)).withColumn("_part", F.sum("_new").over(along))
    return celled.join(parted.select("_y", "_x", "_band", "_part"), ["_y", "_x"]).drop("_y", "_x")


def site_clusters(places: DataFrame, metres: float = 500.0) -> DataFrame:
    """cluster, n, lat, lon: a place (frame_id, lat, lon) joins the first cluster whose centroid is within `metres`, else it starts one; the
    centroid is the mean of its places. Places are taken one after another, in the order of frame_id.

    The result depends on that order, so one task folds a region's sorted places as they come; it holds the region's clusters only. Regions that are
    apart go to different tasks; clusters are numbered by the places that started them. Places outside the globe are left out."""
    rows = places.where("lat between -90 and 90 and lon between -180 and 180").select("frame_id", F.col("lat").cast("double"), F.col("lon").cast("double"))

    def fold(batches):
        region, held, starts, done = None, None, [], []

        def end():
            table = pa.Table.from_batches(starts).rename_columns(["_first", "_lat", "_lon"])
            for name in ("n", "lat", "lon"):
                table = table.append_column(name, pa.array(getattr(held, name)[: held.size]))
            return table

        for batch in batches:
            band, part, y, x = (batch.column(c).to_numpy() for c in ("_band", "_part", "lat", "lon"))
            edges = [0, *(np.flatnonzero((band[1:] != band[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(y)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if region != (band[lo], part[lo]):
                    if held is not None:
                        done.append(end())
                    region, held, starts = (band[lo], part[lo]), _Fold(metres), []
                new = pa.array(held.take(y[lo:hi], x[lo:hi]), pa.int64())
                starts.append(batch.slice(lo, hi - lo).select(["frame_id", "lat", "lon"]).take(new))
            if len(done) > 1000:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done = []
        if held is not None:
            done.append(end())
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    key = rows.schema["frame_id"].dataType.simpleString()
    sorted_rows = _regions(rows, metres).repartition("_band", "_part").sortWithinPartitions("_band", "_part", "frame_id", "lat", "lon")
    found = sorted_rows.mapInArrow(fold, f"_first {key}, _lat double, _lon double, n long, lat double, lon double")
    number = F.row_number().over(Window.orderBy("_first", "_lat", "_lon")) - 1
    return found.select(number.alias("cluster"), "n", "lat", "lon")


def _cells(df: DataFrame, metres: float, around: bool) -> DataFrame:
    """df with the square that a place is in (_y, _x, _wide), or all that a circle around it can touch. Squares are `metres` high, and as many
    degrees wide; near the poles, where those are short, one square holds a whole parallel."""
    step = max(metres / 111_000.0, 1e-6)
    y = F.floor((F.col("lat") + 90) / step)
    # the circle's reach in squares, at its end nearer to a pole; one more as the last square of a parallel may be narrow
    wide = F.ceil(1 / F.cos(F.radians(F.least(F.abs(F.col("lat")) + 2 * step, F.lit(89.999))))) + 1
    columns = F.lit(max(1, math.ceil(360 / step)))
    x = F.floor((F.col("lon") + 180) / step)
    if not around:
        return df.withColumns({"_y": y, "_x": F.pmod(x, columns)})
    df = df.withColumn("_y", F.explode(F.sequence(y - 1, y + 1)))
    span = F.when(2 * wide + 1 >= columns, F.sequence(F.lit(0).cast("long"), columns.cast("long") - 1)).otherwise(F.sequence(x - wide, x + wide))
    return df.withColumn("_x", F.explode(F.array_distinct(F.transform(span, lambda v: F.pmod(v, columns)))))


def _met(places: DataFrame, sites: DataFrame, metres: float, how: str) -> DataFrame:
    """Each place with the sites in the squares around it and their distance (_d)."""
    s = _cells(sites.select("site_id", "lat", "lon"), metres, True).select("site_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "_y", "_x")
    return _cells(places, metres, False).join(s, ["_y", "_x"], how).withColumn("_d", haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))


def sites_within(places: DataFrame, sites: DataFrame, metres: float, key: str = "frame_id") -> DataFrame:
    """Each place with the nearest site within `metres`, if any; both meet by squares of the globe, sites in all that their circle touches."""
    near = _met(places, sites, metres, "inner").where(F.col("_d") <= metres)
    best = near.groupBy(key).agg(F.min_by("site_id", F.struct("_d", "site_id")).alias("site_id"))
    return places.join(best, key, "left")


def site_coverage(places: DataFrame, sites: DataFrame, metres: float = 500.0) -> DataFrame:
    """The clusters of `site_clusters`, with the nearest site within `metres` of the centroid (site_id), if any."""
    met = _met(site_clusters(places, metres), sites, metres, "left")
    # clusters are grouped with their columns, not joined again, as that would fold the places twice
    return met.groupBy("cluster", "n", "lat", "lon").agg(F.min_by("site_id", F.when(F.col("_d") <= metres, F.struct("_d", "site_id"))).alias("site_id"))


def frame_places(cards: DataFrame, latitude: list[str], longitude: list[str]) -> DataFrame:
    """frame_id, lat, lon of the frames with both, from the first of the keywords that each has; sexagesimal or decimal."""
    lat, lon = (first_card(cards, words, name) for words, name in ((latitude, "_lat"), (longitude, "_lon")))
    both = lat.join(lon, "frame_id").select("frame_id", coordinate(F.col("_lat"), False).alias("lat"), coordinate(F.col("_lon"), False).alias("lon"))
    return both.where("lat is not null and lon is not null")


def rig_overlaps(rigs: DataFrame) -> DataFrame:
    """Pairs of active rigs of one camera whose focal ranges overlap."""
    a = rigs.where("active").select("rig_id", "camera_id", "focal_min", "focal_max")
    b = a.select(F.col("rig_id").alias("other_id"), "camera_id", F.col("focal_min").alias("lo"), F.col("focal_max").alias("hi"))
    return a.join(b, "camera_id").where("focal_min <= hi and focal_max >= lo and rig_id < other_id").select("rig_id", "other_id")
