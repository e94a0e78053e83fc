"""Walks, scans under watch, discovery that settles, back-fills and exports, on small fixtures."""

import datetime as dt
import json
import os
import re
import threading
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from skyquarry.functions import headers
from skyquarry.operators import actions, archive, cluster, equipment, match, rescan
from skyquarry.operators.progress import ScanCancelled, ScanRunning, Scans
from skyquarry.sources import headers as source
from skyquarry.sources.walk import walk
from skyquarry.streaming.discovery import Discovery, discover
from skyquarry.streaming.snapshot import stored


def at(text):
    return F.lit(text).cast("timestamp_ntz")


# -- walks

def plain_walk(base, names):
    globs = [re.compile("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in n.lower()) + "$") for n in names]
    hidden = lambda n: any(g.match(n.lower()) for g in globs)
    for folder, folders, files in os.walk(base):
        folders[:] = [f for f in folders if not hidden(f)]
        yield from (os.path.relpath(os.path.join(folder, f), base) for f in files if not hidden(f) and os.path.isfile(os.path.join(folder, f)))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """About a hundred thousand files in three roots, with names that are patterns themselves."""
    base = tmp_path_factory.mktemp("tree")
    for r, (folders, files) in enumerate([(90, 1100), (5, 7), (0, 0)]):
        for d in range(folders):
            folder = base / f"r{r}" / f"night {d % 9}" / ("CACHE.d" if d % 10 == 3 else f"é{d}") / "deep[1]"
            folder.mkdir(parents=True, exist_ok=True)
            for f in range(files):
                (folder / (f"f{f}.fits" if f % 50 else f"F{f}.TMP")).touch()
        (base / f"r{r}").mkdir(exist_ok=True)
        (base / f"r{r}" / "note.txt").write_text("12345")
    os.symlink(base / "r1", base / "r2" / "link")
    return base


@pytest.mark.parametrize("lists", [(None, None, None), ("*.tmp, cache.?", "", "note.*"), ("night 1\ndeep[1]", None, None)])
def test_walk(spark, tree, lists):
    default = (".*", "*.tmp")
    roots = spark.createDataFrame([(r, f"file://{tree}/r{r}" if r else f"{tree}/r0", t) for r, t in enumerate(lists)], "root_id int, path string, ignore_names string")
    got = walk(spark, roots, default)
    want = sorted((r, p) for r, t in enumerate(lists) for p in plain_walk(tree / f"r{r}", default if t is None else archive.ignore_list(t)) if r < 2)
    assert sorted((r.root_id, r.rel_path) for r in got.where("root_id < 2").collect()) == want and (lists[0] or len(want) > 90_000)
    assert got.where("rel_path = 'note.txt' and root_id = 1").select("size_bytes").first()[0] == 5 and got.where("error is not null").count() == 0


def test_walk_of_missing_and_no_roots(spark, tmp_path):
    roots = spark.createDataFrame([(1, f"{tmp_path}/none", None)], "root_id int, path string, ignore_names string")
    got = walk(spark, roots).collect()
    assert [(r.root_id, r.rel_path) for r in got] == [(1, "")] and got[0].error
    assert walk(spark, roots.where("false")).count() == 0


# -- filters that reach the reader of headers

def fits_file(units):
    out = b""
    for i in range(units):
        first = "SIMPLE  = T" if not i else "XTENSION= 'IMAGE   '"
        axes = ["BITPIX  = 8", "NAXIS   = 0"] if i == 0 and units > 1 else ["BITPIX  = 8", "NAXIS   = 2", "NAXIS1  = 4", "NAXIS2  = 3"]
        text = "".join(x.ljust(80) for x in [first, *axes, "END"]).encode()
        out += text + b" " * (-len(text) % 2880) + (b"\0" * 2880 if "NAXIS   = 2" in axes else b"")
    return out


@pytest.mark.parametrize("listed", [False, True])
def test_filters_reach_the_reader(spark, tmp_path, listed):
    for i in range(6):
        (tmp_path / f"é{i}.fits").write_bytes(fits_file(1 + i % 3) if i != 4 else b"broken")
    spark.dataSource.register(source.HeaderSource)
    reader = spark.read.format("frame_headers")
    if listed:
        roots = spark.createDataFrame([(1, str(tmp_path), None)], "root_id int, path string, ignore_names string")
        walk(spark, roots).select(F.concat(F.lit(f"{tmp_path}/"), "rel_path").alias("path")).repartition(3).write.parquet(f"{tmp_path}/paths.parquet")
        load = lambda: reader.option("listing", f"{tmp_path}/paths.parquet").load()
    else:
        load = lambda: reader.load(str(tmp_path))
    conditions = ["is_image", "not is_image", f"path >= '{tmp_path}/é2' and is_image", f"path like '{tmp_path}/é1%'", f"path in ('{tmp_path}/é0.fits', '{tmp_path}/é4.fits', 'x')", f"path = '{tmp_path}/é5.fits' and naxis1 = 4", "error is not null and path is not null", "hdu > 0 or is_image"]
    shown = lambda df: sorted((r.path, r.hdu if r.hdu is not None else -1) for r in df.collect())
    want = [shown(load().where(c)) for c in conditions]
    try:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        reader = reader.option("pushFilters", True)
        assert [shown(load().where(c)) for c in conditions] == want and all(want)
        plan = load().where(conditions[2])._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"\bFilter \(", plan)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


# -- scans under watch

ROOTS = [(1, True, 10), (2, True, 10)]


def sweep(spark, path, now, size=None, slow=False):
    roots = spark.createDataFrame(ROOTS, "root_id int, enabled boolean, interval_minutes int")
    listing = spark.sql("select cast(id % 2 + 1 as int) as root_id, concat('f', id) as rel_path, id as size_bytes, timestamp_ntz'2024-01-01 00:00:00' as mtime_utc from range(0, 40, 1, 4)")
    if slow:
        sleep = F.udf(lambda x: time.sleep(0.5) or x, "long")
        listing = listing.withColumn("size_bytes", sleep("size_bytes"))
    if size:
        listing = listing.withColumn("size_bytes", F.lit(size).cast("long"))
    read = spark.sql("select cast(id % 2 + 1 as int) as root_id, concat('f', id) as rel_path, concat('k', id) as content_key, cast(null as string) as error from range(40)")
    return rescan.sweep_due(spark, path, roots, listing, read, at(now))


def table(spark, path):
    return sorted(map(str, stored(spark, path, rescan.files_schema()).collect()))


def test_one_scan_of_a_root_and_cancel(spark, tmp_path):
    path, scans, outcome = f"{tmp_path}/files", Scans(spark), {}
    with scans.scan(1, 2):
        assert sweep(spark, path, "2024-02-01 00:00:00") == {"files": 40, "add": 40}
        with pytest.raises(ScanRunning), scans.scan(2, 3):
            pass
        assert list(scans.running) == [1, 2]  # a refused scan takes nothing
    assert not scans.running and not scans.cancel(1)
    before = table(spark, path)

    def slow():
        try:
            with scans.scan(1):
                sweep(spark, path, "2024-02-02 00:00:00", slow=True)
        except ScanCancelled as e:
            outcome["error"] = e

    thread = threading.Thread(target=slow)
    thread.start()
    deadline = time.time() + 60
    while time.time() < deadline and not (1 in scans.running and scans.running[1].progress().tasks):
        time.sleep(0.05)
    seen = scans.running[1].progress()
    assert seen.stages and seen.done <= seen.tasks
    with scans.scan(2):  # another root is free meanwhile
        pass
    assert scans.cancel(1)
    thread.join(60)
    assert "error" in outcome and not scans.running and table(spark, path) == before
    assert sweep(spark, path, "2024-02-03 00:00:00") == {"files": 40, "skip": 40}  # and it can be repeated


def test_scan_that_fails_by_itself(spark):
    scans = Scans(spark)
    with pytest.raises(ZeroDivisionError), scans.scan("a"):
        _ = 1 // 0
    assert not scans.running and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


# -- discovery

def test_discovery_settles_and_restarts(spark, tmp_path):
    source, folder = f"{tmp_path}/listings", f"{tmp_path}/out"

    def arrive(*rows):
        df = spark.sql("select * from values " + ", ".join(rows) + " as t(root_id, rel_path, size_bytes, mtime_utc, content_key)")
        df.selectExpr("cast(root_id as int) root_id", "cast(rel_path as string) rel_path", "cast(size_bytes as long) size_bytes", "cast(mtime_utc as timestamp_ntz) mtime_utc", "cast(content_key as string) content_key").coalesce(1).write.mode("append").parquet(source)

    def run(now):
        return [{k: c[k] for k in ("add", "update", "skip")} for c in discover(spark, source, folder, at(now))]

    def files():
        return sorted((r.root_id, r.rel_path, r.size_bytes, r.content_key) for r in Discovery(folder).files.read(spark).collect())

    arrive("(1, 'a', 1, '2024-01-01 00:00:00', 'x')", "(1, 'b', 2, '2024-01-01 11:59:50', 'y')", "(2, 'c', 3, null, null)", "(null, 'd', 4, null, null)", "(1, 'a', 1, '2024-01-01 00:00:00', 'x')")
    assert run("2024-01-01 12:00:00") == [{"add": 2, "update": 0, "skip": 0}]
    assert files() == [(1, "a", 1, "x"), (2, "c", 3, None)]
    assert run("2024-01-01 12:00:05") == []  # b still settles
    arrive("(1, 'a', 1, '2024-01-01 00:00:00', 'x')", "(1, 'b', 5, '2024-01-01 12:00:20', 'z')")  # b has been written again
    assert run("2024-01-01 12:00:30") == [{"add": 0, "update": 0, "skip": 1}]
    assert run("2024-01-01 12:01:00") == [{"add": 1, "update": 0, "skip": 0}] and files()[1] == (1, "b", 5, "z")
    assert Discovery(folder).settling(spark).count() == 0
    arrive("(1, 'a', 9, '2024-01-01 13:00:00', 'w')", "(1, 'b', 2, '2024-01-01 11:59:50', 'y')")  # a has changed; an older row of b comes late
    got = run("2024-01-01 14:00:00")
    assert files()[0] == (1, "a", 9, "w") and got[0]["update"] >= 1
    assert run("2024-01-01 15:00:00") == []


# -- back-fills, suggestions, offsets

def test_back_fill_of_many_ranges(spark):
    """A hundred thousand ranges of one camera: against a plain search, and without a nested loop."""
    rigs = spark.range(100_000).selectExpr("cast(id as int) as rig_id", "0 as camera_id", "cast(id * 7 % 50000 as int) as focal_min", "cast(id * 7 % 50000 + id % 40 as int) as focal_max", "cast(if(id % 3 = 0, null, id % 9) as int) as site_id")
    frames = spark.range(300).selectExpr("id as frame_id", "cast(id % 2 as int) as camera_id", "cast(if(id % 50 = 7, null, id * 173) as int) as focal_len_mm", "-1 as rig_id", "-1 as site_id")
    df = archive.rig_back_fill(frames, rigs)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    ranges = [(r.rig_id, r.focal_min, r.focal_max, r.site_id) for r in rigs.collect()]
    for r in df.collect():
        hit = [x for x in ranges if r.camera_id == 0 and r.focal_len_mm is not None and x[1] <= r.focal_len_mm <= x[2]]
        sites = [x for x in hit if x[3] is not None]
        assert (r.rig_id, r.site_id) == (max(hit)[0] if hit else -1, max(sites)[3] if sites else -1)


def test_focal_suggestions_by_the_chain(spark):
    frames = spark.createDataFrame([(1, 500), (1, 505), (2, 800)], "camera_id int, focal_len_mm int")
    rig = lambda lo, hi, active: spark.createDataFrame([(1, lo, hi, active)], "camera_id int, focal_min int, focal_max int, active boolean")
    lows = lambda r: sorted((x.camera_id, x.lo, x.hi) for x in cluster.focal_clusters(frames, r).collect())
    assert lows(rig(506, 520, True)) == [(1, 500, 505), (2, 800, 800)]  # beside the chain, within its slack
    assert lows(rig(490, 500, False)) == [(2, 800, 800)]  # one that isn't active counts too


def test_night_offset_of_the_caller(spark):
    sites = spark.createDataFrame([(1, 2.0), (2, None)], "site_id int, utc_offset_hours double")
    assert [archive.night_offset(sites, s, o) for s, o in ((1, -7.0), (1, 0.0), (2, 0.0), (None, 0.0), (None, 3.0))] == [-7.0, 2.0, 0.0, 0.0, 3.0]


def test_write_back_of_odd_places(spark):
    files = spark.createDataFrame([(i, 1, f"p{i}", "ok", None) for i in range(6)], "file_id long, root_id int, rel_path string, file_status string, last_seen_utc timestamp_ntz")
    roots = spark.createDataFrame([(1, "/data/a/"), (2, "/data/a/b")], "root_id int, path string")
    done = spark.createDataFrame([(0, "/data/a/b/x.fits", "move", "ok"), (1, "/data/ab/x.fits", "move", "ok"), (2, "/data/a/y", "move", "failed"), (3, "/data/a/z", "copy", "ok"), (4, "/data/a/q", "trash", "ok"), (99, "/data/a/q", "move", "ok")], "file_id long, dst string, action string, state string")
    got = {r.file_id: (r.root_id, r.rel_path, r.file_status) for r in archive.write_back(files, done, roots, at("2024-01-01 00:00:00")).collect()}
    assert got == {0: (2, "x.fits", "ok"), 1: (1, "p1", "missing"), 2: (1, "p2", "ok"), 3: (1, "p3", "ok"), 4: (1, "q", "ok"), 5: (1, "p5", "ok")}


def test_names_equal_by_case_and_accents(spark):
    frames = spark.createDataFrame([("Été ", None), ("ETE", "x"), ("ete", "Summer"), ("other", None), (None, None)], "object string, object_canonical string")
    mapping = spark.createDataFrame([("éte", "Summer"), ("OTHER", "")], "raw string, canonical string")
    got = sorted((r.object or "", r.object_canonical or "") for r in archive.apply_names(frames, mapping).collect())
    assert got == [("", ""), ("ETE", "Summer"), ("ete", "Summer"), ("other", ""), ("Été ", "Summer")]
    assert [(r.raw, r.canonical, r.frames) for r in archive.preview_names(frames, mapping).collect()] == [("éte", "Summer", 2)]


def test_broken_patterns_are_left_out(spark):
    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    head = rows("id int, field string, keyword string, priority int, enabled boolean", (1, "filter", "FILTER", 1, True))
    value = rows("id int, field string, raw_value string, normalized string, match_mode string, priority int", (1, "filter", "(", "a", "regex", 1), (2, "filter", "^h", "b", "regex", 2), (3, "filter", "[", "c", "contains", 3))
    assert headers.load_mapping(head, value).values == {"filter": (("regex", "^h", "b"), ("contains", "[", "c"))}


def test_invalid_rules():
    rule = match.Rule.from_json("r", "flat", "[1]")
    assert rule.invalid and match.Rule.from_json("r", "flat", "{").invalid and not match.Rule.from_json("r", "flat", '{"gain": {"tol": 2}}').invalid
    assert match.Rule.from_json("r", "flat", '{"gain": {"tol": 2}}').spec == {"gain": 2.0}


# -- equipment

def brute_equipment(instrument, glass, focal, cameras, aliases, filters, named, rigs):
    fold = lambda t: t.rstrip().lower().replace("é", "e")
    hit = sorted((p, a.lower(), c) for a, c, p in aliases if a and instrument is not None and a.lower() in instrument.lower())
    model = re.search(r"ASI\s?\d{3,4}", instrument or "", re.I)
    camera = hit[0][2] if hit else re.sub(r"\s", "", model[0].upper()) if model else None
    ids = {fold(n): i for i, n in reversed(cameras)}
    by_alias, by_name = {fold(a): i for a, i in named}, {fold(n): i for i, n in reversed(filters)}
    cid = None if camera is None else ids.get(fold(camera), camera)
    fid = None if glass is None else by_alias.get(fold(glass), by_name.get(fold(glass), fold(glass)))
    found = sorted(r for r in rigs if r[1] == cid and r[5] and focal is not None and r[2] <= focal <= r[3])
    return cid, fid, found[0][0] if found else None, (found[0][4] if found else None) or 7


def test_equipment_by_brute_force(spark):
    """Aliases that overlap, tie and are short; names of any spelling; unseen devices; limits of ranges met exactly."""
    cameras, filters, named = [(4, "ASI1600"), (9, "Qhy é")], [(1, "Ha"), (2, "OIII")], [("H-alpha", 1), ("Été", 2)]
    aliases = [("qhy268", "QHY E", 5), ("268", "other", 5), ("x", "ASI1600", 3), ("", "never", 0), ("canon eos", "New One", 1), ("CANON", "new one ", 1)]
    rigs = [(1, 4, 100, 149, None, True), (2, 4, 149, 1000, 3, True), (3, 4, 100, 900, 5, False), (5, 9, 0, 10_000, 6, True)]
    instruments = ["ZWO ASI1600MM", "asi 1600", "QHY268M", "M268", "xyz", "Canon EOS R", "canon", "my asi 2600", "plain", None, ""]
    glasses = ["ha ", "HA", "h-ALPHA", "ete", "Sii", "sii", None]
    rows = [(i, x, g, f) for i, (x, g, f) in enumerate((x, g, f) for x in instruments for g in glasses for f in (99, 100, 149, 150, 1000, 1001, None))]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    registry = equipment.Registry(
        table(cameras, "camera_id int, camera string"), table(aliases, "alias string, camera string, priority int"), table(filters, "filter_id int, name string"), table(named, "alias string, filter_id int"),
        table(rigs, "rig_id int, camera_id int, focal_min int, focal_max int, site_id int, active boolean"), 7,
    )
    got = equipment.resolve(table(rows, "frame_id long, instrument string, filter_raw string, focal_len_mm int"), registry)
    assert [(r.camera_id, r.camera) for r in got.cameras.orderBy("camera_id").collect()] == [*cameras, (10, "ASI2600"), (11, "new one "), (12, "other")]
    assert [(r.filter_id, r.name) for r in got.filters.orderBy("filter_id").collect()] == [*filters, (3, "Sii")]
    new = {"ASI2600": 10, "New One": 11, "new one ": 11, "other": 12, "sii": 3}
    want = {i: tuple(new.get(v, v) for v in brute_equipment(x, g, f, cameras, aliases, filters, named, rigs)) for i, x, g, f in rows}
    assert {r.frame_id: (r.camera_id, r.filter_id, r.rig_id, r.site_id) for r in got.frames.collect()} == want
    empty = equipment.resolve(table([], "frame_id long, instrument string, filter_raw string, focal_len_mm int"), registry)
    assert empty.frames.count() == 0 and empty.cameras.count() == 2


def test_many_aliases_without_a_nested_loop(spark):
    names = spark.range(2000).selectExpr("concat('cam-', id * 37 % 5000, '-x') as instrument").distinct()
    aliases = spark.range(100_000).selectExpr("concat('-', id, '-') as alias", "concat('c', id) as camera", "cast(id % 3 as int) as priority")
    got = {r.instrument: r.camera for r in equipment.camera_names(names, aliases).collect()}
    assert got == {n: "c" + n.split("-")[1] for n in got} and len(got) == 2000


# -- exports

def lines(folder):
    names = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
    return [open(os.path.join(folder, n), encoding="utf-8").read().split("\n")[:-1] for n in names]


def test_exports_in_order(spark, tmp_path):
    rows = [(i, "light", f'f "{i}", x' if i % 3 else f"é{i}", f"/data/{i * 7 % 11}") for i in range(40)]
    frames = spark.createDataFrame(rows, "frame_id long, image_type string, filename string, abs_path string").repartition(5)
    order = (F.desc("frame_id"),)
    db = duckdb.connect()
    db.execute("create table t (frame_id bigint, image_type varchar, filename varchar, path varchar)")
    db.executemany("insert into t values (?, ?, ?, ?)", rows[::-1])
    db.execute(f"copy t to '{tmp_path}/t.csv' (header)")
    for kind in ("paths", "json", "csv"):
        actions.export(frames, f"{tmp_path}/{kind}", kind, order)
    assert [x for part in lines(f"{tmp_path}/paths") for x in part] == [r[3] for r in rows[::-1]]
    assert [json.loads(x) for part in lines(f"{tmp_path}/json") for x in part] == [dict(zip(("frame_id", "image_type", "filename", "path"), r)) for r in rows[::-1]]
    got = [x for part in lines(f"{tmp_path}/csv") for x in part[1:]]
    assert got == open(f"{tmp_path}/t.csv", encoding="utf-8").read().split("\n")[1:-1]
    with pytest.raises(Exception, match="exists"):
        actions.export(frames, f"{tmp_path}/csv", "csv", order)
    with pytest.raises(ValueError):
        actions.export(frames, f"{tmp_path}/x", "xml", order)


def test_failed_export_leaves_nothing(spark, tmp_path):
    frames = spark.range(0, 100, 1, 4).selectExpr("id as frame_id", "'light' as image_type", "'f' as filename", "if(id = 70, raise_error('gone'), concat('/p', id)) as abs_path")
    with pytest.raises(Exception, match="gone"):
        actions.export(frames, f"{tmp_path}/out", "csv", ("frame_id",))
    assert not os.path.exists(f"{tmp_path}/out") or not [n for n in os.listdir(f"{tmp_path}/out") if n.startswith("part-")]


def test_sweep_meets_the_known_files_once(spark):
    """The plan of the rows listed joins the known files in one step, not first for the action and then for what is kept."""
    schema = "file_id long, root_id int, rel_path string, size_bytes long, mtime_utc timestamp_ntz, file_status string, last_seen_utc timestamp_ntz, content_key string"
    known = spark.createDataFrame([(i, 0, f"f{i}", i, dt.datetime(2025, 1, 1), "ok", dt.datetime(2025, 1, 1), f"k{i}") for i in range(8)], schema)
    listing = known.where("file_id <> 3").select("root_id", "rel_path", (F.col("size_bytes") + F.when(F.col("file_id") == 5, 1).otherwise(0)).alias("size_bytes"), "mtime_utc")
    read = known.selectExpr("root_id", "rel_path", "concat('n', file_id) as content_key", "cast(null as string) as error")
    out = archive.sweep(listing, known, read, F.lit(dt.datetime(2025, 1, 2)).cast("timestamp_ntz"))
    got = {r.file_id: (r.outcome, r.content_key, r.file_status) for r in out.collect()}
    assert got == {i: ("missing", "k3", "missing") if i == 3 else ("update", "n5", "ok") if i == 5 else ("skip", f"k{i}", "ok") for i in range(8)}
    assert out._jdf.queryExecution().analyzed().toString().count("Join LeftOuter") == 5  # known and read, for files and for moves, and re_anchor
