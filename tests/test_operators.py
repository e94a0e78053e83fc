"""Facts about headers, names, filters, matching and sweeps on small fixtures."""

import datetime as dt
import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from skyquarry.functions import catalogs, headers
from skyquarry.operators import actions, archive, cluster, match
from skyquarry.plans.filter_ast import Context, QueryError, compile_filter, compile_sort, filter_fields
from skyquarry.sources import headers as source

# Spellings and their canonical names.
NAMES = {
    "M31": "M 31", "M 31": "M 31", "m 13": "M 13", "Messier 42": "M 42", "NGC_7000": "NGC 7000", "ngc-7000": "NGC 7000", "ic434": "IC 434", "sh2 199": "Sh2-199", "Sharpless 199": "Sh2-199",
    "aco2634": "Abell 2634", "b33": "B 33", "ngc7000a": "NGC 7000A", "Icarus": "Icarus", "Barnard's Galaxy": "Barnard's Galaxy", "SAC Abell 2634": "SAC Abell 2634", "vdB 142": "vdB 142",
    "  NGC   6960 ": "NGC 6960", "NGC224": "M 31", "IC4725": "M 25", "M 45": "M 45",
}


def test_names(spark):
    df = spark.createDataFrame([(k,) for k in NAMES], "name string")
    rows = df.select("name", catalogs.canonical(F.col("name")).alias("c")).collect()
    assert {r.name: r.c.canonical for r in rows} == NAMES
    assert {k: catalogs.canonical_value(k) for k in NAMES} == NAMES
    assert catalogs.designation_values("ngc 224") == ["M 31", "NGC 224"] and catalogs.designation_values("M45") == ["M 45"]
    odd = spark.createDataFrame([("Target",), ("FlatWizard",), ("",), (None,)], "name string").select(catalogs.canonical(F.col("name")).alias("c")).collect()
    assert [r.c and r.c.placeholder for r in odd] == [True, True, True, None]


def resolve(spark, cards, offset=-7.0):
    df = spark.createDataFrame([(cards,)], "cards map<string,string>")
    return df.select(*(c.alias(k) for k, c in headers.resolve(F.col("cards"), offset).items())).first()


def test_resolve_light(spark):
    r = resolve(spark, {"IMAGETYP": "LIGHT", "DATE-OBS": "2025-11-27T03:32:39.6264089", "OBJECT": "NGC 6960", "RA": "311.404464", "DEC": "30.7237", "FILTER": "CLEAR", "EXPTIME": "300.0", "GAIN": "100", "XBINNING": "1", "SET-TEMP": "0.0", "FOCALLEN": "1295.0", "PIERSIDE": "East", "ROWORDER": "TOP-DOWN"})
    assert (r.image_type, r.session_night, r.filter_raw, r.filter_defaulted, r.pier_side, r.row_order) == ("light", dt.date(2025, 11, 26), "CLEAR", False, "east", "top-down")
    r = resolve(spark, {"IMAGETYP": "Dark", "FILTER": "!Shutter!", "GAINRAW": "100", "CCDXBIN": "2", "OBJCTRA": "20 45 42", "OBJCTDEC": "+30 43 00", "DATE-OBS": "garbage"})
    assert (r.filter_raw, r.gain, r.binx, round(r.ra_deg, 3), round(r.dec_deg, 4), r.review_reason) == (None, 100, 2, 311.425, 30.7167, "no-dateobs")


@pytest.mark.parametrize("text,kind", [("Light Frame", "light"), ("Flat Field", "flat"), ("Master Dark", "master"), ("MasterFlat integration", "master"), ("FlatDark", "darkflat"), ("Dark Flat", "darkflat"), ("Zero", "bias"), ("Wibble", "unknown")])
def test_types(spark, text, kind):
    assert resolve(spark, {"IMAGETYP": text}).image_type == kind


def fits(cards, data=0, first="SIMPLE  =                    T"):
    lines = [first, *cards, "END"]
    text = "".join(x.ljust(80) for x in lines).encode()
    return text + b" " * (-len(text) % 2880) + b"\0" * (data + -data % 2880)


def test_header_files(spark, tmp_path):
    geometry = ["BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                   32", "NAXIS2  =                   24"]
    (tmp_path / "a.fits").write_bytes(fits([*geometry, "OBJECT  = 'Barnard''s Star  ' / the target", "EXPTIME =                 1.50"], 32 * 24 * 2))
    two = fits(["BITPIX  =                    8", "NAXIS   =                    0"]) + fits([*geometry, "PCOUNT  = 0", "GCOUNT  = 1"], 32 * 24 * 2, "XTENSION= 'IMAGE   '")
    with gzip.open(tmp_path / "b.fits.gz", "wb") as f:
        f.write(two)
    (tmp_path / "bad.fits").write_bytes(b"no header")
    xml = '<?xml?><xisf><!-- <Image geometry="1:1:1"/> --><Image geometry="100:200:1" sampleFormat="UInt16"><FITSKeyword name="OBJECT" value="\'A &amp; B\'" comment="c"/></Image><FITSKeyword name="LOST" value="1"/><Image geometry=\'640:480:3\' sampleFormat="Float32"/></xisf>'.encode()
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.xisf").write_bytes(b"XISF0100" + struct.pack("<II", len(xml), 0) + xml)
    spark.dataSource.register(source.HeaderSource)
    df = spark.read.format("frame_headers").load(str(tmp_path))
    rows = {(r.path.rsplit("/", 1)[1], r.hdu): r for r in df.collect()}
    assert len(rows) == 6 and rows["bad.fits", None].error
    assert rows["a.fits", 0].naxis1 == 32 and ("OBJECT", "Barnard's Star") in {(c.keyword, c.value) for c in rows["a.fits", 0].cards}
    assert not rows["b.fits.gz", 0].is_image and rows["b.fits.gz", 1].naxis2 == 24
    assert (rows["c.xisf", 0].bitpix, rows["c.xisf", 0].naxis, rows["c.xisf", 1].naxis, rows["c.xisf", 1].bitpix) == (16, 2, 3, -32)
    assert [(c.keyword, c.value) for c in rows["c.xisf", 0].cards][-1] == ("OBJECT", "A & B")
    paths = source.listing(spark, str(tmp_path))
    assert {r.rel_path for r in paths.collect()} == {"a.fits", "b.fits.gz", "bad.fits", "sub/c.xisf"}
    again = source.card_map(source.read_headers(paths)).select(F.element_at("first", "EXPTIME").alias("e")).collect()
    assert {r.e for r in again} == {"1.50", None}


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(1, "light", "M31", "M 31", 100, "ok", 0.5, 30.0), (2, "dark", None, None, None, "ok", 359.9, 31.0), (3, "light", "X", "X", 200, "missing", 10.0, 89.0), (4, "flat", "m_42", "M 42", 300, "ok", 190.0, 88.0)]
    return spark.createDataFrame(rows, "frame_id long, image_type string, object string, object_canonical string, gain int, file_status string, ra_deg double, dec_deg double")


def ids(frames, node, ctx=None):
    return sorted(r.frame_id for r in frames.where(compile_filter(node, ctx)).collect())


def test_filters(spark, frames):
    assert ids(frames, {}) == [1, 2, 3, 4]
    assert ids(frames, {"field": "object", "value": "ngc 224"}) == [1]
    assert ids(frames, {"op": "cone", "ra": 0.2, "dec": 30.5, "radius_deg": 1}) == [1, 2]
    assert ids(frames, {"op": "cone", "ra": 10, "dec": 88, "radius_deg": 5}) == [3, 4]
    gain = {"field": "gain", "op": "lte", "value": 200}
    assert ids(frames, gain) == [1, 3] and ids(frames, {"op": "not", "clauses": [gain]}) == [4]  # the null is in neither
    cards = spark.createDataFrame([(1, "FOCTEMP", "-7.5"), (2, "FOCTEMP", "warm"), (4, "foctemp", "-3abc")], "frame_id long, keyword string, value string")
    cold = {"field": "keyword:FOCTEMP", "op": "lt", "value": -5}
    assert ids(frames, cold, Context(keywords=cards)) == [1]
    assert ids(frames, {"field": "keyword:FOCTEMP", "op": "lt", "value": -2}, Context(keywords=cards, lenient_numeric=True)) == [1, 4]
    assert ids(frames, {"op": "or", "clauses": [cold, {"field": "gain", "value": 300}]}, Context(keywords=cards)) == [1, 4]
    assert filter_fields({"op": "and", "clauses": [gain, {"field": "object"}, gain, {"op": "cone"}]}) == ["gain", "object"]


@pytest.mark.parametrize("node", [[], {"op": "and"}, {"op": "or", "clauses": []}, {"field": "nope", "value": 1}, {"field": "gain", "op": "in", "value": []}, {"field": "gain", "op": "between", "value": [1]}, {"field": "gain", "value": "x"}, {"field": "gain", "op": "~", "value": 1}, {"field": "gain", "op": "eq"}, {"op": "cone", "ra": 1, "dec": 2, "radius_deg": 0}, {"op": "tagged", "value": None}, {"field": "keyword:", "value": 1}])
def test_rejected(node):
    with pytest.raises(QueryError):
        compile_filter(node)
    with pytest.raises(QueryError):
        compile_sort([{"field": "nope"}])


def brute_match(rows, names, rule, limit):
    """(light, rank, frame, total) by comparing every light with every candidate."""
    frames = [dict(zip(names, r)) for r in rows]
    out, totals = [], {}
    for l in (f for f in frames if f["image_type"] == "light"):
        found = []
        for c in frames:
            if not (c["image_type"] == rule.target or c["image_type"] == "master" and c["master_of"] == rule.target):
                continue
            fits = {"exact": lambda x, y: x == y, "null_ok": lambda x, y: x is None or y is None or x == y}
            if not all((fits[how](l[n], c[n]) if isinstance(how, str) else l[n] is None or c[n] is not None and abs(c[n] - l[n]) <= how) for n, how in rule.spec.items()):
                continue
            micros = abs((c["date_obs_utc"] - l["date_obs_utc"]) // dt.timedelta(microseconds=1)) if c["date_obs_utc"] and l["date_obs_utc"] else None
            if rule.max_age_days is not None and micros is not None and micros // 86_400_000_000 > rule.max_age_days:
                continue
            same = c["session_night"] is not None and c["session_night"] == l["session_night"]
            found.append((rule.prefer_masters and c["image_type"] != "master", rule.prefer_same_session and not same, micros is None, (micros or 0) // 1_000_000, c["frame_id"]))
        totals[l["frame_id"]] = len(found)
        out += [(l["frame_id"], k, f[-1], len(found)) for k, f in enumerate(sorted(found)[:limit])]
    return sorted(out), totals


@pytest.mark.parametrize("age,masters,session,limit,bucket", [(2, True, True, 3, 1), (None, False, False, 2, 7), (0, True, False, 1, 2), (1, False, True, 4, 4000), (3, True, True, 2, 20)])
def test_matching_by_brute_force(spark, monkeypatch, age, masters, session, limit, bucket):
    """Ties within a second and at one moment, hours and age limits met exactly, undated frames, missing values."""
    monkeypatch.setattr(match, "BUCKET", bucket)
    rnd = random.Random(age or 7)
    start = dt.datetime(2025, 3, 1, 12)
    rows = []
    for i in range(400):
        at = start + dt.timedelta(days=rnd.choice((0, 0, 1, 2, 3, 4)), seconds=rnd.choice((0, 1, 1800, 3599, 3600, 3601, 20000)), microseconds=rnd.choice((0, 0, 1, 400_000, 999_999)))
        at = None if rnd.random() < 0.08 else at
        night = None if at is None or rnd.random() < 0.1 else (at - dt.timedelta(hours=rnd.choice((12, 14)))).date()
        kind = rnd.choice(("light", "dark", "dark", "master", "bias"))
        rows.append((i, kind, rnd.choice(("dark", "bias")) if kind == "master" else None, at, night, rnd.choice((1, 1, 1, 2, None)), rnd.choice((100, None)), rnd.choice((60.0, 61.0, 65.5, None))))
    schema = "frame_id long, image_type string, master_of string, date_obs_utc timestamp_ntz, session_night date, camera_id int, gain int, exposure_s double"
    rule = match.Rule("r", "dark", {"camera_id": "exact", "gain": "null_ok", "exposure_s": 2.0}, age, masters, session)
    df = spark.createDataFrame(rows, schema)
    want, totals = brute_match(rows, [c.split()[0] for c in schema.split(", ")], rule, limit)
    assert sorted((r.light_id, r["rank"], r.frame_id, r.total) for r in match.match(df, rule, limit).collect()) == want
    assert {r.light_id: r.total for r in match.warnings(df, rule).collect()} == totals
    # several rules go through one merge; one that isn't enabled and one that can't be read give nothing
    other = match.Rule("b", "bias", {"camera_id": "exact"}, age, not masters, not session, priority=5)
    rules = (match.Rule("off", "dark", enabled=False), rule, other, match.Rule.from_json("broken", "dark", "{", priority=1))
    every = match.match_all(df, rules, limit).collect()
    names = [c.split()[0] for c in schema.split(", ")]
    for place, name, one in ((2, "r", rule), (1, "b", other)):
        assert sorted((x.light_id, x["rank"], x.frame_id, x.total) for x in every if (x.rule_order, x.rule) == (place, name)) == brute_match(rows, names, one, limit)[0]
    assert {x.rule_order for x in every} == {1, 2}
    assert match.match(df.where("image_type = 'light'"), rule, limit).count() == 0 and match.match(df.where("false"), rule, limit).count() == 0


def test_matching(spark):
    night = lambda d: (dt.datetime(2025, 11, d, 22), dt.date(2025, 11, d))
    def row(i, kind, of, gain, offset, temp, at):
        return (i, kind, of, *at, 1, 1, 1, gain, offset, 1, 1, None, temp, 300.0, None)

    rows = [
        row(1, "light", None, 100, 50, -10.0, night(8)), row(2, "dark", None, 100, 50, -10.0, night(7)), row(3, "dark", None, 100, 50, -10.0, night(1)), row(4, "dark", None, 200, 50, -10.0, night(7)),
        row(5, "dark", None, 100, 50, -12.5, night(7)), row(6, "master", "dark", None, None, -10.0, night(5)), row(7, "bias", None, 100, 50, -10.0, night(7)), row(8, "dark", None, 100, 50, -10.0, (None, None)),
    ]
    schema = "frame_id long, image_type string, master_of string, date_obs_utc timestamp_ntz, session_night date, camera_id int, rig_id int, filter_id int, gain int, offset_adu int, binx int, biny int, readout_mode string, set_temp_c double, exposure_s double, rotator_deg double"
    df = spark.createDataFrame(rows, schema)
    dark = match.DEFAULT_RULES[0]
    got = match.match(df, dark, 10).orderBy("rank").collect()
    assert [r.frame_id for r in got] == [6, 2, 3, 8] and got[0].total == 4
    assert got[1].reason == "dark · binx 1, biny 1, camera_id 1, exposure_s 300±5, gain 100, offset_adu 50, set_temp_c -10±1 · 1 day(s) from light"  # fields in the order of their names
    assert [r.frame_id for r in match.match(df, dark, 10, undated_first=True).orderBy("rank").collect()] == [6, 8, 2, 3]
    assert match.warnings(df, match.DEFAULT_RULES[3]).first().warning == "no matching darkflat frames found"
    assert match.Rule.from_json("r", "dark", {"gain": {"exact": True, "null_ok": True}, "set_temp_c": {"tol": 2}, "zzz": "exact", "binx": "exact"}).spec == {"gain": "null_ok", "set_temp_c": 2.0, "binx": "exact"}


def test_runs(spark):
    t = dt.datetime(2025, 1, 1, 20)
    rows = [(i, 1, f, t + dt.timedelta(minutes=m), dt.date(2025, 1, 1)) for i, (f, m) in enumerate([(None, 0), (None, 45), (None, 91), (2, 0), (2, 200)])]
    got = cluster.runs(spark.createDataFrame(rows, "frame_id long, rig_id int, filter_id int, date_obs_utc timestamp_ntz, session_night date")).collect()
    assert sorted((r.filter_id or 0, r.n) for r in got) == [(0, 1), (0, 2), (2, 1), (2, 1)]


def test_moves_and_guard(spark):
    gone = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, ""), (5, "e")], "file_id long, content_key string")
    new = spark.createDataFrame([(11, "a"), (12, "b"), (14, ""), (15, "e"), (16, "e")], "file_id long, content_key string")
    assert [tuple(r) for r in archive.moves(gone, new).collect()] == [(1, 11)]
    files = lambda sizes: spark.createDataFrame([(r, "ok") for r, n in sizes.items() for _ in range(n)] + [(9, "missing")], "root_id int, file_status string")
    safe = archive.mount_guard(files({1: 5, 2: 4, 3: 5, 5: 1}).where("root_id < 9"), files({1: 10, 2: 10, 3: 11, 4: 2})).collect()
    assert {r.root_id: r.safe for r in safe} == {1: True, 2: False, 3: True, 4: False, 5: True, 9: True}


def test_sweep(spark):
    """Two sweeps: new, changed, bad, settling, moved, ambiguous, deleted files; a root that came up empty stays as it is."""
    now, old = dt.datetime(2025, 1, 1, 12), dt.datetime(2024, 12, 1)
    place = "root_id int, rel_path string, size_bytes long, mtime_utc timestamp_ntz"
    known = spark.createDataFrame([
        (1, 1, "same", 5, old, "ok", old, "a"), (2, 1, "changed", 5, old, "ok", old, "b"), (3, 1, "gone", 5, old, "ok", old, "c"), (4, 1, "from", 5, old, "ok", old, "d"), (5, 1, "twin1", 5, old, "ok", old, "e"),
        (6, 1, "settling", 5, old, "ok", old, "f"), (7, 1, "lost before", 5, old, "missing", old, "g"), (8, 2, "x", 5, old, "ok", old, "h"), (9, 2, "y", 5, old, "ok", old, "i"),
    ], "file_id long, " + place + ", file_status string, last_seen_utc timestamp_ntz, content_key string")
    listing = spark.createDataFrame([(1, p, n, t) for p, n, t in (("same", 5, old), ("changed", 6, old), ("to", 5, old), ("twin2", 5, old), ("twin3", 5, old), ("settling", 7, now), ("bad", 1, old), ("fresh", 1, now))], place)
    read = spark.createDataFrame([(1, "changed", "b2", None), (1, "to", "d", None), (1, "twin2", "e", None), (1, "twin3", "e", None), (1, "bad", None, "no image")], "root_id int, rel_path string, content_key string, error string")
    after = archive.sweep(listing, known, read, F.lit(now))
    got = {r.rel_path: r for r in after.collect()}
    assert {p: (r.outcome, r.file_status) for p, r in got.items()} == {
        "same": ("skip", "ok"), "changed": ("update", "ok"), "gone": ("missing", "missing"), "to": ("moved", "ok"), "twin1": ("missing", "missing"), "twin2": ("add", "ok"), "twin3": ("add", "ok"),
        "settling": ("settling", "ok"), "lost before": ("kept", "missing"), "x": ("kept", "ok"), "y": ("kept", "ok"), "bad": ("error", "error"),
    }
    assert got["to"].file_id == 4 and got["changed"].file_id == 2 and got["changed"].size_bytes == 6 and got["settling"].size_bytes == 5 and got["same"].last_seen_utc == now
    again = {r.rel_path: r.outcome for r in archive.sweep(listing, after.drop("outcome"), read, F.lit(now)).collect()}
    assert all(again[p] == "skip" for p in ("same", "changed", "to", "twin2", "twin3")) and again["bad"] == "error" and again["gone"] == "kept"


def test_header_mapping(spark):
    words = spark.createDataFrame([(1, "gain", "GAIN", 1, False)], "id int, field string, keyword string, priority int, enabled boolean")
    rules = spark.createDataFrame([], "id int, field string, raw_value string, normalized string, match_mode string, priority int")
    assert headers.load_mapping(words, rules) == headers.DEFAULT_MAPPING
    assert source.parse_card("HIERARCH ESO DET CHIP1 = 'CCD-44' / name".ljust(80)) == ("ESO DET CHIP1", "CCD-44", "name")


def test_sites(spark):
    """Clusters one place after another, and the nearest site within a distance, by definition; near a pole and across 180 degrees too."""
    import math

    def metres(a, b):
        h = math.sin(math.radians(a[0] - b[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(a[1] - b[1]) / 2) ** 2
        return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))

    rnd = random.Random(3)
    places = [(i, rnd.choice((10, 10, -60, 89.9, -89.95)) + rnd.uniform(-0.01, 0.01), rnd.choice((20, 179.999, -179.999)) + rnd.uniform(-0.001, 0.001)) for i in range(300)] + [(300, 95.0, 0.0), (301, None, 1.0)]
    df = spark.createDataFrame(places, "frame_id long, lat double, lon double")
    found = []
    for _, *p in places[:300]:
        near = next((c for c in found if metres(c, p) <= 400), None)
        if near:
            near[0], near[1], near[2] = (near[0] * near[2] + p[0]) / (near[2] + 1), (near[1] * near[2] + p[1]) / (near[2] + 1), near[2] + 1
        else:
            found.append([*p, 1])
    assert [v for r in cluster.site_clusters(df, 400.0).orderBy("cluster").collect() for v in (r.n, r.lat, r.lon)] == pytest.approx([v for c in found for v in (c[2], c[0], c[1])])
    sites = [(1, 10.0, 20.0), (2, 10.0, 179.9999), (3, 89.9, -20.0), (4, -60.0, -179.9995), (5, -89.95, 100.0)]
    for reach in (300.0, 5000.0, 900_000.0):
        want = {i: min(((metres((y, x), s[1:]), s[0]) for s in sites if metres((y, x), s[1:]) <= reach), default=(0, None))[1] for i, y, x in places[:300]}
        got = cluster.sites_within(df.where("frame_id < 300"), spark.createDataFrame(sites, "site_id int, lat double, lon double"), reach)
        assert {r.frame_id: r.site_id for r in got.collect()} == want
    cards = spark.createDataFrame([(1, 0, "SITELAT", "+10 30 00"), (1, 1, "SITELONG", "-20.5"), (2, 0, "SITELAT", "1")], "frame_id long, ord int, keyword string, value string")
    assert [tuple(r) for r in cluster.frame_places(cards, ["LAT-OBS", "SITELAT"], ["SITELONG"]).collect()] == [(1, 10.5, -20.5)]


def test_saved_run_and_night_offset(spark):
    saved = spark.createDataFrame([("a", None, None), ("b", None, 3)], "name string, last_run_at timestamp_ntz, last_count long")
    now = dt.datetime(2025, 1, 1)
    out = {r.name: (r.last_run_at, r.last_count) for r in actions.saved_run(saved, "a", spark.range(7), F.lit(now)).collect()}
    assert out == {"a": (now, 7), "b": (None, 3)}
    sites = spark.createDataFrame([(1, -7.0), (2, None)], "site_id int, utc_offset_hours double")
    assert [archive.night_offset(sites, s) for s in (1, 2, 3, None)] == [-7.0, 0.0, 0.0, 0.0]


def test_due_roots(spark):
    now = dt.datetime(2025, 1, 1, 12)
    rows = [(1, True, 60, None), (2, True, 60, now - dt.timedelta(minutes=59)), (3, True, 60, now - dt.timedelta(minutes=61)), (4, False, 60, None), (5, True, 0, None)]
    df = spark.createDataFrame(rows, "root_id int, enabled boolean, interval_minutes int, last_scan_utc timestamp_ntz")
    assert [r.root_id for r in archive.due_roots(df, F.lit(now).cast("timestamp_ntz")).collect()] == [1, 3]


def test_site_clusters_by_regions(spark):
    """Places close to the edge of moving clusters, in several regions of which some touch, a pole and 180 degrees: equal to single steps, in more than one task."""
    import numpy as np

    rnd = random.Random(5)
    spots = [(10, 20), (10.004, 20.003), (10, 20.02), (10, 60), (-35, 60), (50, 179.9958), (50, -179.9995), (50, -179.99), (89.99, 0), (89.99, 120), (0, 0)]
    places = [(i, *(c + rnd.uniform(0, 0.004) for c in rnd.choice(spots))) for i in range(12_000)]
    lat, lon, n = [], [], []
    for _, y, x in places:
        near = np.flatnonzero(cluster._metres(np.array(lat), np.array(lon), np.array(y), np.array(x)) <= 250)
        if len(near):
            k = near[0]
            lat[k], lon[k], n[k] = (lat[k] * n[k] + y) / (n[k] + 1), (lon[k] * n[k] + x) / (n[k] + 1), n[k] + 1
        else:
            lat, lon, n = [*lat, y], [*lon, x], [*n, 1]
    df = spark.createDataFrame(places, "frame_id long, lat double, lon double")
    assert [tuple(r) for r in cluster.site_clusters(df, 250.0).orderBy("cluster").collect()] == list(zip(range(len(n)), n, lat, lon))
    regions = cluster._regions(df, 250.0).groupBy("_band", "_part").count().collect()
    assert len(regions) == 7 and max(r["count"] for r in regions) < 5000  # three at 10 degrees, where two spots touch; one at 50; the pole
    assert cluster.site_clusters(df.where("false")).count() == 0
    assert [tuple(r) for r in cluster.site_clusters(df.where("lat > 89"), 900_000.0).collect()][0][:2] == (0, df.where("lat > 89").count())


def test_site_coverage_folds_once(spark):
    """Regions also where the distance is large, places folded once, and clusters without a site kept."""
    df = spark.range(2000).selectExpr("id as frame_id", "(id % 5) * 10 - 20 + id / 1000000 as lat", "(id % 3) * 60 - 60 + id / 1000000 as lon")
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.1), (3, -20.0, -60.0)], "site_id int, lat double, lon double")
    assert cluster._regions(df, 600_000.0).select("_band", "_part").distinct().count() == 3
    out = cluster.site_coverage(df, sites, 600_000.0)
    got = {r.cluster: r.site_id for r in out.collect()}
    want = {r.cluster: r.site_id for r in cluster.sites_within(cluster.site_clusters(df, 600_000.0), sites, 600_000.0, key="cluster").collect()}
    assert got == want and len(got) == 15 and sorted(v for v in got.values() if v) == [1, 3]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_matching_groups_grow_with_frames(spark, monkeypatch):
    """More frames make more groups, not larger ones, with the same matches; ranks and totals share a sort, in as many tasks as are asked for."""
    rnd = random.Random(11)
    at = lambda: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=rnd.randrange(30 * 86_400))
    rows = [(i, rnd.choice(("light", "flat", "master")), "flat", t := at(), t.date(), rnd.randrange(3), rnd.choice((None, 0, 1)), 1, 1, rnd.choice((None, 10, 14, 90))) for i in range(3000)]
    frames = spark.createDataFrame(rows, "frame_id long, image_type string, master_of string, date_obs_utc timestamp_ntz, session_night date, rig_id int, filter_id int, binx int, biny int, rotator_deg int")
    rule = next(r for r in match.DEFAULT_RULES if r.target == "flat")
    found = []
    for group, n in ((50_000, 16), (20, 150)):
        monkeypatch.setattr(match, "GROUP", group)
        assert match._groups(frames).first().groups == n
        out = match.match(frames, rule, 5)
        found.append(sorted(tuple(r) for r in out.select("light_id", "rank", "frame_id", "total").collect()))
    assert found[0] == found[1] and len(found[0]) > 1000
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("row_number()" in x and "sum(cnt" in x for x in plan)
    assert sum("RepartitionByExpression" in x and x.rstrip().endswith(", 16") for x in plan) >= 4


def test_candidates_are_repeated_in_tasks_only(spark):
    """A candidate goes to a block of profiles once, with those that it fits; all rules read the frames together, and moments outside a block's times ask nothing."""
    kind = "element_at(array('light', 'dark', 'master', 'flat', 'bias'), cast(id % 5 + 1 as int)) as image_type"
    frames = spark.range(5000).selectExpr(
        "id as frame_id", kind, "'dark' as master_of", "timestamp_ntz '2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as date_obs_utc", "date '2025-01-01' as session_night",
        "1 as camera_id", "1 as rig_id", "cast(null as int) as filter_id", "if(id % 5 = 2, null, 100) as gain", "50 as offset_adu", "1 as binx", "1 as biny", "cast(null as string) as readout_mode", "-10 as set_temp_c", "id % 97 as exposure_s", "id % 31 as rotator_deg",
    )
    lights = frames.where("image_type = 'light'")
    asks, entries = match._sides(frames, [(match.DEFAULT_RULES[0], lights)])
    got = entries.selectExpr("count(*) as n", "sum(size(ps)) as fits", "count(distinct id) as ids").first()
    want = frames.where("image_type in ('dark', 'master')").select(F.col("exposure_s").alias("x")).join(lights.select("exposure_s").distinct(), F.abs(F.col("exposure_s") - F.col("x")) <= 5).count()
    assert (got.ids, got.fits) == (2000, want) and got.n < 2 * got.ids < got.fits / 5
    assert asks.count() == asks.where("role = 'near'").count() == lights.count()
    plan = match.match_all(frames, limit=1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") <= 20


def test_detail_in_as_many_tasks_as_asked_for(spark):
    """The tables of many frames meet in four times the tasks of a shuffle; those of a few broadcast ones as they are read."""
    from skyquarry.operators import views

    frames = spark.range(2000).selectExpr("id as frame_id", "concat('f', id) as name")
    cards = spark.range(6000).selectExpr("id div 3 as frame_id", "cast(id % 3 as int) as ord", "'K' as keyword", "cast(id as string) as value")
    tags = spark.createDataFrame([(1, "a")], "id int, name string")
    held = frames.where("frame_id % 2 = 0").selectExpr("frame_id", "1 as tag_id")
    ids = frames.where("frame_id % 5 = 0").select("frame_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold, tasks in (("-1", 16), (before, None)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            out = views.detail(frames, cards, held, tags, ids).select("frame_id", "header", "tags", F.spark_partition_id().alias("task")).collect()
            assert {r.frame_id: ([c.value for c in r.header], r.tags) for r in out} == {i: ([str(3 * i + j) for j in range(3)], None if i % 2 else ["a"]) for i in range(0, 2000, 5)}
            assert tasks is None or len({r.task for r in out}) == tasks
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
