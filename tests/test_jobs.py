"""The jobs over growing and changing copies of their tables, and over odd rows; their queries against the checking database."""

import json
import os

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_queries import norm

from jobs import common, incremental_catalog, queries, sidecar_audit
from skyquarry.operators import rescan
from skyquarry.streaming.snapshot import stored

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    want = db.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(want.fetchall(), names)


def files_of(folder):
    return {os.path.join(p, n): os.stat(os.path.join(p, n)).st_mtime_ns for p, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def whole(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_catalog_grows(spark, tmp_path):
    source, out = f"{tmp_path}/events", f"{tmp_path}/out"
    events = spark.read.parquet(f"{SF}/events.parquet")
    add = lambda df: df.coalesce(1).write.mode("append").parquet(source)
    add(events.where("event_id < 600"))
    assert [(b["add"], b["update"]) for b in incremental_catalog.run(spark, source, SF, out)] == [(600, 0)]
    before = files_of(f"{out}/frames")
    assert incremental_catalog.run(spark, source, SF, out) == [] and files_of(f"{out}/frames") == before  # nothing new
    # new frames, the same ones again, and two that have changed: one moves to a night of its own, one stays in its night
    add(events.where("event_id >= 600"))
    add(events.where("event_id < 50 and event_id not in (7, 9)"))
    add(events.where("event_id = 7").withColumn("ts", F.expr("ts + interval 200 days")))
    add(events.where("event_id = 9").withColumn("value", F.lit(77.0)))
    done = incremental_catalog.run(spark, source, SF, out, {"max_files_per_batch": 10})
    assert [(b["add"], b["update"], b["skip"]) for b in done] == [(len([1 for _ in range(600, events.count())]), 2, 48)]
    changed = events.withColumn("ts", F.expr("if(event_id = 7, ts + interval 200 days, ts)")).withColumn("value", F.expr("if(event_id = 9, 77.0D, value)"))
    changed.write.parquet(f"{tmp_path}/all")
    incremental_catalog.run(spark, f"{tmp_path}/all", SF, f"{tmp_path}/fresh")
    got, want = incremental_catalog.Output(out), incremental_catalog.Output(f"{tmp_path}/fresh")
    assert whole(got.frames.read(spark)) == whole(want.frames.read(spark))
    assert whole(got.nights(spark)) == whole(want.nights(spark))
    # nights without new or changed frames kept their files
    touched = {str(r[0]) for r in got.frames.log(spark, 1).select(F.explode(F.array("session_night", F.coalesce("was", "session_night")))).distinct().collect()}
    kept = {p for p in before if p.split("session_night=")[1].split("/")[0] not in touched}
    assert kept and all(files_of(f"{out}/frames").get(p) == before[p] for p in kept)


def test_catalog_repeats_a_broken_batch(spark, tmp_path):
    """A batch that was written but not marked as done is given again, and gives the same tables."""
    snapshot = incremental_catalog.Output(f"{tmp_path}/out").frames
    events = spark.read.parquet(f"{SF}/events.parquet")
    nation, region = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("nation", "region"))
    first = incremental_catalog.frames_of(events.where("event_id < 100"), nation, region)
    moved = incremental_catalog.frames_of(events.where("event_id between 90 and 120").withColumn("ts", F.expr("ts + interval 1 year")), nation, region)
    snapshot.apply(first, 0)
    touched, actions = snapshot.apply(moved, 1)
    once, nights = whole(snapshot.read(spark)), whole(touched)
    assert actions == {"add": 21, "update": 10, "skip": 0}
    again, actions = snapshot.apply(moved, 1)
    assert whole(snapshot.read(spark)) == once and whole(again) == nights and actions == {"add": 21, "update": 10, "skip": 0}


def test_catalog_of_odd_events(spark, tmp_path):
    rows = "(cast(null as bigint), null, null, null, null, null), (1, timestamp_ntz'2024-01-01 00:00:00', 3, 'view', 1.0D, '{}'), (1, timestamp_ntz'2024-01-01 00:00:00', 3, 'view', 1.0D, '{}'), (2, null, null, null, null, null)"
    spark.sql(f"select * from values {rows} as t(event_id, ts, user_id, event_type, value, props)").withColumn("rig", F.lit("clash")).write.parquet(f"{tmp_path}/events")
    done = incremental_catalog.run(spark, f"{tmp_path}/events", SF, f"{tmp_path}/out")
    got = {r.frame_id: r.session_night for r in incremental_catalog.Output(f"{tmp_path}/out").frames.read(spark).collect()}
    assert done[0]["add"] == len(got) and 1 in got and None not in got
    spark.read.parquet(f"{tmp_path}/events").where("false").write.parquet(f"{tmp_path}/none")
    incremental_catalog.run(spark, f"{tmp_path}/none", SF, f"{tmp_path}/out2")
    assert incremental_catalog.Output(f"{tmp_path}/out2").nights(spark).count() == 0


TEXTS = "doc_id long, text string, lang string, source string, clash string"


def audit(spark, tmp_path, name, rows, now):
    spark.createDataFrame([(*r, "x") for r in rows], TEXTS).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
    swept = sidecar_audit.run(spark, f"{tmp_path}/{name}", f"{tmp_path}/out", {"now": now})
    return swept, {(r.root_id, r.rel_path): r for r in sidecar_audit.copies(spark, f"{tmp_path}/out").collect()}


def test_audit_sweeps_again(spark, tmp_path):
    rows = [(i, f"text {i}\nof a night", "en", "a") for i in range(4)] + [(10, "same words", "en", "b"), (11, "same words", "de", "b"), (12, "same words", "en", "a"), (13, None, None, None), (14, "", "en", "b"), (None, "no place", "en", "a"), (15, "x", "en", "b"), (15, "longer", "en", "b")]
    swept, got = audit(spark, tmp_path, "t1", rows, "2024-02-01 00:00:00")
    assert swept == {"files": 10, "add": 10}
    assert got["/a", "en/doc12.txt"].copies == 3 and got["/a", "en/doc12.txt"].keeper and not got["/b", "de/doc11.txt"].keeper
    assert (got["/b", "de/doc11.txt"].keep_root, got["/b", "de/doc11.txt"].keep_path) == ("/a", "en/doc12.txt")
    assert (got["/a", "en/doc0.txt"].n_lines, got["/a", "en/doc0.txt"].n_words, got["/", "/doc13.txt"].n_words, got["/b", "en/doc15.txt"].size_bytes) == (2, 5, 0, 6)
    assert got["/", "/doc13.txt"].copies == 2 == got["/b", "en/doc14.txt"].copies  # both empty
    before = files_of(f"{tmp_path}/out/files")
    # within the interval nothing is due
    assert audit(spark, tmp_path, "t2", rows[:5], "2024-02-01 00:30:00")[0] == {} and files_of(f"{tmp_path}/out/files") == before
    # a file that is gone, one that has changed, one that has moved
    rows = [r for r in rows if r[0] not in (3, 2)] + [(2, "text 2\nof a night", "fr", "a")]
    rows[0] = (0, "another text", "en", "a")
    swept, got = audit(spark, tmp_path, "t3", rows, "2024-02-01 02:00:00")
    assert swept == {"files": 10, "update": 1, "skip": 7, "moved": 1, "missing": 1}
    assert got["/a", "fr/doc2.txt"].outcome == "moved" and ("/a", "en/doc3.txt") not in got and got["/a", "en/doc0.txt"].n_words == 2
    # another text of the same length, at the same place and time
    rows[1] = (1, "TEXT 1\nof a night", "en", "a")
    swept, got = audit(spark, tmp_path, "t3b", rows, "2024-02-01 03:00:30")
    assert swept == {"files": 10, "update": 1, "skip": 8, "kept": 1} and got["/a", "en/doc1.txt"].outcome == "update"
    # a root that lost more than half of its files is taken for a failed mount
    swept, got = audit(spark, tmp_path, "t4", [r for r in rows if r[3] != "a"] + [rows[1]], "2024-02-01 04:30:00")
    assert swept["kept"] == 4 and "missing" not in swept


def test_failed_sweep_changes_nothing(spark, tmp_path):
    path, now = f"{tmp_path}/files", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    roots = spark.sql("select * from values (1, true, 10), (2, true, 10), (3, false, 10) as t(root_id, enabled, interval_minutes)")
    listing = spark.sql("select cast(id % 3 + 1 as int) as root_id, concat('f', id) as rel_path, id as size_bytes, timestamp_ntz'2024-01-01 00:00:00' as mtime_utc from range(30)")
    read = listing.select("root_id", "rel_path", F.col("rel_path").alias("content_key"), F.lit(None).cast("string").alias("error"))
    assert rescan.sweep_due(spark, path, roots, listing, read, now) == {"files": 20, "add": 20}  # a root that isn't enabled stays out
    before = files_of(path)
    later = F.lit("2024-02-01 01:00:00").cast("timestamp_ntz")
    broken = listing.withColumn("size_bytes", F.expr("if(rel_path = 'f4', raise_error('disk gone'), size_bytes)").cast("long"))
    with pytest.raises(PySparkException):
        rescan.sweep_due(spark, path, roots, broken, read, later)
    assert files_of(path) == before
    assert rescan.sweep_due(spark, path, roots, listing, read, later) == {"files": 20, "skip": 20}
    assert {r[0] for r in stored(spark, path, rescan.files_schema()).select("scanned_utc").distinct().collect()} == {later_value(spark, later)}


def later_value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_empty_texts(spark, tmp_path):
    swept, got = audit(spark, tmp_path, "none", [], "2024-02-01 00:00:00")
    assert swept == {} and got == {}


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"interval_minutes": 5}))
    assert common.settings(spark, str(tmp_path / "c.json"), sidecar_audit.DEFAULTS) == {"interval_minutes": 5, "settle_seconds": 30, "now": ""}
    (tmp_path / "bad.json").write_text(json.dumps({"intervall": 5}))
    with pytest.raises(ValueError):
        common.settings(spark, str(tmp_path / "bad.json"), sidecar_audit.DEFAULTS)
