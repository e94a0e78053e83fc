"""Queries meet all rows of their inputs, not a part of them."""

import os
from types import SimpleNamespace

from pyspark.sql import functions as F

from skyquarry.model import Archive
from skyquarry.operators import archive
from skyquarry.queries import QUERIES, max_version

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_content_keys_hold_every_event(spark):
    got = {r.file_id: r.n for r in QUERIES["content_keys"](spark, SF).select("file_id", F.size(F.split("content_key", ";")).alias("n")).collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_type is not null")
    assert got == {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}


def test_content_key_by_blocks(spark):
    rows = [(1, i, f"f{i}" if i % 3 else None) for i in range(20, -1, -1)] + [(1, 30, ""), (2, 0, None), (3, 40, "b"), (3, 40, "a"), (3, None, "n"), (3, -1, "m"), (4, 5, "")]
    df = spark.createDataFrame(rows, "file_id long, hdu long, fingerprint string")
    want = {1: ";".join([f"f{i}" for i in range(21) if i % 3] + [""]), 2: "", 3: "n;m;a;b", 4: ""}
    for block in (1, 3, 4096):
        assert {r.file_id: r.content_key for r in archive.content_key(df, block).collect()} == want


def test_designations_of_every_frame(spark):
    got = {r.frame_id: r.names for r in QUERIES["designations"](spark, SF).collect()}
    ids = [r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()]
    assert sorted(got) == sorted(ids)
    by_name = {n.split(",")[0]: n for n in got.values()}
    assert by_name["M 13"] == "M 13,NGC 6205" and by_name["M 45"] == "M 45" and by_name["M 25"] == "M 25,IC 4725" and by_name[""] == ""


def test_export_paths_of_every_match(spark):
    frames = Archive(spark, SF).v_frames.where("image_type = 'flat' and gain = 200")
    assert QUERIES["export_paths"](spark, SF).count() == frames.count() > 25


def test_max_version_with_and_without_sets(spark):
    sets = Archive(spark, SF).flat_sets
    assert QUERIES["max_version"](spark, SF).first().version == max(r.flat_set_id for r in sets.collect()) > 0
    assert max_version(SimpleNamespace(flat_sets=sets.where("false"))).first().version == 0


def test_content_digest(spark):
    """Equal exactly where the fingerprints of the HDUs are, whatever the order of rows; a hot file needs no more than sums."""
    schema = "file_id long, hdu long, fingerprint string"
    rows = [(1, 0, "a"), (1, 1, "b"), (2, 1, "b"), (2, 0, "a"), (3, 0, "b"), (3, 1, "a"), (4, 0, "a"), (4, 1, "b"), (4, 2, None), (5, 0, None), (6, 0, "a"), (6, 0, "a"), (7, 0, "a"), (8, None, "a"), (9, 0, "")]
    got = {r.file_id: r.content_key for r in archive.content_digest(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == got[2] == got[4] and got[5] == "" and len({got[i] for i in (1, 3, 5, 6, 7, 8, 9)}) == 7
    hot = spark.range(2_000_000).selectExpr("if(id % 3 = 0, 0, id % 1000) as file_id", "id as hdu", "concat('f', id) as fingerprint")
    keys = archive.content_digest(hot)
    assert keys.count() == 1000 and max(len(r.content_key) for r in keys.collect()) < 70
