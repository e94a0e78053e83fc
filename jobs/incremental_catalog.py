"""Keeps the catalogue of frames and its summary by night up to date with a growing folder of events.

    python -m jobs.incremental_catalog EVENTS EQUIPMENT OUT [--config jobs/incremental_catalog.json]

EVENTS: a Parquet folder (or table) to which files are added. EQUIPMENT: the folder of the tables of nations and regions, from which rigs and sites come.
OUT gets `frames` (one row for each frame, partitioned by night), `changes` (what each batch added or changed), `nights` (counts, exposure, first and
last moment by night, type, object, rig and filter; partitioned by night) and `checkpoint`.

A run takes the files that are new since the last one. Frames that are there unchanged are skipped; the nights of new and changed frames, and those that
a changed frame has left, are rewritten, no others. A run that is repeated or was broken off gives the same tables."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobs.common import command_line, settings
from skyquarry.functions import catalogs
from skyquarry.model import relation
from skyquarry.operators import views
from skyquarry.streaming.snapshot import Snapshot, follow, observed, rewrite, stored

LOG = logging.getLogger("skyquarry.jobs.incremental_catalog")
DEFAULTS = {"max_files_per_batch": 1000}
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
FRAMES = "frame_id long, image_type string, object_canonical string, rig string, filter string, exposure_s long, date_obs_utc timestamp_ntz, rel_path string, file_status string, session_night date"
NIGHTS = "image_type string, object_canonical string, rig string, filter string, n long, exposure long, first_utc timestamp_ntz, last_utc timestamp_ntz, session_night date"


@dataclass(frozen=True)
class Output:
    """The tables below a folder."""

    folder: str

    @property
    def frames(self) -> Snapshot:
        schema = StructType.fromDDL(FRAMES)
        same = tuple(n for n in schema.names if n not in ("frame_id", "session_night"))
        return Snapshot(f"{self.folder}/frames", f"{self.folder}/changes", schema, "frame_id", "session_night", same)

    def nights(self, spark: SparkSession) -> DataFrame:
        """The summary; a row with n = 0 only marks a night that has lost its frames."""
        return stored(spark, f"{self.folder}/nights", StructType.fromDDL(NIGHTS)).where("n > 0")


def frames_of(events: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Events as frames with their files and equipment, objects under their canonical names. Of several events with one id the latest counts."""
    spark, rest = events.sparkSession, ["ts", "user_id", "event_type", "value", "props"]
    events = events.groupBy("event_id").agg(F.max(F.struct(*rest)).alias("_row")).select("event_id", "_row.*")
    tables = {"frames": {"events": events}, "files": {"events": events}, "roots": {}, "rigs": {"nation": nation}, "sites": {"region": region}, "cameras": {"nation": nation}, "filters": {}}
    frames = views.v_frames(SimpleNamespace(**{name: relation(spark, name, **given) for name, given in tables.items()}))
    return frames.withColumn("object_canonical", catalogs.object_canonical(F.col("object"))).select(StructType.fromDDL(FRAMES).names)


def run(spark: SparkSession, events: str, equipment: str, out: str, config: dict | None = None) -> list[dict]:
    """One incremental run; what each of its batches read and wrote."""
    config = DEFAULTS | (config or {})
    output, done = Output(out), []

    def handle(batch: DataFrame, number: int) -> None:
        session, written = batch.sparkSession, Observation()
        nation, region = (session.read.parquet(f"{equipment}/{name}.parquet") for name in ("nation", "region"))
        touched, actions = output.frames.apply(frames_of(batch, nation, region), number)
        summary = views.frame_summary(output.frames.within(session, touched)).unionByName(touched.withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True)
        counted = summary.select(StructType.fromDDL(NIGHTS).names).observe(written, F.count_if(F.col("n") > 0).alias("rows"), F.count_if(F.col("n") == 0).alias("nights"))
        rewrite(counted, f"{out}/nights", "session_night")
        wrote = {"rows": 0, "nights": 0} | observed(written)
        done.append({"batch": number, **actions, **wrote})
        LOG.info("batch %d: read %d frames of %s; wrote %d new and %d changed ones to %s/frames and %d rows of %d nights to %s/nights", number, sum(actions.values()), events, actions["add"], actions["update"], out, wrote["rows"], wrote["nights"], out)

    follow(spark, events, EVENTS, f"{out}/checkpoint", handle, config["max_files_per_batch"])
    LOG.info("%d batches of new files in %s", len(done), events)
    return done


def main(argv: list[str] | None = None) -> None:
    arguments = [("events", "Parquet folder of events"), ("equipment", "folder of nation.parquet and region.parquet"), ("out", "folder of the output")]
    command_line(__doc__, arguments, lambda spark, given: run(spark, given.events, given.equipment, given.out, settings(spark, given.config, DEFAULTS)), argv)


if __name__ == "__main__":
    main()
