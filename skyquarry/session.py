"""A session with the settings that the engine expects; an existing one is used as it is."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "skyquarry", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own in the one that driver and executors share (spark.checkpoint.dir); on a single machine without one, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='skyquarry-')}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
