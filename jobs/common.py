"""What the command lines share."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

from skyquarry.session import get_session


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The values of a JSON file, read by Spark as its path may be remote, over the defaults; unknown names are refused."""
    if not path:
        return dict(defaults)
    given = spark.read.option("multiLine", True).json(path).first().asDict()
    unknown = sorted(given.keys() - defaults.keys())
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | {k: v for k, v in given.items() if v is not None}


def command_line(doc: str, arguments: list[tuple[str, str]], work: Callable[[SparkSession, argparse.Namespace], None], argv: list[str] | None = None) -> None:
    """Parses plain paths and --config, and runs work in a session that it starts and stops."""
    parser = argparse.ArgumentParser(description=doc)
    for name, text in arguments:
        parser.add_argument(name, help=text)
    parser.add_argument("--config", help="a JSON file of settings")
    given = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = get_session(app=parser.prog)
    try:
        work(spark, given)
    finally:
        spark.stop()
