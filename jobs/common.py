"""What the jobs share: settings by Spark's text reader, a session for the command line, logging."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults, overruled by a JSON file that Spark can read; unknown names are refused."""
    if path is None:
        return dict(defaults)
    given = json.loads(spark.read.text(path, wholetext=True).head()[0])
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}; there are: {', '.join(sorted(defaults))}")
    return {**defaults, **given}


def command(run: Callable[..., object], inputs: list[str], doc: str | None) -> None:
    """Command line: a path for each input, --out, --config. Creates and stops the session."""
    parser = argparse.ArgumentParser(description=doc)
    for name in inputs:
        parser.add_argument(f"--{name}", required=True, help=f"path of the {name} as Parquet")
    parser.add_argument("--out", required=True, help="folder of the output")
    parser.add_argument("--config", help="JSON file of settings")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, **args)
    finally:
        spark.stop()
