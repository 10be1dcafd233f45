"""What the jobs share: options, logs, and the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def report(job: str, **facts) -> dict:
    """Logs facts of a run as one line of JSON and returns them."""
    log.info(json.dumps({"job": job, **facts}, ensure_ascii=False))
    return facts


def known(config: dict, defaults: dict) -> dict:
    """defaults with what config sets; a name that is none of theirs is an error."""
    if wrong := sorted(config.keys() - defaults.keys()):
        raise ValueError(f"unknown settings: {wrong}; there are {sorted(defaults)}")
    return defaults | config


def main(job: str, about: str, paths: dict[str, str], run: Callable[..., dict]) -> None:
    """The command line of a job: an option for each path and one for a config file. It alone starts and stops a session."""
    ask = argparse.ArgumentParser(prog=f"python -m jobs.{job}", description=about)
    for name, what in paths.items():
        ask.add_argument(f"--{name}", required=True, help=what)
    ask.add_argument("--config", required=True, help="a JSON file, read by Spark, so it may be remote")
    given = vars(ask.parse_args())
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        text = "".join(r["value"] for r in spark.read.text(given.pop("config"), wholetext=True).collect())  # one small file
        run(spark, **given, config=json.loads(text))
    finally:
        spark.stop()
