"""What the jobs' command lines share: config files, log lines and a session of their own."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"cytoframe.jobs.{name}")


def read_config(spark: SparkSession, path: str, known: dict) -> dict:
    """The JSON object in a file over the defaults; a name that no default has is an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    return known | given


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at a path, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def command_line(doc: str, paths: tuple[str, ...], defaults: dict, work: Callable) -> None:
    """Runs work(spark, *paths, **settings) with a session that this alone creates and stops."""
    parser = argparse.ArgumentParser(description=doc)
    parser.add_argument("--config", help="a JSON file of settings: " + ", ".join(f"{k} ({v})" for k, v in defaults.items()))
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(work.__module__).getOrCreate()
    try:
        settings = read_config(spark, args.config, defaults) if args.config else defaults
        work(spark, *[getattr(args, p) for p in paths], **settings)
    finally:
        spark.stop()
