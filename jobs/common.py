"""What the jobs share: arguments, config files, tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def arguments(what: str, *paths: str, argv: list[str] | None = None) -> tuple[argparse.Namespace, dict[str, Any]]:
    """--config and a path for each name; -> the paths and the config file's content."""
    p = argparse.ArgumentParser(description=what)
    for name in paths:
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", required=True, help="JSON file of settings")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config, encoding="utf-8") as f:
        return args, json.load(f)


def session(name: str) -> SparkSession:
    """For the command line; master and resources come from spark-submit."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def read_or_none(spark: SparkSession, schema: str, path: str) -> DataFrame | None:
    """A Parquet table, or None where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
