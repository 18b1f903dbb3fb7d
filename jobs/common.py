"""What the jobs share: the configuration file, the command line, the log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settings(default: str | Path, path: str | None = None, **changes: object) -> dict:
    """The settings of a JSON file (the job's own if none is given), with those changes that aren't None."""
    out = json.loads(Path(path or default).read_text(encoding="utf-8"))
    if unknown := {k for k in changes if k not in out}:
        raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
    return out | {k: v for k, v in changes.items() if v is not None}


def mapped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns that a job works on, each by an SQL expression over the input's."""
    return df.select(*[F.expr(e).alias(c) for c, e in columns.items()])


def told(job: str, **what: object) -> dict:
    logging.getLogger(job).info(" ".join(f"{k}={v}" for k, v in what.items()))
    return what


def main(job: str, default: Path, paths: Sequence[str], work: Callable[..., object], argv: Sequence[str] | None = None) -> None:
    """Reads the command line, runs ``work(spark, *paths, settings)`` in a session of its own and ends that."""
    p = argparse.ArgumentParser(prog=job, description=work.__doc__)
    p.add_argument("--config", help="JSON file with the job's settings")
    for name in paths:
        p.add_argument(f"--{name}", required=True, help="a path of any file system that Spark reads")
    args = vars(p.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    chosen = settings(default, args["config"])
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        work(spark, *[args[n] for n in paths], chosen)
    finally:
        spark.stop()
