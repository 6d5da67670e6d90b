"""What both jobs share: their command lines and configuration files."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields
from typing import TypeVar

from pyspark.sql import SparkSession

C = TypeVar("C")


def configured(kind: type[C], text: str) -> C:
    """A configuration from JSON text; names that it doesn't have are errors, and so are values of another kind."""
    given = json.loads(text)
    known = {f.name: f for f in fields(kind)}  # type: ignore[arg-type]
    for name, value in given.items():
        if name not in known:
            raise ValueError(f"{name} is no setting; there are {', '.join(known)}")
        default = known[name].default
        if type(value) is not type(default if not isinstance(default, tuple) else []):
            raise ValueError(f"{name} must be like {default!r}, not {value!r}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def command(name: str, paths: list[str], kind: type[C], run: Callable[..., dict], args: list[str] | None = None) -> int:
    """Run a job from a command line: its paths in order, and --config with a JSON file that Spark can read."""
    top = argparse.ArgumentParser(prog=f"jobs.{name}", description=run.__doc__)
    for p in paths:
        top.add_argument(p)
    top.add_argument("--config", help="JSON file of settings; what it leaves out keeps its default")
    given = vars(top.parse_args(args))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        config = given.pop("config")
        text = spark.read.text(config, wholetext=True).first()["value"] if config else "{}"
        print(json.dumps(run(spark, *given.values(), configured(kind, text))))
    finally:
        spark.stop()
    return 0
