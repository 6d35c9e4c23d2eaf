"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.session import CHECKPOINT_DIR, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; without SQL only its rows are checked."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder.

    A local session that names none gets a temporary one, which goes when the process ends.
    """
    if not spark.conf.get(CHECKPOINT_DIR, None) and spark.sparkContext.master.startswith("local["):
        own = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set(CHECKPOINT_DIR, own)
    run = spark.sql("SELECT uuid()").first()[0]
    return f"{shared_folder(spark).rstrip('/')}/{name}-{run}"
