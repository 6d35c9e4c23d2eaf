"""Helpers of the operators: the shared folder, text normalisation, word patterns."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share, named by ``spark.checkpoint.dir``.

    A local session that names none gets a temporary folder; anything else is an error.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="factloom-llm-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set(CHECKPOINT_DIR, folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, path: str) -> DataFrame:
    """``frame`` as a table in the shared folder: lineage ends there."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; NULL as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def opened_folder(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and plain path of a folder in the shared store, for use inside tasks."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path)


def spread(files: DataFrame, count: int, most: int = 10_000) -> DataFrame:
    """A table of files, dealt out so that each task opens few of them."""
    return files.repartition(max(1, min(count, most)))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application.

    Functions that run in Python tasks are found there by name, installed or not.
    """
    context = spark.sparkContext
    if getattr(context, "_factloom_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="factloom-code-"), "factloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._factloom_shipped = True
