"""File manifests and fingerprints."""

from __future__ import annotations

import contextlib
import fnmatch
import hashlib
import itertools
import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import shared_folder

CHUNK = 1024 * 1024


def manifest(spark: SparkSession, root: str, pattern: str = "*", mounted: bool = False) -> DataFrame:
    """(path, size, mtime) of the files below ``root``. No file is opened.

    Works on any file system Spark reads; that source leaves out empty files. A ``mounted``
    root, a folder that all executors see, is walked instead, empty files included.
    """
    if mounted:
        return walk(spark, root, pattern)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    )
    return files.select(
        F.regexp_replace("path", "^file:(//)?", "").alias("path"),
        F.col("length").alias("size"),
        F.unix_timestamp("modificationTime").alias("mtime"),
    )


ENTRY = "path string, size bigint, mtime bigint, folder boolean"


def walk(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size, mtime) of all files below a mounted folder, hidden ones left out.

    Level by level: the folders of a level are dealt over the tasks, each lists its own. Levels
    are tables in the shared folder. Links to folders are not followed; a folder that is gone or
    closed to the executors has no entries.
    """
    root = "/" + re.sub("^file:", "", root).strip("/")
    place = f"{shared_folder(spark).rstrip('/')}/walk-{uuid.uuid4().hex}"
    level = spark.createDataFrame([(root,)], "path string")
    found = None
    for depth in itertools.count():
        path = f"{place}/{depth}"
        level.mapInPandas(_listed, ENTRY).write.parquet(path)
        entries = spark.read.schema(ENTRY).parquet(path)
        found = entries if found is None else found.unionByName(entries)
        folders = entries.filter("folder").select("path")
        many = folders.count()
        if not many:
            break
        level = folders.repartition(min(many, 10_000))
    return found.filter(~F.col("folder") & F.regexp_extract("path", "[^/]*$", 0).rlike(fnmatch.translate(pattern))).drop("folder")


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for folder in batch["path"]:
            rows = []
            with contextlib.suppress(OSError), os.scandir(folder) as entries:
                for entry in entries:
                    if entry.name.startswith("."):
                        continue
                    about = entry.stat()
                    rows.append((entry.path, about.st_size, int(about.st_mtime), entry.is_dir(follow_symlinks=False)))
            yield pd.DataFrame(rows, columns=["path", "size", "mtime", "folder"])


def stat(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, size, mtime) of those paths that exist, asked from the executors.

    The paths must be on a mount that all executors share.
    """
    distinct = paths.select(F.col(path).alias("path")).filter("path IS NOT NULL").distinct()
    return distinct.mapInPandas(_stat_batches, "path string, size bigint, mtime bigint")


def _stat_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path in batch["path"]:
            try:
                found = os.stat(path)
            except OSError:
                continue
            rows.append((path, found.st_size, int(found.st_mtime)))
        yield pd.DataFrame(rows, columns=["path", "size", "mtime"])


def with_fingerprint(files: DataFrame, deep: bool = False) -> DataFrame:
    """Adds ``file_fp``: sha1 of ``path|size|mtime``.

    ``deep`` also reads the first MiB of each file, and the last one of files larger than
    2 MiB. The files must be readable at ``path`` from the executors (a shared mount);
    one that is not keeps the plain fingerprint.
    """
    identity = F.concat_ws("|", "path", F.col("size").cast("string"),
                           F.col("mtime").cast("string"))
    if not deep:
        return files.withColumn("file_fp", F.sha1(identity))
    schema = T.StructType([*files.schema.fields, T.StructField("file_fp", T.StringType())])
    return files.mapInPandas(_fingerprint_bodies, schema)


def _fingerprint_bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(file_fp=[
            _fingerprint_body(*row)
            for row in zip(batch["path"], batch["size"], batch["mtime"])
        ])


def _fingerprint_body(path: str, size: int, mtime: int) -> str:
    digest = hashlib.sha1(f"{path}|{size}|{mtime}".encode())
    try:
        with open(path, "rb") as body:
            samples = [body.read(CHUNK)]
            if size > 2 * CHUNK:
                body.seek(-CHUNK, 2)
                samples.append(body.read(CHUNK))
    except OSError:
        samples = []
    for sample in samples if size > 0 else []:
        digest.update(sample)
    return digest.hexdigest()
