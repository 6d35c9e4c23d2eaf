"""The item catalogue: its columns and the scoped scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Columns that a snapshot brings and that an update overwrites.
SNAPSHOT_COLUMNS = (
    "guid string, tmdb_id bigint, imdb_id string, tvdb_id bigint, item_type string, "
    "title string, sort_title string, year int, added_at bigint, updated_at bigint, "
    "duration_ms bigint, parent_key string, season_number int, episode_number int, "
    "child_count int, leaf_count int, viewed_leaf_count int, part_id string, "
    "source_path string, local_path string, path_status string, file_size bigint, "
    "file_mtime bigint, file_fp string"
)
CATALOGUE_SCHEMA = (
    "item_id string, library_key string, rating_key string, " + SNAPSHOT_COLUMNS
    + ", first_seen bigint, last_seen bigint, seen_run bigint, deleted_at bigint"
)


def in_scope(libraries=(), types=("movie",)) -> Column:
    """Live items of the given libraries and types; an empty list does not restrict."""
    test = F.col("deleted_at").isNull()
    if types:
        test = test & F.col("item_type").isin(*types)
    if libraries:
        test = test & F.col("library_key").isin(*libraries)
    return test


def scope(items: DataFrame, libraries=(), types=("movie",)) -> DataFrame:
    return items.filter(in_scope(libraries, types))


def write(items: DataFrame, path: str, sort_by: tuple[str, ...] = ("rating_key",)) -> None:
    """Store the catalogue by library and type, so that a scoped scan reads only its folders.

    Rebalancing packs small libraries into few files and splits a large one; sorting gives
    the row groups narrow value ranges.
    """
    layout = ["library_key", "item_type"]
    (
        items.hint("rebalance", *layout).sortWithinPartitions(*layout, *sort_by)
        .write.mode("overwrite").partitionBy(*layout).parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    # Keys that look like numbers stay texts.
    schema = spark.read.parquet(path).schema
    for name in ("library_key", "item_type"):
        schema[name].dataType = T.StringType()
    return spark.read.schema(schema).parquet(path)
