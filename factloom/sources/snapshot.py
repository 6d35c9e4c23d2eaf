"""Raw library snapshots, flattened to catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RAW_SCHEMA = (
    "library_key string, item_type string, rating_key string, guid string, "
    "guids array<string>, title string, title_sort string, year int, "
    "added_at bigint, updated_at bigint, duration bigint, "
    "media array<struct<parts: array<struct<id: string, file: string, size: bigint>>>>, "
    "grandparent_key string, parent_index int, index int, child_count int, "
    "leaf_count int, viewed_leaf_count int"
)


def _external_id(guids: Column, scheme: str) -> Column:
    """The rest of the last ``scheme://rest`` entry."""
    mine = F.filter(guids, lambda g: g.startswith(f"{scheme}://"))
    return F.substring_index(F.try_element_at(mine, F.lit(-1)), "://", -1)


def _numeric_id(guids: Column, scheme: str) -> Column:
    """As above, among the entries whose rest is a number."""
    numbers = F.transform(
        F.filter(guids, lambda g: g.startswith(f"{scheme}://")),
        lambda g: F.substring_index(g, "://", -1).try_cast("bigint"))
    return F.try_element_at(F.filter(numbers, lambda n: n.isNotNull()), F.lit(-1))


def largest_part(media: Column) -> Column:
    """The largest media part, the first one on ties. Unknown sizes count as 0."""
    parts = F.flatten(F.transform(
        media, lambda m: F.coalesce(
            m["parts"], F.array().cast("array<struct<id:string,file:string,size:bigint>>"))))
    ranked = F.transform(parts, lambda p, i: F.struct(
        F.coalesce(p["size"], F.lit(0)).alias("size"),
        (-i).alias("place"), p["id"].alias("id"), p["file"].alias("file")))
    return F.array_max(ranked)


def normalize_snapshot(raw: DataFrame) -> DataFrame:
    """Catalogue rows from ``RAW_SCHEMA`` records."""
    episode = F.col("item_type") == "episode"
    show = F.col("item_type") == "show"
    guids = F.coalesce("guids", F.array().cast("array<string>"))
    part = largest_part(F.col("media"))
    return raw.withColumn("_part", part).select(
        "library_key", "rating_key", "guid",
        _numeric_id(guids, "tmdb").alias("tmdb_id"),
        _external_id(guids, "imdb").alias("imdb_id"),
        _numeric_id(guids, "tvdb").alias("tvdb_id"),
        "item_type",
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(untitled)")).alias("title"),
        F.coalesce(F.nullif(F.col("title_sort"), F.lit("")), F.col("title")).alias("sort_title"),
        "year", "added_at", "updated_at", F.col("duration").alias("duration_ms"),
        F.when(episode, F.col("grandparent_key")).alias("parent_key"),
        F.when(episode, F.col("parent_index")).alias("season_number"),
        F.when(episode, F.col("index")).alias("episode_number"),
        F.when(show, F.col("child_count")).alias("child_count"),
        F.when(show, F.col("leaf_count")).alias("leaf_count"),
        F.when(show, F.col("viewed_leaf_count")).alias("viewed_leaf_count"),
        F.col("_part.id").alias("part_id"),
        F.col("_part.file").alias("source_path"),
        F.col("_part.size").alias("source_size"),
    )
