"""External JSON payloads kept as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The fields read from each kind of payload.
FILE_SCHEMA = (
    "id BIGINT, edition STRING, releaseGroup STRING, "
    "customFormats ARRAY<STRUCT<name: STRING>>, customFormatScore INT, "
    "qualityCutoffNotMet BOOLEAN, "
    "quality STRUCT<quality: STRUCT<name: STRING, source: STRING, resolution: INT, "
    "modifier: STRING>, revision: STRUCT<version: INT, isRepack: BOOLEAN>>"
)
MOVIE_SCHEMA = (
    "id BIGINT, tmdbId BIGINT, qualityProfileId BIGINT, monitored BOOLEAN, status STRING, "
    "sizeOnDisk BIGINT, rootFolderPath STRING, studio STRING, certification STRING, "
    f"tags ARRAY<BIGINT>, added STRING, movieFileId BIGINT, movieFile STRUCT<{FILE_SCHEMA}>"
)
SERIES_SCHEMA = (
    "id BIGINT, tvdbId BIGINT, qualityProfileId BIGINT, monitored BOOLEAN, status STRING, "
    "ended BOOLEAN, seriesType STRING, network STRING, runtime INT, certification STRING, "
    "rootFolderPath STRING, genres ARRAY<STRING>, tags ARRAY<BIGINT>, "
    "ratings STRUCT<value: DOUBLE>, originalLanguage STRUCT<name: STRING>, added STRING, "
    "firstAired STRING, lastAired STRING, statistics STRUCT<seasonCount: INT, "
    "episodeCount: INT, episodeFileCount: INT, sizeOnDisk: BIGINT, "
    "releaseGroups: ARRAY<STRING>, percentOfEpisodes: DOUBLE>"
)
FILM_SCHEMA = (
    "title STRING, runtime INT, budget BIGINT, revenue BIGINT, vote_average DOUBLE, "
    "vote_count BIGINT, original_language STRING, release_date STRING, adult BOOLEAN, "
    "tagline STRING, belongs_to_collection STRUCT<id: BIGINT, name: STRING>, "
    "genres ARRAY<STRUCT<name: STRING>>, "
    "production_countries ARRAY<STRUCT<iso_3166_1: STRING>>, "
    "keywords STRUCT<keywords: ARRAY<STRUCT<name: STRING>>>"
)
PROBE_SCHEMA = (
    "format STRUCT<duration: STRING, size: STRING, bit_rate: STRING, format_name: STRING>, "
    "streams ARRAY<STRUCT<codec_type: STRING, codec_name: STRING, width: INT, height: INT, "
    "sample_aspect_ratio: STRING, display_aspect_ratio: STRING, color_transfer: STRING, "
    "field_order: STRING, bits_per_raw_sample: STRING, bits_per_coded_sample: STRING, "
    "avg_frame_rate: STRING, r_frame_rate: STRING, channels: INT, tags: MAP<STRING, STRING>, "
    "disposition: MAP<STRING, INT>, "
    "side_data_list: ARRAY<STRUCT<side_data_type: STRING, dv_profile: INT>>>>"
)


def parse(payloads: DataFrame, schema: str, column: str = "payload") -> DataFrame:
    return payloads.withColumn("doc", F.from_json(column, schema))


def fresh_payloads(cache: DataFrame, now: float | Column) -> DataFrame:
    """The latest payload per (provider, cache_key), unless its time to live is over.

    An older payload never stands in for an expired latest one: it was overwritten.
    """
    clock = now if isinstance(now, Column) else F.lit(float(now))
    rest = [c for c in cache.columns if c not in ("provider", "cache_key")]
    latest = cache.groupBy("provider", "cache_key").agg(
        F.max_by(F.struct(*rest), F.col("fetched_at")).alias("last"))
    return latest.filter(
        clock - F.col("last.fetched_at") <= F.col("last.ttl_s")
    ).select("provider", "cache_key", *[f"last.{c}" for c in rest])


def keyed(payloads: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """One row per external id: the last by ``order_col``. Rows without an id are dropped."""
    rest = [c for c in payloads.columns if c != id_col]
    kind = dict(payloads.dtypes)[id_col]
    has_id = F.col(id_col).isNotNull() & (
        F.col(id_col) != ("" if kind == "string" else 0))
    return (
        payloads.filter(has_id).groupBy(id_col)
        .agg(F.max_by(F.struct(*rest), F.col(order_col)).alias("last"))
        .select(id_col, *[f"last.{c}" for c in rest])
    )


def wanted(details: DataFrame, detail_id: str, owners: DataFrame, ref: str) -> DataFrame:
    """Only the detail rows that an owner refers to."""
    refs = owners.filter(F.col(ref).isNotNull()).select(F.col(ref).alias(detail_id))
    return details.join(refs, detail_id, "left_semi")
