"""Facts from a series automation service."""

from pyspark.sql import functions as F

from ...functions.joins import left_lookup, resolve_name, resolve_names
from ...functions.scalars import emitted, epoch, filled, or_empty, truthy, yes
from ...functions.spec import date, enum, flag, measure, text, words
from ...sources.payloads import SERIES_SCHEMA, parse
from .base import Provider
from .movie_mgmt import _newest


class SeriesMgmt(Provider):
    id = "sonarr"
    max_age_s = 6 * 3600
    applies_to = ("show",)
    # Keys, types, enum values.
    facts = (
        flag("sonarr.managed"),
        measure("sonarr.percent_of_episodes", unit="%"),
        flag("sonarr.incomplete"),
        measure("sonarr.missing_episodes"),
        enum("sonarr.series_type", "standard", "daily", "anime"),
        enum("sonarr.series_status", "continuing", "ended", "upcoming", "deleted"),
        flag("sonarr.ended"),
        text("sonarr.network"),
        text("sonarr.quality_profile"),
        flag("sonarr.monitored"),
        words("sonarr.tags"),
        measure("sonarr.season_count"),
        measure("sonarr.episode_count"),
        measure("sonarr.episode_file_count"),
        measure("sonarr.size_on_disk", unit="bytes"),
        words("sonarr.release_groups"),
        text("sonarr.root_folder"),
        words("sonarr.genres"),
        measure("sonarr.rating"),
        text("sonarr.certification"),
        measure("sonarr.runtime", unit="min"),
        text("sonarr.original_language"),
        date("sonarr.added"),
        date("sonarr.first_aired"),
        date("sonarr.last_aired"),
    )

    def ineligible(self):
        return F.when(~yes(truthy(F.col("tvdb_id"))), "no series id to match by")

    def vocabulary(self, sources):
        def named(table):
            return sources[table].select(F.col("name").alias("value")).filter("value != ''")

        return {"sonarr.quality_profile": named("profiles"), "sonarr.tags": named("tags")}

    def compute(self, items, sources):
        """``series``: (payload, seq); ``profiles`` and ``tags``: (id, name)."""
        series = _newest(parse(sources["series"], SERIES_SCHEMA), "tvdb_id", "tvdbId")
        found = left_lookup(items, series, ["tvdb_id"], "item_id").withColumns({
            "_tag_ids": F.col("doc.tags"), "_profile_id": F.col("doc.qualityProfileId")})
        found = resolve_names(found, "item_id", "_tag_ids", "_tags", sources["tags"])
        found = resolve_name(found, "item_id", "_profile_id", "_profile", sources["profiles"])

        doc = F.col("doc")
        managed, stats = doc.isNotNull(), doc["statistics"]

        def counted(field):
            return F.coalesce(stats[field], F.lit(0))

        expected, have = counted("episodeCount"), counted("episodeFileCount")
        made = {
            "sonarr.managed": managed,
            "sonarr.quality_profile": filled(F.col("_profile")),
            "sonarr.series_type": filled(doc["seriesType"]),
            "sonarr.series_status": filled(doc["status"]),
            "sonarr.ended": emitted(managed, yes(doc["ended"])),
            "sonarr.monitored": emitted(managed, yes(doc["monitored"])),
            "sonarr.network": filled(doc["network"]),
            "sonarr.root_folder": filled(doc["rootFolderPath"]),
            "sonarr.certification": filled(doc["certification"]),
            "sonarr.original_language": filled(doc["originalLanguage"]["name"]),
            "sonarr.runtime": emitted(truthy(doc["runtime"]), doc["runtime"]),
            "sonarr.genres": emitted(managed, or_empty(doc["genres"])),
            "sonarr.tags": emitted(managed, F.col("_tags")),
            "sonarr.rating": F.round(doc["ratings"]["value"], 2),
            "sonarr.added": epoch(doc["added"]),
            "sonarr.first_aired": epoch(doc["firstAired"]),
            "sonarr.last_aired": epoch(doc["lastAired"]),
            "sonarr.season_count": emitted(managed, counted("seasonCount")),
            "sonarr.episode_count": emitted(managed, expected),
            "sonarr.episode_file_count": emitted(managed, have),
            "sonarr.size_on_disk": emitted(managed, counted("sizeOnDisk")),
            "sonarr.release_groups": emitted(
                managed, F.array_sort(or_empty(stats["releaseGroups"]))),
            "sonarr.percent_of_episodes": F.round(stats["percentOfEpisodes"], 1),
            "sonarr.incomplete": emitted(managed, (expected > 0) & (have < expected)),
            "sonarr.missing_episodes": emitted(
                managed, F.greatest(F.lit(0), expected - have)),
        }
        return self.results(found, made)
