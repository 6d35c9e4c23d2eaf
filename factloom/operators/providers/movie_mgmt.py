"""Facts from a movie automation service: how a file was acquired."""

from pyspark.sql import functions as F

from ...functions.joins import left_lookup, resolve_name, resolve_names
from ...functions.scalars import emitted, epoch, filled, non_null, or_empty, truthy, yes
from ...functions.spec import date, enum, flag, measure, text, words
from ...sources.payloads import FILE_SCHEMA, MOVIE_SCHEMA, parse
from .base import Provider


def _newest(found, id_column, field, order="seq"):
    """One parsed payload per external id, the last one."""
    return (
        found.select(F.col(f"doc.{field}").alias(id_column), "doc", order)
        .filter(truthy(F.col(id_column)))
        .groupBy(id_column).agg(F.max_by("doc", order).alias("doc"))
    )


class MovieMgmt(Provider):
    id = "radarr"
    max_age_s = 6 * 3600
    # Keys, types, enum values.
    facts = (
        flag("radarr.managed"),
        text("radarr.quality_profile"),
        text("radarr.quality"),
        enum("radarr.source", "bluray", "webdl", "webrip", "dvd", "tv", "telecine", "telesync",
             "cam", "workprint", "unknown"),
        measure("radarr.resolution", unit="p"),
        flag("radarr.remux"),
        words("radarr.custom_formats"),
        measure("radarr.custom_format_score"),
        flag("radarr.cutoff_unmet"),
        text("radarr.release_group"),
        text("radarr.edition", folded=True),
        flag("radarr.proper_repack"),
        words("radarr.tags"),
        text("radarr.root_folder"),
        flag("radarr.monitored"),
        enum("radarr.movie_status", "tba", "announced", "inCinemas", "released", "deleted"),
        measure("radarr.size_on_disk", unit="bytes"),
        date("radarr.added"),
        text("radarr.studio"),
        text("radarr.certification"),
    )

    def ineligible(self):
        return F.when(~yes(truthy(F.col("tmdb_id"))), "no film id to match by")

    def vocabulary(self, sources):
        def named(table):
            return sources[table].select(F.col("name").alias("value")).filter("value != ''")

        return {
            "radarr.quality_profile": named("profiles"), "radarr.tags": named("tags"),
            **({"radarr.custom_formats": named("formats")} if "formats" in sources else {}),
        }

    def compute(self, items, sources):
        """``movies`` and ``files``: (payload, seq); ``profiles`` and ``tags``: (id, name).

        Without ``files`` the copy embedded in the movie is used.
        """
        movies = _newest(parse(sources["movies"], MOVIE_SCHEMA), "tmdb_id", "tmdbId")
        found = left_lookup(items, movies, ["tmdb_id"], "item_id").withColumn(
            "file_id", F.when(truthy(F.col("doc.movieFileId")), F.col("doc.movieFileId")))
        embedded = F.col("doc.movieFile")
        if "files" in sources:
            files = _newest(parse(sources["files"], FILE_SCHEMA), "file_id", "id")
            found = left_lookup(found, files.withColumnRenamed("doc", "_file"), ["file_id"],
                                "item_id")
            embedded = F.coalesce(F.col("_file"), embedded)
        found = found.withColumn("file", embedded).withColumns({
            "_tag_ids": F.col("doc.tags"), "_profile_id": F.col("doc.qualityProfileId")})
        found = resolve_names(found, "item_id", "_tag_ids", "_tags", sources["tags"])
        found = resolve_name(found, "item_id", "_profile_id", "_profile", sources["profiles"])

        movie, file = F.col("doc"), F.col("file")
        quality, revision = file["quality"]["quality"], file["quality"]["revision"]
        # An empty object is no file detail.
        detailed = F.to_json(file) != "{}"
        managed = movie.isNotNull()

        made = {
            "radarr.managed": managed,
            "radarr.quality_profile": filled(F.col("_profile")),
            "radarr.monitored": emitted(managed, yes(movie["monitored"])),
            "radarr.movie_status": filled(movie["status"]),
            "radarr.size_on_disk": movie["sizeOnDisk"],
            "radarr.root_folder": filled(movie["rootFolderPath"]),
            "radarr.studio": filled(movie["studio"]),
            "radarr.certification": filled(movie["certification"]),
            "radarr.tags": emitted(managed, F.col("_tags")),
            "radarr.added": epoch(movie["added"]),
            "radarr.quality": filled(quality["name"]),
            "radarr.source": filled(quality["source"]),
            "radarr.resolution": quality["resolution"],
            "radarr.remux": emitted(detailed, yes(quality["modifier"] == "remux")),
            "radarr.proper_repack": emitted(
                detailed, yes(revision["isRepack"]) | yes(revision["version"] > 1)),
            "radarr.custom_formats": emitted(detailed, F.array_sort(or_empty(non_null(
                F.transform(file["customFormats"], lambda c: c["name"]))))),
            "radarr.custom_format_score": emitted(
                detailed, F.coalesce(file["customFormatScore"], F.lit(0))),
            "radarr.cutoff_unmet": emitted(detailed, yes(file["qualityCutoffNotMet"])),
            "radarr.release_group": filled(file["releaseGroup"]),
            "radarr.edition": emitted(
                detailed, F.lower(F.trim(F.coalesce(file["edition"], F.lit(""))))),
        }
        return self.results(found, made)
