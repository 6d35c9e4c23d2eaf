"""Facts that compare what other providers found."""

from pyspark.sql import Column, functions as F

from ...functions.scalars import digest, emitted, truthy
from ...functions.spec import enum, flag, measure
from .base import Provider

# Smallest width of each class, and the other limits.
WIDTHS = ((3000, "4k"), (1800, "1080p"), (1200, "720p"))
SCOPE_RATIO = 2.3
EXTENDED_MINUTES = 5
INPUTS = (
    "video.dar", "video.width", "video.height", "file.bitrate_kbps", "file.duration_s",
    "file.size_bytes", "plex.duration_min", "tmdb.runtime", "tmdb.original_language",
    "tmdb.budget", "tmdb.revenue",
)


def resolution_class(width: Column) -> Column:
    """By width, which matting a film leaves alone. NULL for an unknown or zero width."""
    choice = F
    for least, label in WIDTHS:
        choice = choice.when(width >= least, label)
    return emitted(truthy(width), choice.when(width > 0, "sd").otherwise("other"))


def is_scope(ratio: Column) -> Column:
    return ratio >= SCOPE_RATIO


def bitrate_per_pixel(kbps: Column, width: Column, height: Column) -> Column:
    return emitted(
        truthy(width) & truthy(height) & truthy(kbps),
        F.round(F.try_divide(kbps * 1000, width * height), 6))


def size_per_minute(size_bytes: Column, seconds: Column) -> Column:
    return emitted(
        truthy(size_bytes) & (seconds > 0),
        F.round(F.try_divide(size_bytes / 1_000_000, seconds / 60), 2))


def runtime_drift(seconds: Column, minutes: Column) -> Column:
    return emitted(truthy(minutes) & truthy(seconds), F.round(seconds / 60 - minutes, 2))


def runtime_delta(seconds: Column, minutes: Column, official: Column) -> Column:
    """Against the official runtime; the file's own length goes before the catalogue's."""
    actual = F.when(truthy(seconds), seconds / 60).otherwise(minutes)
    return emitted(truthy(official) & truthy(actual), F.round(actual - official, 2))


def is_foreign(language: Column) -> Column:
    return emitted(language != "", language != "en")


def is_bomb(budget: Column, revenue: Column) -> Column:
    return emitted((budget > 0) & (revenue > 0), revenue < budget)


class Derived(Provider):
    id = "derived"
    depends_on = ("plex", "ffprobe", "tmdb")
    applies_to = ("movie", "episode")
    # Keys, types, enum values.
    facts = (
        measure("derived.bitrate_per_pixel"),
        measure("derived.size_per_minute_mb", unit="MB/min"),
        enum("derived.resolution_class", "sd", "720p", "1080p", "4k", "other", folded=True),
        flag("derived.is_scope"),
        measure("derived.runtime_mismatch_min", unit="min"),
        measure("derived.runtime_vs_tmdb_min", unit="min"),
        flag("derived.is_extended_cut"),
        flag("derived.is_foreign"),
        flag("derived.is_box_office_bomb"),
    )

    def fingerprint(self):
        return digest(*[F.col(key) for key in INPUTS])

    def compute(self, items, sources):
        """Reads the namespaces video, file, plex and tmdb of the items."""
        get = F.col
        values = {
            "derived.resolution_class": resolution_class(get("video.width")),
            "derived.is_scope": is_scope(get("video.dar")),
            "derived.bitrate_per_pixel": bitrate_per_pixel(
                get("file.bitrate_kbps"), get("video.width"), get("video.height")),
            "derived.size_per_minute_mb": size_per_minute(
                get("file.size_bytes"), get("file.duration_s")),
            "derived.runtime_mismatch_min": runtime_drift(
                get("file.duration_s"), get("plex.duration_min")),
            "derived.runtime_vs_tmdb_min": runtime_delta(
                get("file.duration_s"), get("plex.duration_min"), get("tmdb.runtime")),
            "derived.is_foreign": is_foreign(get("tmdb.original_language")),
            "derived.is_box_office_bomb": is_bomb(get("tmdb.budget"), get("tmdb.revenue")),
        }
        # Computed once, then both stored and asked whether anything came out.
        names = {key: "_" + key.partition(".")[2] for key in values}
        found = items.withColumns({names[key]: value for key, value in values.items()})
        made = {key: F.col(name) for key, name in names.items()}
        made["derived.is_extended_cut"] = made["derived.runtime_vs_tmdb_min"] >= EXTENDED_MINUTES
        return self.results(
            found, made,
            F.when(F.coalesce(*[c.cast("string") for c in made.values()]).isNull(), "skipped")
            .otherwise("ok"),
            F.lit("no inputs computed yet"))
